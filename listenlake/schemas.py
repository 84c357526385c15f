"""Explicit schemas; a field missing in landed JSON reads as NULL instead of changing a type."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TYPES = {
    "string": StringType(),
    "bigint": LongType(),
    "int": IntegerType(),
    "double": DoubleType(),
    "boolean": BooleanType(),
    "timestamp": TimestampType(),
}


def table(columns: str) -> StructType:
    """Flat schema from ``name type, name type``; works without a running session, unlike ``fromDDL``."""
    pairs = (column.split() for column in columns.split(","))
    return StructType([StructField(name, _TYPES[kind]) for name, kind in pairs])


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_TEXT = StringType()
_NAMED = _struct(name=_TEXT, mbid=_TEXT)
_TAGS = _struct(tag=ArrayType(_struct(name=_TEXT)))

# Bronze
RAW_PLAY = _struct(
    name=_TEXT,
    mbid=_TEXT,
    url=_TEXT,
    loved=_TEXT,
    date=_struct(uts=_TEXT, **{"#text": _TEXT}),
    artist=_NAMED,
    album=_struct(**{"#text": _TEXT}, mbid=_TEXT),
)
RAW_TRACK = _struct(
    name=_TEXT,
    mbid=_TEXT,
    url=_TEXT,
    duration=_TEXT,
    listeners=_TEXT,
    playcount=_TEXT,
    artist=_NAMED,
    album=_struct(title=_TEXT, mbid=_TEXT),
    toptags=_TAGS,
    youtube_url=_TEXT,
    spotify_url=_TEXT,
)
RAW_ARTIST = _struct(
    name=_TEXT,
    mbid=_TEXT,
    url=_TEXT,
    stats=_struct(listeners=_TEXT, playcount=_TEXT),
    tags=_TAGS,
    bio=_struct(summary=_TEXT),
)

# Landed answers of the music service; pos is the place in the answer, from 1.
SIMILAR_ARTISTS = table("artist_name string, similar_name string, match double, pos int")
ARTIST_TOP_TRACKS = table(
    "artist_name string, track_name string, track_artist string, listeners bigint, playcount bigint, pos int"
)
TAG_TOP_TRACKS = table("tag string, track_name string, artist_name string, pos int")
ARTIST_TOP_ALBUMS = table("artist_name string, album_name string, playcount bigint, pos int")
ALBUM_TRACKS = table("album_name string, artist_name string, track_name string, pos int")
LINK_SEARCH = table(
    "track_id string, platform string, search string, result_type string, result_id string, title string, "
    "channel string, pos int"
)

# Silver
PLAYS = table(
    "username string, scrobbled_at bigint, scrobbled_at_utc timestamp, track_name string, track_url string, "
    "artist_name string, is_loved boolean, track_id string"
)
TRACKS = table(
    "track_id string, track_name string, artist_name string, duration_ms bigint, track_url string, tags string, "
    "listeners bigint, playcount bigint, youtube_url string, spotify_url string, artist_id string"
)
ARTISTS = table(
    "artist_id string, artist_name string, artist_url string, tags string, bio_summary string, listeners bigint, "
    "playcount bigint"
)
DIM_USERS = table(
    "username string, first_play_date timestamp, last_play_date timestamp, total_plays bigint, "
    "listening_span_days bigint, user_half_life_days double"
)
CANDIDATE_SIMILAR_ARTIST = table(
    "username string, track_id string, track_name string, artist_name string, similarity double, score double, "
    "source_artist_id string"
)
CANDIDATE_SIMILAR_TAG = table(
    "username string, track_id string, track_name string, artist_name string, tag_match_count bigint, score double, "
    "source_tags string"
)
CANDIDATE_DEEP_CUT = table(
    "username string, track_id string, track_name string, artist_name string, score double, source_artist_id string"
)
CANDIDATE_OLD_FAVORITES = table(
    "username string, track_id string, score double, play_count bigint, days_since_last_play bigint"
)

# Gold
ARTIST_PLAY_COUNT = table(
    "username string, artist_id string, artist_name string, play_count bigint, first_played_on timestamp, "
    "last_played_on timestamp, recency_score double, days_since_last_play int"
)
TRACK_PLAY_COUNT = table(
    "username string, track_id string, track_name string, artist_name string, play_count bigint, "
    "first_played_on timestamp, last_played_on timestamp, recency_score double, days_since_last_play int"
)
TRACK_CANDIDATES = table(
    "username string, track_id string, track_name string, artist_name string, score double, similar_artist boolean, "
    "similar_tag boolean, deep_cut_same_artist boolean, old_favorite boolean, why_similar_artist_name string, "
    "why_similar_artist_pct double, why_similar_tags string, why_tag_match_count bigint, why_deep_cut_artist string, "
    "duration_ms bigint, tags string, youtube_url string, spotify_url string"
)
USER_STATS = table(
    "username string, total_plays bigint, total_tracks_played bigint, total_artists_played bigint"
)
EXCLUDED_TRACKS = table(
    "username string, track_id string, track_name string, artist_name string, excluded_at timestamp"
)
EXCLUDED_ARTISTS = table("username string, artist_name string, excluded_at timestamp")
