"""Dimension tables: version dedup, users, and members still missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake import schemas
from listenlake.functions.recency import MIN_HALF_LIFE_DAYS, half_life_days, whole_days
from listenlake.functions.text import canonical_artist_id, canonical_track_id, is_music_video
from listenlake.operators.keyed import only_new
from listenlake.settings import MIN_ARTIST_LISTENERS


def dedup_tracks(tracks: DataFrame) -> DataFrame:
    """One row per canonical track: metadata of the best version (no music video, then most plays, then by name and
    url), greatest popularity over all versions.

    ``min_by`` over a struct combines on the map side, so a track with millions of versions sends one row per task.
    """
    meta = ["track_name", "artist_name", "duration_ms", "track_url", "tags", "youtube_url", "spotify_url"]
    plays = F.coalesce("playcount", F.lit(0))
    order = F.struct(
        is_music_video("track_name").alias("video"),
        (-plays).alias("plays"),
        *[F.col(c) for c in ("track_name", "artist_name", "track_url", "youtube_url", "spotify_url", "tags", "duration_ms")],
    )
    best = (
        tracks.withColumn("track_id", canonical_track_id("track_name", "artist_name"))
        .groupBy("track_id")
        .agg(
            F.min_by(F.struct(*meta), order).alias("best"),
            F.max("listeners").alias("listeners"),
            F.max("playcount").alias("playcount"),
        )
    )
    flat = best.select("track_id", "best.*", "listeners", "playcount")
    return flat.withColumn("artist_id", canonical_artist_id("artist_name")).select(*schemas.TRACKS.names)


def dedup_artists(artists: DataFrame) -> DataFrame:
    """One row per canonical artist: metadata of the entry with most plays, greatest popularity over all entries."""
    meta = ["artist_name", "artist_url", "tags", "bio_summary"]
    order = F.struct(
        F.col("playcount").isNull().alias("unknown"),
        (-F.col("playcount")).alias("plays"),
        *[F.col(c) for c in meta],
    )
    return (
        artists.withColumn("artist_id", canonical_artist_id("artist_name"))
        .groupBy("artist_id")
        .agg(
            F.min_by(F.struct(*meta), order).alias("best"),
            F.max("listeners").alias("listeners"),
            F.max("playcount").alias("playcount"),
        )
        .select("artist_id", "best.*", "listeners", "playcount")
        .select(*schemas.ARTISTS.names)
    )


def known_artists(artists: DataFrame, min_listeners: int = MIN_ARTIST_LISTENERS) -> DataFrame:
    """Artists with so few listeners are mostly misspellings and are left out of the dimension."""
    return artists.filter(F.col("listeners") >= min_listeners)


def with_half_life(users: DataFrame) -> DataFrame:
    """Listening span and half-life of users whose first and last plays are known."""
    span = whole_days(F.col("first_play_date"), F.col("last_play_date"))
    users = users.withColumn("listening_span_days", span)
    return users.withColumn("user_half_life_days", half_life_days(F.col("listening_span_days")))


def dim_users(plays: DataFrame) -> DataFrame:
    """Listening span and half-life per user."""
    return with_half_life(
        plays.groupBy("username").agg(
            F.min("scrobbled_at_utc").alias("first_play_date"),
            F.max("scrobbled_at_utc").alias("last_play_date"),
            F.count("*").alias("total_plays"),
        )
    )


def default_half_lives(plays: DataFrame) -> DataFrame:
    """Stand-in for a missing user dimension."""
    return plays.select("username").distinct().withColumn("user_half_life_days", F.lit(MIN_HALF_LIFE_DAYS))


def new_tracks(plays: DataFrame, tracks: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Tracks played or recommended that the dimension lacks, one name pair per id."""
    columns = ["track_id", "track_name", "artist_name"]
    seen = plays.select(columns)
    if candidates is not None:
        named = candidates.filter(F.col("track_name").isNotNull() & F.col("artist_name").isNotNull())
        seen = seen.unionByName(named.select(columns))
    names = F.min(F.struct("track_name", "artist_name")).alias("n")
    missing = only_new(seen.distinct(), tracks, "track_id")
    return missing.groupBy("track_id").agg(names).select("track_id", "n.track_name", "n.artist_name")


def new_artists(plays: DataFrame, artists: DataFrame) -> DataFrame:
    """Artist names played that the dimension lacks."""
    names = plays.select("artist_name").distinct()
    return only_new(names.withColumn("artist_id", canonical_artist_id("artist_name")), artists, "artist_id")
