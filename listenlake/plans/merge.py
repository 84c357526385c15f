"""Merge of the candidate sources into the serving table."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listenlake import schemas
from listenlake.functions.text import label_from_id
from listenlake.operators.keyed import best_per_key, by_user, told, union_typed, user_tasks, without_by_user
from listenlake.operators.ranking import top_rank_by_user
from listenlake.settings import TRACKS_PER_SOURCE
from listenlake.sources.shared import stored

FLAGS = ("similar_artist", "similar_tag", "deep_cut_same_artist", "old_favorite")


#: What a source's rows keep besides user, track and score.
DETAILS = "track_name string, artist_name string, similarity double, source_artist_id string, source_tags string, tag_match_count bigint"


def _sources(frames: dict[str, DataFrame], tracks: DataFrame, tasks: int) -> DataFrame:
    """Rows of all sources in one shape, in the partition of their user; ``source`` names the flag they set."""
    favourites = frames.get("old_favorite")
    if favourites is not None and "track_name" not in favourites.columns:
        names = tracks.select("track_id", "track_name", "artist_name")
        own = by_user(favourites.select("username", "track_id", "score"), tasks)
        frames = {**frames, "old_favorite": own.join(told(names), "track_id", "left")}
    shape = StructType.fromDDL(f"username string, track_id string, score double, {DETAILS}, source string")
    return union_typed([by_user(df, tasks).withColumn("source", F.lit(flag)) for flag, df in frames.items()], shape)


def _reasons(rows: DataFrame, artists: DataFrame) -> DataFrame:
    """Flags and reasons of rows that have their place already: at most 500 of a user and source reach the names."""
    names = artists.select(F.col("artist_id").alias("source_artist_id"), F.col("artist_name").alias("source_name"))
    name = F.coalesce("source_name", label_from_id("source_artist_id"))
    only = lambda flag, value: F.when(F.col("source") == flag, value)
    return rows.join(told(names), "source_artist_id", "left").select(
        "username",
        "track_id",
        "track_name",
        "artist_name",
        F.col("normalized_score").alias("score"),
        *[(F.col("source") == f).alias(f) for f in FLAGS],
        only("similar_artist", name).alias("why_similar_artist_name"),
        only("similar_artist", F.bround(F.col("similarity") * 100, 1)).alias("why_similar_artist_pct"),
        only("similar_tag", F.col("source_tags")).alias("why_similar_tags"),
        only("similar_tag", F.col("tag_match_count")).alias("why_tag_match_count"),
        only("deep_cut_same_artist", name).alias("why_deep_cut_artist"),
    )


def merge_candidates(
    plays: DataFrame,
    similar_artist: DataFrame,
    similar_tag: DataFrame,
    deep_cut: DataFrame,
    old_favorite: DataFrame | None,
    tracks: DataFrame,
    artists: DataFrame,
    tracks_per_source: int = TRACKS_PER_SOURCE,
    group_on_id: bool = False,
) -> DataFrame:
    """All sources as one table, 18 columns.

    Every source is cut to its best ``tracks_per_source`` per user with percentile-rank scores; equal rows are merged
    (flags or-ed, scores added) and enriched from the tracks dimension. A user gets a track once, and a video once.
    Rows are merged on id and spelled names; with ``group_on_id`` two spellings of a track also share one row.
    """
    tasks = user_tasks(plays)
    frames = {"similar_artist": similar_artist, "similar_tag": similar_tag, "deep_cut_same_artist": deep_cut}
    known = _sources(frames if old_favorite is None else {**frames, "old_favorite": old_favorite}, tracks, tasks)
    # One probe of what was played for all sources. An old favourite is played by nature; its track is asked for as none.
    asked = F.when(F.col("source") != "old_favorite", F.col("track_id"))
    played = by_user(plays.select("username", F.col("track_id").alias("_asked")), tasks)
    fresh = without_by_user(known.withColumn("_asked", asked), played, ["username", "_asked"]).drop("_asked")
    rows = _reasons(top_rank_by_user(fresh, tracks_per_source, ["username", "source"]), artists)

    # What a user gets once, a video or a track without one, is known by the id alone. It leads the order of the rows, and all
    # that follows goes over the rows in that order: equal rows, then what is left of a video.
    dim = tracks.select(
        "track_id",
        F.coalesce("youtube_url", "track_id").alias("_video"),
        F.col("track_name").alias("dim_track"),
        F.col("artist_name").alias("dim_artist"),
        "duration_ms",
        "tags",
        "youtube_url",
        "spotify_url",
    )
    rest = [F.col(c) for c in dim.columns if c not in ("track_id", "_video")]
    dim = told(stored(best_per_key(dim, ["track_id", "_video"], rest)))
    rows = rows.join(dim.select("track_id", "_video"), "track_id", "left").withColumn("_video", F.coalesce("_video", "track_id"))

    names = ["track_name", "artist_name"]
    keys = ["username", "_video", "track_id"]
    why = [c for c in schemas.TRACK_CANDIDATES.names if c.startswith("why_")]
    spelled = F.min(F.struct(*names)).alias("spelled")
    merged = rows.groupBy(*keys, *([] if group_on_id else names)).agg(
        # One row per source and key, added in the order of FLAGS: a retried task gives the very same double.
        reduce(add, [F.coalesce(F.max(F.when(F.col(f), F.col("score"))), F.lit(0.0)) for f in FLAGS]).alias("score"),
        *[F.bool_or(f).alias(f) for f in FLAGS],
        # A source has one row per key, so there is one value that is not NULL.
        *[F.max(c).alias(c) for c in why],
        *([spelled] if group_on_id else []),
    )
    if group_on_id:
        merged = merged.select("*", "spelled.*").drop("spelled")
    # Of a track's rows (two spellings) and a video's tracks the best stays: by score, then the track, then the flags, in which
    # the two rows of a track differ.
    values = [*why, *names]
    falling = [(-F.col("score")).alias("last"), F.col("track_id"), *[(~F.col(f)).alias(f) for f in FLAGS]]
    merged = merged.groupBy("username", "_video").agg(F.min(F.struct(*falling, *values)).alias("best")).select("username", "_video", "best.*")
    merged = merged.withColumns({"score": -F.col("last"), **{f: ~F.col(f) for f in FLAGS}})
    return (
        merged.join(dim, ["track_id", "_video"], "left")
        .withColumn("track_name", F.coalesce("dim_track", "track_name"))
        .withColumn("artist_name", F.coalesce("dim_artist", "artist_name"))
        .select(*schemas.TRACK_CANDIDATES.names)
    )
