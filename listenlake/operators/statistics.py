"""Play statistics with per-user recency decay."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake import schemas
from listenlake.functions.recency import decay_e, instant, whole_days
from listenlake.operators.keyed import join_spread


def look_back(plays: DataFrame, as_of: datetime | str | Column, days: int) -> DataFrame:
    """Plays of the last ``days`` days."""
    return plays.filter(F.col("scrobbled_at_utc") >= instant(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))


def _per_day(plays: DataFrame, by: list[str], as_of: Column) -> DataFrame:
    """Plays per group and age in days. The decay depends on the age only, so this first aggregate, combined on the
    map side, takes the weight out of a hot group before the half-life join."""
    ts = F.col("scrobbled_at_utc")
    return plays.groupBy(*by, whole_days(ts, as_of).alias("days_ago")).agg(
        F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    )


def _decayed(per_day: DataFrame, half_lives: DataFrame, entity: str, as_of: Column, *extra: Column) -> DataFrame:
    """Average decay per play and play counts per user and entity. A user has few rows per entity, one for each age in
    days, except that all tracks without an entity are one group: those rows are added up per age first."""
    weight = F.col("n") * decay_e(F.col("days_ago"), F.col("user_half_life_days"))
    users = half_lives.select("username", "user_half_life_days")
    joined = join_spread(per_day, users, "username", F.col(entity))
    return (
        joined.groupBy("username", "_salt", entity)
        .agg(
            F.sum("n").alias("play_count"),
            F.min("first_ts").alias("first_played_on"),
            F.max("last_ts").alias("last_played_on"),
            (F.sum(weight) / F.sum("n")).alias("recency_score"),
            *extra,
        )
        .drop("_salt")
        .withColumn("days_since_last_play", whole_days(F.col("last_played_on"), as_of).cast("int"))
    )


def track_play_counts(plays: DataFrame, half_lives: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """Count, first and last play, average decay per user and track. Of several spellings the least is shown."""
    per_day = _per_day(plays, ["username", "track_id", "track_name", "artist_name"], instant(as_of))
    return track_counts_by_age(per_day, half_lives, as_of)


def track_counts_by_age(per_day: DataFrame, half_lives: DataFrame, as_of: datetime | str | Column) -> DataFrame:
    """The same from plays counted per user, track and age (``_per_day``, or a history of days)."""
    names = F.min(F.struct("track_name", "artist_name")).alias("names")
    out = _decayed(per_day, half_lives, "track_id", instant(as_of), names)
    return out.select("*", "names.*").select(*schemas.TRACK_PLAY_COUNT.names)


def artist_play_counts(
    plays: DataFrame, half_lives: DataFrame, tracks: DataFrame, artists: DataFrame, as_of: datetime | str | Column
) -> DataFrame:
    """The same per user and artist; plays of tracks without an artist form one group with a NULL id."""
    per_day = _per_day(plays, ["username", "track_id"], instant(as_of))
    return artist_counts_by_age(per_day, half_lives, tracks, artists, as_of)


def artist_counts_by_age(
    per_day: DataFrame, half_lives: DataFrame, tracks: DataFrame, artists: DataFrame, as_of: datetime | str | Column
) -> DataFrame:
    by_artist = per_day.join(tracks.select("track_id", "artist_id"), "track_id", "left")
    by_artist = by_artist.groupBy("username", "artist_id", "days_ago").agg(
        F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    )
    out = _decayed(by_artist, half_lives, "artist_id", instant(as_of))
    names = artists.select("artist_id", "artist_name").distinct()
    return out.join(names, "artist_id", "left").select(*schemas.ARTIST_PLAY_COUNT.names)


def serving_key() -> Column:
    """Key of an artist count in the serving store: id, else name, else ``unknown``."""
    return F.coalesce(F.nullif("artist_id", F.lit("")), F.nullif("artist_name", F.lit("")), F.lit("unknown"))


def plays_per_artist(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Play count per user and known artist straight from the facts, for a lake without gold tables."""
    per_track = plays.groupBy("username", "track_id").agg(F.count("*").alias("n"))
    return (
        per_track.join(tracks.select("track_id", "artist_id").filter("artist_id IS NOT NULL"), "track_id")
        .groupBy("username", "artist_id")
        .agg(F.sum("n").alias("play_count"))
    )


def user_stats(track_counts: DataFrame, artist_counts: DataFrame) -> DataFrame:
    per_track = track_counts.groupBy("username").agg(
        F.sum("play_count").alias("total_plays"), F.count("*").alias("total_tracks_played")
    )
    per_artist = artist_counts.groupBy("username").agg(F.count("*").alias("total_artists_played"))
    out = per_track.join(per_artist, "username", "left")
    return out.withColumn("total_artists_played", F.coalesce("total_artists_played", F.lit(0)))
