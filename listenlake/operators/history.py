"""Play history as day histograms: a state that merges by addition, from which statistics for any half-life and any day
follow without the plays.

A day here ends at midnight (UTC) and its end belongs to it, so that the age of its plays at a later midnight is the same
number of whole 24-hour units for all of them. Statistics are therefore told for midnights.
"""

from __future__ import annotations

from datetime import datetime, time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.functions.recency import instant
from listenlake.operators.dimensions import with_half_life

GROUP = ["username", "track_id", "track_name", "artist_name"]
DAY_MICROS = 86_400_000_000


def day_counts(plays: DataFrame) -> DataFrame:
    """Plays per user, track and day, with the first and the last. Counts of different plays may be put side by side."""
    ts = F.col("scrobbled_at_utc")
    micros = F.unix_micros(ts)
    day = ((micros + F.pmod(-micros, F.lit(DAY_MICROS))) / DAY_MICROS).cast("int").alias("day")
    return plays.groupBy(*GROUP, day).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def merged(days: DataFrame) -> DataFrame:
    """One row per user, track and day of counts that lie side by side."""
    sums = F.sum("n").alias("n"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")
    return days.groupBy(*GROUP, "day").agg(*sums)


def aged(days: DataFrame, as_of: datetime | str) -> DataFrame:
    """Counts by age in days at a midnight. Plays after it count from the end of their day."""
    if datetime.fromisoformat(str(as_of)).time() != time(0):
        raise ValueError(f"day histograms tell of midnights, not of {as_of}")
    now = F.unix_date(instant(as_of).cast("date"))
    return merged(days).withColumn("days_ago", (now - F.col("day")).cast("bigint")).drop("day")


def users_of_days(days: DataFrame) -> DataFrame:
    """The user dimension: listening span and half-life."""
    spans = F.min("first_ts").alias("first_play_date"), F.max("last_ts").alias("last_play_date"), F.sum("n").alias("total_plays")
    return with_half_life(days.groupBy("username").agg(*spans))
