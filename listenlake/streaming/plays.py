"""Plays as a stream: idempotent ingest, suppression of repeats, daily counts, refresh of statistics."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from listenlake.operators.dimensions import dim_users
from listenlake.operators.history import day_counts
from listenlake.operators.statistics import artist_play_counts, track_play_counts
from listenlake.sources.lake import Lake, with_user_bucket

PLAY_KEY = ["username", "scrobbled_at"]


def landed_files(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def placed(df: DataFrame, partition_by: Sequence[str]) -> DataFrame:
    """``df`` with the bucket of its user where the table is partitioned by it."""
    return with_user_bucket(df) if "user_bucket" in partition_by and "user_bucket" not in df.columns else df


def run_batches(
    stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, output: str = "append"
) -> StreamingQuery:
    """Process what has landed, then stop. The checkpoint remembers the files; a repeated batch must change nothing."""
    writer = stream.writeStream.outputMode(output).foreachBatch(apply).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def append_rows(stream: DataFrame, lake: Lake, table: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Every batch is appended once: the table remembers the batches it has, by the checkpoint's name."""

    def apply(batch: DataFrame, number: int) -> None:
        lake.write(batch, table, "append", partition_by, batch=(checkpoint, number))

    return run_batches(stream, apply, checkpoint)


def ingest(plays: DataFrame, lake: Lake, table: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Every batch is upserted on (user, time), so files that overlap or come twice are harmless."""

    def apply(batch: DataFrame, _: int) -> None:
        lake.upsert(placed(batch, partition_by), table, PLAY_KEY, partition_by)

    return run_batches(plays, apply, checkpoint)


def without_repeats(plays: DataFrame, delay: str = "1 day") -> DataFrame:
    """First copy of each play that comes within ``delay`` of the latest one of earlier batches; later plays are left out,
    also those never seen before (``store_first_copies`` keeps them)."""
    return plays.withWatermark("scrobbled_at_utc", delay).dropDuplicatesWithinWatermark(PLAY_KEY)


def store_first_copies(
    plays: DataFrame, lake: Lake, table: str, checkpoint: str, partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """First copy of each play, however late it comes: a batch adds what the table lacks by (user, time)."""

    def apply(batch: DataFrame, _: int) -> None:
        lake.insert_new(placed(batch, partition_by), table, PLAY_KEY, partition_by)

    return run_batches(plays, apply, checkpoint)


def daily_counts(plays: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Plays per user and day so far. Plays that come later than ``delay`` after their day was closed are not counted;
    ``late_rows`` tells how many."""
    day = F.window("scrobbled_at_utc", "1 day")
    counts = plays.withWatermark("scrobbled_at_utc", delay).groupBy(day, "username").agg(F.count("*").alias("plays"))
    return counts.select("username", F.col("window.start").alias("day"), "plays")


def store_daily_counts(
    plays: DataFrame, lake: Lake, table: str, checkpoint: str, delay: str = "1 hour", partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Running counts, upserted with every batch: open days are in the table with what has come so far."""

    def apply(batch: DataFrame, _: int) -> None:
        lake.upsert(batch if not partition_by else placed(batch, partition_by), table, ["username", "day"], partition_by)

    return run_batches(daily_counts(plays, delay), apply, checkpoint, "update")


def late_rows(query: StreamingQuery) -> int:
    """Rows that a finished stream left out as too late."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def refresh_statistics(
    plays: DataFrame,
    lake: Lake,
    plays_table: str,
    counts_table: str,
    as_of: datetime | str,
    checkpoint: str,
    partition_by: Sequence[str] = (),
    users_table: str | None = None,
    artist_counts_table: str | None = None,
    tracks: DataFrame | None = None,
    artists: DataFrame | None = None,
) -> StreamingQuery:
    """Ingest, then recompute the statistics of the users in the batch: track counts, and where their tables are named the
    user dimension and the artist counts (these need ``tracks`` and ``artists``). The other users' scores are still those
    of ``as_of``; when ``as_of`` moves, all users are to be recomputed in batch."""

    def apply(batch: DataFrame, _: int) -> None:
        batch = placed(batch, partition_by)
        lake.upsert(batch, plays_table, PLAY_KEY, partition_by)
        place = ["username", *[c for c in partition_by if c != "username"]]
        users = batch.select(*place).distinct()
        theirs = lake.read_partitions(plays_table, users).join(users.select("username"), "username", "left_semi")
        who = dim_users(theirs)
        counts = track_play_counts(theirs, who, as_of)
        lake.replace_users(placed(counts, partition_by), counts_table, users, partition_by)
        if users_table is not None:
            lake.replace_users(placed(who, partition_by), users_table, users, partition_by)
        if artist_counts_table is not None:
            by_artist = artist_play_counts(theirs, who, tracks, artists, as_of)
            lake.replace_users(placed(by_artist, partition_by), artist_counts_table, users, partition_by)

    return run_batches(plays, apply, checkpoint)


def fold_batch(
    batch: DataFrame, lake: Lake, plays_table: str, days_table: str, mark: tuple[str, int], partition_by: Sequence[str] = ()
) -> None:
    """Plays that are new go to the facts and, counted per day, to the history. Both are partitions of this batch, so one
    that is repeated after a crash, wherever it broke off, ends with the same tables."""
    with lake.unknown(placed(batch, partition_by), plays_table, PLAY_KEY, partition_by, mark) as new:
        lake.write(placed(day_counts(new), partition_by), days_table, "append", partition_by, mark)
        lake.write(new, plays_table, "append", partition_by, mark)


def keep_history(
    plays: DataFrame, lake: Lake, plays_table: str, days_table: str, checkpoint: str, partition_by: Sequence[str] = ()
) -> StreamingQuery:
    """Ingest into facts and day histograms. Track counts, artist counts and the user dimension of any midnight and any
    half-life follow from the histograms alone (``operators.history``): a refresh reads no old plays."""

    def apply(batch: DataFrame, number: int) -> None:
        fold_batch(batch, lake, plays_table, days_table, (checkpoint, number), partition_by)

    return run_batches(plays, apply, checkpoint)
