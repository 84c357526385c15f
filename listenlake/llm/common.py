"""What the operators of this package share: the shared folder, staged tables, column checks."""

from __future__ import annotations

import ctypes
import gc
import itertools
import os
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words in the operators on shingles.
SPACE = r"[\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it. Only a local session may lack it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def staged(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: So many small tables are stored from one call of released() to the next.
RELEASE_EVERY = 4
#: Seconds to wait where large shuffles are let go.
LARGE_WAIT = 1.5
_stored = itertools.count(1)


def released(spark: SparkSession, wait: float = 0) -> None:
    """Files of finished shuffles go. Spark keeps them until the driver happens to collect its garbage, which may be long: steps
    on small tables fill no heap, but each leaves three files for every task that writes to a shuffle. wait: so many seconds,
    for the JVM is told of what Python has dropped by a thread that looks once a second; without, that goes next time."""
    gc.collect()
    time.sleep(wait)
    spark.sparkContext._jvm.System.gc()


def checkpointed(df: DataFrame) -> DataFrame:
    """As staged(), for small tables in loops: Spark removes the files once nothing refers to them, and those of shuffles
    behind them."""
    if next(_stored) % RELEASE_EVERY == 0:
        released(df.sparkSession)
    shared_folder(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


#: Rows of a few longs each that are one task's work.
TASK_ROWS = 16_384


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows of a few longs, in no more partitions than these need. Each task that writes to a shuffle
    leaves files of its own, and a table of one partition is grouped and joined with another such without a shuffle."""
    return df.coalesce(max(1, -(-rows // TASK_ROWS)))


def spare() -> None:
    """What this process has freed goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def lean(over: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """over, a function of mapInArrow or mapInPandas, with a worker that keeps no memory of a finished task. Workers wait for
    their next task, several of them a core, and what each still holds of its largest one counts against the executor."""

    def run(batches: Iterator) -> Iterator:
        yield from over(batches)
        spare()

    return run


#: Rows of a batch between Spark and Python. Texts may be long, so batches are small.
BATCH_ROWS = 1000


def with_code(spark: SparkSession) -> SparkSession:
    """Sees to it that Python workers can import this package: where their path doesn't name its folder, Spark ships it.
    Batches are bounded to BATCH_ROWS, so that a worker's memory is. A table gathered in one partition is taken for what it
    is: Spark's guess of its size, a product over the joins behind it, would have it dealt out again."""
    spark.conf.set("spark.sql.maxSinglePartitionBytes", (1 << 63) - 1)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    package = Path(__file__).resolve().parents[1]
    home, context = str(package.parent), spark.sparkContext
    if home in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_ships_llm", False):
        return spark
    target = tempfile.mkdtemp(prefix="run-")
    context.addPyFile(shutil.make_archive(f"{target}/{package.name}", "zip", home, package.name))
    context._ships_llm = True
    return spark


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, directory: str) -> DataFrame:
    return with_code(spark).read.parquet(f"{directory}/documents.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) alone, so that columns of the input can't clash with those of an operator."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def one_row_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each component the row with the least (doc_id, text hash), of several such rows the one with the least hash of
    all columns. Rows without doc_id stay. groups: (doc_id, text_hash, component) of every row."""
    counted = groups.filter("doc_id IS NOT NULL").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    first = counted.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "rows")).alias("first"))
    stay = first.select(F.col("first.doc_id").alias("_id"), F.col("first.text_hash").alias("_hash"), F.col("first.rows").alias("_rows"))
    stay = checkpointed(stay)
    own = docs.withColumn("_own_hash", text_hash())
    same = (F.col("doc_id") == F.col("_id")) & (F.col("_own_hash") == F.col("_hash"))
    kept = own.join(stay, same, "left").filter(F.col("_id").isNotNull() | F.col("doc_id").isNull())
    if not stay.filter("_rows > 1").isEmpty():
        by = Window.partitionBy("doc_id", "_own_hash").orderBy(F.xxhash64(*docs.columns))
        again = kept.filter("_rows > 1").withColumn("_rn", F.row_number().over(by)).filter("_rn = 1").drop("_rn")
        kept = kept.filter("_rows IS NULL OR _rows = 1").unionByName(again)
    return kept.select(*docs.columns)


def let(value: Column, body) -> Column:
    """body(value) with value worked out once, though a lambda in body uses it for each element."""
    return F.transform(F.array(value), body)[0]


def long_array(values: Iterable[int]) -> Column:
    return F.array(*[F.lit(int(v)).cast("long") for v in values]) if values else F.array().cast("array<bigint>")
