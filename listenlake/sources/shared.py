"""The folder that the driver and all executors see, and tables that a plan keeps there."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: ``spark.checkpoint.dir`` of the session. Only a local session without that
    setting gets a temporary folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    if not _local_dir:
        _local_dir.append(tempfile.mkdtemp(prefix="listenlake-"))
    return _local_dir[0]


def stored(df: DataFrame) -> DataFrame:
    """The rows of df, written once to the shared folder and read back: what a plan uses several times, or must know the
    size of, is worked out once, and lost executors don't make it anew."""
    path = f"{shared_dir(df.sparkSession)}/staging/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_shuffles(spark: SparkSession, wait: float = 0) -> None:
    """Files of finished shuffles go, which Spark else keeps until the driver happens to collect its garbage. ``wait``: so many
    seconds, as the JVM is told of what Python has dropped by a thread that looks once a second; without, that goes next time."""
    gc.collect()
    time.sleep(wait)
    spark.sparkContext._jvm.System.gc()
