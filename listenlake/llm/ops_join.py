"""Queries op3, op5 and op7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.llm import sharding, simhash, vafile
from listenlake.llm.common import documents, with_code


def op3_simhash_near_dedup(spark: SparkSession, directory: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, directory).select("doc_id", "text"))
    return found.select("doc_id", simhash.bits_hex(F.col("bits")).alias("fingerprint"), "component_id")


def op5_exact_top_k(spark: SparkSession, directory: str) -> DataFrame:
    vectors = with_code(spark).read.parquet(f"{directory}/embeddings.parquet")
    return vafile.top_k(vectors.select("vec_id", "embedding"), F.col("vec_id") % 100 == 0, 10)


def op7_sharding(spark: SparkSession, directory: str) -> DataFrame:
    placed = sharding.shard_records(documents(spark, directory).select("doc_id", "text"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {f.__name__: f for f in (op3_simhash_near_dedup, op5_exact_top_k, op7_sharding)}
