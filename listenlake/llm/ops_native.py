"""Queries op8 and op10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.llm import secrets as S
from listenlake.llm import sketch as K
from listenlake.llm.common import documents


def op8_secret_scan(spark: SparkSession, directory: str) -> DataFrame:
    found = S.find_secrets(documents(spark, directory).select("doc_id", "text"))
    count = lambda n: F.size(F.filter("base_findings", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(S.spans_text(F.col("base_findings")), 256).alias("base_sha256"),
        S.spans_text(F.col("findings")).alias("spans"),
    )


def op10_fingerprint(spark: SparkSession, directory: str) -> DataFrame:
    rows = K.with_next(
        documents(spark, directory).select("doc_id", "text"),
        lambda df: df.withColumn("sketch", K.sketch(F.col("text"))),
    )
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr(F.col("next.text"), F.lit(1), cut))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next", edited.alias("edited"))
    rows = rows.withColumn("edited_sketch", K.sketch(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        K.sketch_hex(F.col("sketch")).alias("fingerprint"),
        K.sketch_hex(F.col("edited_sketch")).alias("edited_fingerprint"),
        K.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        K.resemblance(F.col("sketch"), F.col("next.sketch")).alias("near_next"),
    )


QUERIES = {f.__name__: f for f in (op8_secret_scan, op10_fingerprint)}
