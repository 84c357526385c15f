"""Query op1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.llm import toxicity
from listenlake.llm.common import documents


def op1_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    docs = documents(spark, directory).select("doc_id", "text")
    labels = spark.read.parquet(f"{directory}/labels.parquet").select("doc_id", "toxic")
    model, seen = toxicity.fit(docs, labels)
    out = toxicity.scored(seen, model)
    return out.select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


QUERIES = {"op1_toxicity": op1_toxicity}
