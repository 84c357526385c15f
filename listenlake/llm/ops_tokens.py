"""Queries op2, op4 and op6."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from listenlake.llm import packing, pieces, training_order
from listenlake.llm.common import documents, shared_folder


def op2_best_fit_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packing.pack_documents(documents(spark, directory).select("doc_id", "text"))


def op4_training_order(spark: SparkSession, directory: str) -> DataFrame:
    """Writes the files to the shared folder and returns a row for each sequence, its documents among it."""
    folder = f"{shared_folder(spark)}/order-{uuid.uuid4().hex}"
    return training_order.materialise(documents(spark, directory).select("doc_id", "text"), folder)


def op6_sentencepiece(spark: SparkSession, directory: str) -> DataFrame:
    return pieces.digests(documents(spark, directory).select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op2_best_fit_packing, op4_training_order, op6_sentencepiece)}
