"""A corpus from raw documents to packed training sequences: five stages, each an operator of listenlake.llm.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last keep the columns of documents.

    toxicity     documents with a score of 0.5 or more go
    line_dedup   a line with a letter or digit that equals an earlier line goes, and of 24 characters or more also one within
                 an edit of an earlier one; documents stay
    simhash      of documents whose SimHash fingerprints are linked at two or fewer differing bits (op3) the one with the least
                 doc_id stays; of those left, the one of each group linked by a Jaccard similarity of 0.8 or more of five-word
                 shingles (near_copies, exact: no radius of op3's masks reaches that far)
    secrets      findings are masked; documents stay
    packing      every piece of every document gets its place in a sequence
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listenlake.llm import line_dedup, near_copies, packing, secrets, simhash, toxicity
from listenlake.llm.common import staged, with_code


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, with_code(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_code(spark)
    return line_dedup.dedup_lines(docs, signs=1)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_code(spark)
    return near_copies.keep_one(staged(simhash.keep_one(docs)))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with_code(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", toxic_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

#: The label model, the shingle hashes (XXH64) and the packing have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_code(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
