"""Exact top-k by inner product with a vector-approximation file.

A vector's components are floored to integers (floor(1024 * x), x as double). The approximation keeps for each component
the number of its cell, all cells being `width` wide; so the score of a vector lies between the score of its cells' lower
corners and that plus a constant of the query. A search scans the cells alone, orders vectors by the bound, reads exact
vectors in that order and ends once the kth exact score is above every bound that is left. Ties go to the smaller vec_id.

The index is one row a vector: its exact components and its cells, both binary. Queries go in blocks of bounded size (at
most BLOCK vectors), each broadcast and met by every partition of the index; a partition keeps the k best of each query,
and the k best of these are the result.

Vectors that are null or hold null or non-finite components take no part, as queries or candidates. Shorter vectors count
as if zeros followed. Rows that bear a query's vec_id are not its candidates; a query that repeats is asked once. Fewer
than k candidates give as many rows. Components whose products could pass 2^53 are refused with a ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenlake.llm.common import checkpointed, staged

SCALE = 1024
CELL_BITS = 6
BLOCK = 2048
READ = 64  # exact vectors read at a time


def integer_vectors(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, x array<bigint>) of the vectors that take part."""
    x = F.transform(column, lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = vectors.filter(F.col(id_column).isNotNull() & F.col(column).isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return usable.select(F.col(id_column).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("x"))


def build(vectors: DataFrame, cell_bits: int = CELL_BITS, **columns) -> tuple[DataFrame, int, int, int]:
    """The index (vec_id, exact binary, cells binary) of all vectors, its dimension, the width of a cell and the number of
    the lowest cell."""
    rows = integer_vectors(vectors, **columns)
    dim, low, high = rows.agg(
        F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))
    ).first()
    dim, low, high = dim or 0, low or 0, high or 0
    if max(abs(low), abs(high)) ** 2 * max(1, dim) >= 2**53:
        raise ValueError("components are too large for exact scores")
    width = 1
    while (high // width) - (low // width) >= 1 << cell_bits:
        width *= 2
    first = low // width

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            exact = np.zeros((len(frame), dim), np.int32)
            for i, x in enumerate(frame["x"]):
                exact[i, : len(x)] = x
            cells = (exact // width - first).astype(np.uint8)
            yield pd.DataFrame(
                {
                    "vec_id": frame["vec_id"],
                    "exact": [r.tobytes() for r in exact],
                    "cells": [r.tobytes() for r in cells],
                }
            )

    index = staged(rows.mapInPandas(over, "vec_id bigint, exact binary, cells binary"))
    return index, dim, width, first


def _better(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:k]


def nearest(q_ids, q, ids, cells, exact_of, first: int, width: int, k: int):
    """(query place, ids, scores) of the k best of a block for each query. exact_of(places) reads exact vectors."""
    corner = (cells.astype(np.float64) + first) * width
    bound = q.astype(np.float64) @ corner.T + (width - 1) * np.maximum(q, 0).sum(axis=1, dtype=np.float64)[:, None]
    for j in range(len(q_ids)):
        own = ids != q_ids[j]
        order = np.argsort(-bound[j], kind="stable")
        order = order[own[order]]
        top_ids, top = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(order), READ):
            if len(top) == k and bound[j][order[at]] < top[-1]:
                break
            part = order[at : at + READ]
            scores = exact_of(part) @ q[j]
            top, top_ids = np.concatenate([top, scores]), np.concatenate([top_ids, ids[part]])
            best = _better(top, top_ids, k)
            top, top_ids = top[best], top_ids[best]
        yield j, top_ids, top


def _asked(index: DataFrame, block: list, dim: int, width: int, first: int, k: int) -> DataFrame:
    """k best of each partition for the queries of one block."""
    context = index.sparkSession.sparkContext
    q_ids = np.array([r["vec_id"] for r in block], np.int64)
    q = np.stack([np.frombuffer(r["exact"], np.int32) for r in block]).astype(np.int64) if block else np.zeros((0, dim), np.int64)
    shared = context.broadcast((q_ids, q))

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q_ids, q = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)
        for frame in frames:
            if not len(frame):
                continue
            ids = frame["vec_id"].to_numpy(np.int64)
            cells = np.frombuffer(b"".join(frame["cells"]), np.uint8).reshape(len(ids), dim)
            stored = frame["exact"].to_numpy()

            def exact_of(places, stored=stored):
                return np.frombuffer(b"".join(stored[places]), np.int32).reshape(len(places), dim).astype(np.int64)

            for j, near, score in nearest(q_ids, q, ids, cells, exact_of, first, width, k):
                near, score = np.concatenate([best[j][0], near]), np.concatenate([best[j][1], score])
                keep = _better(score, near, k)
                best[j] = near[keep], score[keep]
        yield pd.DataFrame(
            {
                "query_id": np.repeat(q_ids, [len(b[0]) for b in best]),
                "vec_id": np.concatenate([b[0] for b in best] or [np.zeros(0, np.int64)]),
                "score": np.concatenate([b[1] for b in best] or [np.zeros(0, np.int64)]),
            }
        )

    return index.mapInPandas(over, "query_id bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query, k: int = 10, cell_bits: int = CELL_BITS, block: int = BLOCK, **columns) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of every query. is_query: condition on vec_id."""
    index, dim, width, first = build(vectors, cell_bits, **columns)
    queries = index.filter(is_query).dropDuplicates(["vec_id"])
    found = None
    after = None
    while True:
        rest = queries if after is None else queries.filter(F.col("vec_id") > after)
        rows = rest.orderBy("vec_id").limit(block).select("vec_id", "exact").collect()
        if not rows and found is not None:
            break
        part = _asked(index, rows, dim, width, first, k)
        more = len(rows) == block
        found = part if found is None else found.unionByName(part)
        if not more:
            break
        found, after = checkpointed(found), rows[-1]["vec_id"]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
