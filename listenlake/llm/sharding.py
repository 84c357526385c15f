"""Shards of nearly equal size by sampled splitters.

Records are ordered by the hash of their text, so that equal texts lie together. A sample of keys, drawn with
probabilities in proportion to size, gives quantile boundaries of many more ranges than shards; records are
range-partitioned by them and the ranges measured over all rows. A range that is larger than a shard (a key that many
records share) is subdivided by doc_id; then ranges go to shards, largest first, each to the least filled one. What passes
the driver is the splitters and one line for each range.

Size: UTF-8 bytes of the text (null: none) plus 8. Law: `bytes`. Equal texts are in one shard unless they alone overfill
it. Repeated rows and null ids are records like any other. An empty table gives no rows.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenlake.llm.common import staged

SHARDS = 24
RANGES_PER_SHARD = 64
SAMPLE_PER_RANGE = 32
EXTRA = 8


def splitters(records: DataFrame, ranges: int, total: int, per_range: int = SAMPLE_PER_RANGE) -> list[int]:
    """Boundaries of about equal size: quantiles of a sample in which a record's chance is in proportion to its size. The
    draw is a hash of the record, so that it is the same whenever it is run."""
    wanted = ranges * per_range / max(1, total)
    draw = F.pmod(F.xxhash64("key", "doc_id", "size", F.lit(7)), F.lit(1 << 30)) / float(1 << 30)
    sample = records.filter(draw < F.least(F.lit(1.0), F.col("size") * wanted))
    shares = [i / ranges for i in range(1, ranges)]
    cuts = sample.agg(F.percentile_approx("key", shares, 100 * ranges)).first()[0] if shares else []
    return sorted(set(cuts or []))


def in_ranges(records: DataFrame, cuts: list[int]) -> DataFrame:
    """records with `range`, the number of boundaries at or below the key."""
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def number(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64), side="right").astype(np.int32))

    return records.withColumn("range", number("key"))


def subdivided(sized: list[tuple[int, int]], target: float) -> dict[int, int]:
    """How many parts each overfull range is cut into."""
    return {r: int(-(-size // (target / 4))) for r, size in sized if size > target}


def dealt(parts: list[tuple[int, int, int, int]], shards: int) -> list[tuple[int, int, int, int]]:
    """(range, part, shard, first slot) of (range, part, size, rows): largest first, to the least filled shard."""
    load = [(0, s) for s in range(shards)]
    heapq.heapify(load)
    home = {}
    for r, p, size, _ in sorted(parts, key=lambda x: (-x[2], x[0], x[1])):
        filled, shard = heapq.heappop(load)
        home[r, p] = shard
        heapq.heappush(load, (filled + size, shard))
    slots, out = [0] * shards, []
    for r, p, _, rows in sorted(parts):
        shard = home[r, p]
        out.append((r, p, shard, slots[shard]))
        slots[shard] += rows
    return out


def shard_records(
    docs: DataFrame, shards: int = SHARDS, ranges_per_shard: int = RANGES_PER_SHARD, extra: int = EXTRA
) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every document; slots of a shard run from 0 without gaps, in order of
    range, part, key and doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    records = staged(
        docs.select(
            "doc_id",
            (F.octet_length(text) + extra).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.xxhash64(text).alias("key"),
        )
    )
    total = records.agg(F.sum("size")).first()[0] or 0
    target = total / shards
    ranged = in_ranges(records, splitters(records, shards * ranges_per_shard, total))
    sizes = ranged.groupBy("range").agg(F.sum("size").alias("size")).collect()
    cut = subdivided([(r["range"], r["size"]) for r in sizes], target)
    part = F.lit(0)
    for r, n in cut.items():
        spread = F.pmod(F.xxhash64("doc_id", "size", "key"), F.lit(n)).cast("int")
        part = F.when(F.col("range") == r, spread).otherwise(part)
    ranged = ranged.withColumn("part", part)
    measured = ranged.groupBy("range", "part").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
    plan = dealt([(r["range"], r["part"], r["size"], r["rows"]) for r in measured], shards)
    homes = docs.sparkSession.createDataFrame(plan, "range int, part int, shard int, first bigint")
    order = Window.partitionBy("range", "part").orderBy("key", "doc_id", "size", "text_crc32")
    placed = ranged.withColumn("place", F.row_number().over(order) - 1).join(F.broadcast(homes), ["range", "part"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).alias("slot"))
