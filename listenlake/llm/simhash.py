"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits; a bit is 1 if it is set in over half the hashes of a text's shingles. Texts whose fingerprints
differ in at most `radius` bits are linked. The masks are structured: each bit place gets a vector of radius + 1 bits,
none zero, and the mask of table v holds the places whose vector has an odd inner product with v. For any radius places
there is a v that is orthogonal to all of them, so two fingerprints within the radius agree under some mask: no pair is
missed, whatever the data.

Only distinct fingerprints take part. A bucket (equal fingerprints under a mask) of at most BUCKET of them is checked pair
by pair in memory and gives a spanning forest of its links, never all its pairs. A larger bucket is dealt out anew,
exactly: each of its fingerprints is masked at every choice of `radius` of the places that the table's mask leaves free;
two of the bucket are within the radius if and only if they agree under one of these, and each such group gives links to
its least member.

Words are what lies between the characters 09-0D and 20; A-Z are lower-cased; a text with fewer words than a shingle has
its whole sequence as the one shingle; a text without words, null among them, has fingerprint 0 and is linked like any
other. A row without doc_id gets a fingerprint and the component of its group. Repeated rows stay, each with its result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import checkpointed, lean, one_row_each, staged, text_hash, texts
from listenlake.llm.components import components

SHINGLE = 3
RADIUS = 2
BITS = 64
BUCKET = 256
SEED = 42


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one whole text."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops)], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8)
        counts += np.unpackbits(block, bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = SHINGLE, hashes: bool = False) -> DataFrame:
    """(doc_id, bits): the fingerprint as a signed long; hashes: and the hash of the text."""
    rows = texts(docs, *([text_hash().alias("text_hash")] if hashes else []))
    more = ["text_hash"] if hashes else []

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            columns = [batch.column(0), pa.array(bits), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "bits", *more])

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, bits bigint"
    return rows.mapInArrow(lean(over), schema + ", text_hash bigint" * hashes)


def masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius + 1) - 1 masks. Vectors are dealt to the places in turn, so that masks are of nearly equal size."""
    vectors = [1 + place % (2 ** (radius + 1) - 1) for place in range(BITS)]
    return [
        sum(1 << place for place, w in enumerate(vectors) if (w & v).bit_count() % 2)
        for v in range(1, 2 ** (radius + 1))
    ]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _masked(bits: Column, mask: int) -> Column:
    return bits.bitwiseAND(F.lit(signed(mask)).cast("long"))


def forest(bits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links between rows that join up all pairs within the radius; at most one fewer than rows."""
    root = list(range(len(bits)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(len(bits) - 1):
        near = np.flatnonzero(np.bitwise_count(bits[i + 1 :] ^ bits[i]) <= radius) + i + 1
        for j in near.tolist():
            a, b = top(i), top(j)
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _small_links(groups: DataFrame, radius: int) -> DataFrame:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for group in batch.column(0):
                bits = np.sort(np.array(group.as_py(), np.int64)).view(np.uint64)
                for i, j in forest(bits, radius):
                    a.append(bits[i])
                    b.append(bits[j])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"]
            )

    return groups.select("members").mapInArrow(lean(over), "a bigint, b bigint")


def _large_links(rows: DataFrame, radius: int, tables: list[int]) -> DataFrame:
    """Links in buckets of any size: rows (table, bits) that agree outside some `radius` free places of the table."""
    every = (1 << BITS) - 1
    choices = []
    for mask in tables:
        free = [p for p in range(BITS) if not mask >> p & 1]
        choices.append([signed(every ^ sum(1 << p for p in c)) for c in itertools.combinations(free, radius)])

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for table, part in frame.groupby("table"):
                keep = np.array(choices[int(table)], np.int64)
                for at in range(0, len(part), 1000):
                    bits = part["bits"].to_numpy(np.int64)[at : at + 1000]
                    yield pd.DataFrame(
                        {
                            "table": np.int32(table),
                            "choice": np.tile(np.arange(len(keep), dtype=np.int32), len(bits)),
                            "rest": (bits[:, None] & keep[None, :]).ravel(),
                            "bits": np.repeat(bits, len(keep)),
                        }
                    )

    spread = rows.mapInPandas(lean(over), "table int, choice int, rest bigint, bits bigint")
    ranges = spread.groupBy("table", "choice", "rest").agg(F.min("bits").alias("b"), F.max("bits").alias("most"))
    shared = ranges.filter(F.col("b") != F.col("most")).drop("most")
    return spread.join(shared, ["table", "choice", "rest"]).select(F.col("bits").alias("a"), "b").filter("a != b").distinct()


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(a, b) of distinct fingerprints (bits) that join up all pairs within the radius."""
    tables = masks(radius)
    keys = F.explode(
        F.array(*[F.struct(F.lit(t).alias("table"), _masked(F.col("bits"), m).alias("key")) for t, m in enumerate(tables)])
    )
    rows = distinct.select("bits", keys.alias("k")).select("bits", "k.table", "k.key")
    sizes = rows.groupBy("table", "key").agg(F.count("*").alias("members"))
    crowded = rows.join(sizes.filter(F.col("members") > 1), ["table", "key"])
    crowded = checkpointed(crowded)
    small = crowded.filter(F.col("members") <= bucket).groupBy("table", "key")
    small = small.agg(F.collect_list("bits").alias("members"))
    large = crowded.filter(F.col("members") > bucket).select("table", "bits")
    return _small_links(small, radius).unionByName(_large_links(large, radius, tables)).distinct()


def _grouped(each: DataFrame, radius: int, bucket: int) -> DataFrame:
    """Rows of each (doc_id, bits and others) with their component, a fingerprint, and component_id, its least doc_id."""
    distinct = checkpointed(each.groupBy("bits").agg(F.min("doc_id").alias("least")))
    groups = components(links(distinct.select("bits"), radius, bucket))
    labelled = distinct.join(groups, distinct["bits"] == groups["node"], "left")
    labelled = labelled.select("bits", "least", F.coalesce("component", "bits").alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return each.join(labelled.join(least, "component").select("bits", "component", "component_id"), "bits")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, bits, component_id) of every document: component_id is the least doc_id that links lead to."""
    return _grouped(staged(fingerprints(docs, width)), radius, bucket).select("doc_id", "bits", "component_id")


def bits_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), BITS // 4, "0"))


def keep_one(docs: DataFrame, width: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Documents without near-duplicates: of each component the row with the least (doc_id, text hash) stays, one of equal
    rows. Rows without doc_id stay."""
    each = staged(fingerprints(docs, width, hashes=True))
    return one_row_each(docs, _grouped(each, radius, bucket).select("doc_id", "text_hash", "component"))
