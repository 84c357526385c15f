"""Ranked lexical search by dense blocked multiplication.

A query item's terms weigh floor(1000 ln((2N + 2) / (2 df + 1))); a document holds a term with an impact that grows with its
frequency and falls with the document's length. Scores are then one product: tiles of items by terms times tiles of terms
by documents, in float64 through BLAS. Weights and impacts are whole numbers, and the greatest sum that a tile of terms can
reach is held below 2^53 before it is multiplied (a tile is cut until it is), so every partial sum is exact whatever order
BLAS takes; tiles are added up as 64-bit integers. Of each product a task keeps the k best by (score descending, doc_id
ascending): whatever reaches the k-th score so far is sorted again, ties included, so none is lost at a tile's edge.

Items go in blocks of at most ITEMS with at most TERMS terms (an item with more is a block by itself), each against all
documents: one pass counts the block's vocabulary in whole texts and is stored, statistics come from it, a second pass
multiplies. What a block broadcasts is bounded by these two numbers.

Terms are the longest runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z become lower-case. Null
and empty texts have no terms and count in no statistic. Rows that repeat are ranked each for itself; documents without
doc_id count in the statistics but are not ranked. Items equal in id and text count once; an item without terms, or whose
terms no document holds, gets no rows; a null item_id is an id. Without documents there are no rows. Further columns are
not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenlake.llm.common import staged, with_code
from listenlake.llm.numbering import numbered

ITEMS, TERMS = 256, 32_768
TILE = 4096  # terms of a tile
FINE = 32  # items that are put into a block together
SALTS = 64
EXACT = 1 << 53

#: The bytes of a text, with a blank for each that is no part of a term, and A-Z lower-case.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | bytes | None) -> list[bytes]:
    raw = text.encode() if isinstance(text, str) else text or b""
    return raw.translate(LETTERS).split()


class Codes(dict):
    """Code of each term of a vocabulary; that of all others is the number of terms."""

    def __init__(self, vocabulary: list[bytes]):
        super().__init__(zip(vocabulary, range(len(vocabulary))))
        self.other = len(vocabulary)

    def __missing__(self, term: bytes) -> int:
        return self.other


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def lengths(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The part of a document's length in its impacts: 10 and 90 times its length by the average."""
    if len(n) and 90 * int(n.max()) * documents >= 1 << 63:
        return np.array([10 + 90 * int(x) * documents // total for x in n], np.int64)
    return 10 + 90 * n * documents // total


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Best:
    """The k best documents of each item: score descending, then doc_id ascending."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.bar = np.ones(items, np.int64)
        self.item = self.doc = self.score = np.zeros(0, np.int64)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """scores: documents by items. A score below the bar can't be among the k best; one that equals it may be."""
        row, item = np.nonzero(scores >= self.bar)
        if not len(row):
            return
        item = np.concatenate([self.item, item])
        doc = np.concatenate([self.doc, docs[row]])
        score = np.concatenate([self.score, scores[row, item[len(self.item) :]]])
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        keep = place < self.k
        self.item, self.doc, self.score = item[keep], doc[keep], score[keep]
        full = place == self.k - 1
        self.bar[item[full]] = score[full]


def tiles(matrix: np.ndarray, highest: int, width: int = TILE) -> list[tuple[int, int]]:
    """Ranges of columns (terms) of at most `width`, halved until no item's sum can reach 2^53."""
    out, todo = [], [(a, min(a + width, matrix.shape[1])) for a in range(0, matrix.shape[1], width)]
    while todo:
        a, b = todo.pop()
        if b - a > 1 and int(matrix[:, a:b].sum(axis=1).max()) * highest >= EXACT:
            todo += [(a, (a + b) // 2), ((a + b) // 2, b)]
        else:
            out.append((a, b))
    return sorted(out)


def products(offsets: np.ndarray, codes: np.ndarray, values: np.ndarray, parts: list) -> np.ndarray:
    """Scores of documents by items. Document i holds codes[offsets[i]:offsets[i + 1]] with the impacts `values`; parts:
    (first code, code behind the last, float64 matrix of terms by items)."""
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = 0
    for a, b, matrix in parts:
        own = (codes >= a) & (codes < b)
        dense = np.zeros((len(offsets) - 1, b - a))
        dense[rows[own], codes[own] - a] = values[own]
        out = out + (dense @ matrix).astype(np.int64)
    return out


def _counted(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, codes, tfs): terms of a document, and those of the vocabulary with their frequencies."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes(known.value)
        width = codes.other + 1
        for batch in batches:
            words = [terms(t) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            n = np.fromiter(map(len, words), np.int64, len(words))
            flat = np.fromiter((codes[w] for ws in words for w in ws), np.int64, int(n.sum()))
            keys = np.repeat(np.arange(len(words)) * width, n) + flat
            keys, tfs = np.unique(keys[flat < codes.other], return_counts=True)
            ends = np.searchsorted(keys, np.arange(len(words) + 1) * width).astype(np.int32)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), lists((keys % width).astype(np.int32)), lists(tfs.astype(np.int64))],
                names=["doc_id", "n", "codes", "tfs"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(rows.mapInArrow(over, "doc_id bigint, n bigint, codes array<int>, tfs array<bigint>"))


def _block(docs: DataFrame, wanted: list, k: int) -> DataFrame | None:
    """(number, salt, doc_id, score): the k best of each task for the items in wanted, rows of (number, terms)."""
    vocabulary = sorted({bytes(t) for row in wanted for t in row["terms"]})
    if not vocabulary:
        return None
    counted = _counted(docs, vocabulary)
    total = counted.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    documents, length = int(total[0]), int(total[1] or 0)
    if not documents:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for code, count in counted.select(F.explode("codes").alias("code")).groupBy("code").count().collect():
        df[code] = count
    weight = weights(df, documents)
    useful = (df > 0) & (weight > 0)
    place = np.where(useful, np.cumsum(useful) - 1, -1)
    codes = Codes(vocabulary)
    matrix = np.zeros((len(wanted), int(useful.sum())), np.int64)
    for i, row in enumerate(wanted):
        own = np.array([codes[bytes(t)] for t in row["terms"]], np.int64)
        own = own[useful[own]]
        matrix[i, place[own]] = weight[own]
    sent = docs.sparkSession.sparkContext.broadcast((place, matrix, [row["number"] for row in wanted]))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, matrix, numbers = sent.value
        parts = [(a, b, matrix[:, a:b].T.astype(np.float64)) for a, b in tiles(matrix, highest=1_000_000)]
        best = Best(len(numbers), k)
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            if not batch.num_rows:
                continue
            lists, tfs = batch.column(2), batch.column(3).flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            rows = np.repeat(np.arange(len(sizes)), sizes)
            m = lengths(batch.column(1).to_numpy(), documents, length)
            code = place[lists.flatten().to_numpy()]
            own = code >= 0
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows[own], minlength=len(sizes)))])
            values = impacts(tfs[own], m[rows[own]])
            if parts:
                best.add(batch.column(0).to_numpy(), products(ends, code[own], values, parts))
        salt = TaskContext.get().partitionId() % SALTS
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.array(numbers, np.int64)[best.item]),
                pa.array(np.full(len(best.item), salt, np.int32)),
                pa.array(best.doc),
                pa.array(best.score),
            ],
            names=["number", "salt", "doc_id", "score"],
        )

    return counted.mapInArrow(over, "number bigint, salt int, doc_id bigint, score bigint")


def _blocks(items: DataFrame, most_items: int, most_terms: int) -> list[tuple[int, int]]:
    """Ranges of item numbers, from the sizes of groups of FINE items."""
    by = F.floor(F.col("number") / FINE).alias("group")
    sizes = items.groupBy(by).agg(F.count("*").alias("items"), F.sum(F.size("terms")).alias("terms")).orderBy("group")
    out: list[list[int]] = []
    for row in sizes.toLocalIterator():
        first, last = row["group"] * FINE, row["group"] * FINE + FINE
        if out and out[-1][2] + row["items"] <= most_items and out[-1][3] + row["terms"] <= most_terms:
            out[-1][1], out[-1][2], out[-1][3] = last, out[-1][2] + row["items"], out[-1][3] + row["terms"]
        elif row["terms"] <= most_terms:
            out.append([first, last, row["items"], row["terms"]])
        else:
            out += [[i, i + 1, most_items, most_terms] for i in range(first, last)]
    return [(a, b) for a, b, _, _ in out]


def search(docs: DataFrame, items: DataFrame, k: int = 10, most_items: int = ITEMS, most_terms: int = TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item. docs: doc_id, text; items: item_id, text."""
    spark = with_code(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.binary()))], names=["item_id", "text", "terms"])

    distinct = items.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    kind = distinct.schema["item_id"].dataType.simpleString()
    listed = staged(distinct.mapInArrow(split, f"item_id {kind}, text string, terms array<binary>").withColumn("all", F.lit(0)))
    listed = staged(numbered(listed, "all", ["item_id", "text"]).select(F.col("at").alias("number"), "item_id", "terms"))
    best = spark.createDataFrame([], "number bigint, salt int, doc_id bigint, score bigint")
    for a, b in _blocks(listed, most_items, most_terms):
        found = _block(docs, listed.filter(F.col("number").between(a, b - 1)).orderBy("number").collect(), k)
        best = best if found is None else best.unionByName(found)
    order = [F.col("score").desc(), F.col("doc_id")]
    first = F.row_number().over(Window.partitionBy("number", "salt").orderBy(*order))
    best = best.withColumn("_first", first).filter(F.col("_first") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("number").orderBy(*order))).filter(F.col("rank") <= k)
    return best.join(listed.select("number", "item_id"), "number").select("item_id", "rank", "doc_id", "score")
