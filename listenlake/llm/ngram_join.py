"""Jaccard join of word shingles, exact, by vertical partitioning.

A document's set holds the 64-bit hashes of its distinct shingles of WIDTH words (fewer words: one shingle of all; none: an
empty set, linked with nothing). Sets link if 100 * common >= SIMILARITY * all. Equal sets are one set from the start, so
copies cost one row each. All shingles have one global order: by hash, and the frequent ones behind all others, by
frequency. The order is cut into fragments. Each pair's common shingles are counted in every fragment by itself, from the
segments of both sets that lie there, and the counts are added up; no set travels whole.

Which pairs are counted: two sets that link share a shingle among the first n - ceil(SIMILARITY * n / 100) + 1 of either
(their heads, in the global order). Shingles of more than `frequent` documents are found by counting all shingles of all
texts, also by fragments, with counts added up within a task first. So the list of sets with one shingle in their head is
short for all but the frequent ones, which stand in the heads only of sets that hold little else.

    1. In each list all sets are paired with the least; pairs that link give components. Each set first meets the least of
       all its partners, then those of another component.
    2. Lists whose sets lie in one component are done. In short lists the sets of different components are compared. Lists
       of frequent shingles with a set in common form a cluster, in which each set is one row however many lists it is in;
       blocks of a cluster's sets outside its largest component are compared with one another and with all of that.
    3. Comparisons go by parity bits of the sets: each differing bit is a shingle that one set lacks, so the bits give an
       upper bound for the common shingles that loses no pair. What passes is counted. Of clusters first FEW partners a
       set and task are counted, and the components joined; the rest then, which by then is little.

So every pair of different components is either excluded by an exact bound or counted, and no group is expanded into all
pairs. A cluster of m sets that stay apart takes m * m / BLOCK rows; it takes sets of which four fifths are frequent
shingles and which still don't link.

At most HOT frequent shingles are told to the tasks (16 bytes each); with more, the bound is raised, which costs longer
lists and no links. Set ids have 64 bits: of 10^10 different sets about three pairs are taken for equal.

Null texts count as empty. Rows that repeat and rows of one doc_id are documents each for itself; rows without doc_id take
part, and component_id is the least doc_id reachable, null only where there is none. An empty table gives no rows. Columns
other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import TASK_ROWS, checkpointed, gathered, lean, staged, text_hash, texts, with_code
from listenlake.llm.components import components

WIDTH, SIMILARITY = 5, 80
FREQUENT = 64
HOT = 1_000_000
SEGMENTS = 4  # fragments of the order for common shingles
COUNTED = 1_000_000  # shingles of a fragment of the counts, which one task adds up in memory
CHUNK = 1_000_000  # shingles that a task counts together
BLOCK = 1024
FEW = 4
HEAVY = 4  # rows with bits or hashes count as so many of a few longs
SMALL = 500_000  # so many rows of three longs, 12 MB, may be broadcast
SALTS = 4096
SHARE = 256  # members of a head that count as one task's work

_draw = np.random.default_rng(42)
TIMES = _draw.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Powers:
    """Powers of an odd number modulo 2^64, and of its inverse."""

    BASE = int(TIMES[-3])

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            self.up, self.down = (np.full(size, x, np.uint64) for x in (self.BASE, pow(self.BASE, -1, 1 << 64)))
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up, self.down


_powers = _Powers()
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
LETTERS = _draw.integers(0, 1 << 64, 256, dtype=np.uint64)
LETTERS[65:91] = LETTERS[97:123]


def _mixed(values: np.ndarray) -> np.ndarray:
    for shift, times in ((33, TIMES[-1]), (29, TIMES[-2])):
        values = (values ^ (values >> np.uint64(shift))) * times
    return values ^ (values >> np.uint64(32))


def _word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in UTF-8 texts that follow one another and end at `ends`, and the number of words up to each end.
    A word's hash is a polynomial of its letters: a difference of two sums over all letters before, moved to place 0."""
    up, down = _powers.upto(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * up[: len(data)], out=sums[1:])
    inside = ~SPACES[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[0] = edge[ends] = True
    starts = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate([[False], inside[:-1]])))
    stops = np.flatnonzero(inside & (edge[1:] | ~np.concatenate([inside[1:], [False]]))) + 1
    return _mixed((sums[stops] - sums[starts]) * down[starts]), np.searchsorted(starts, ends)


def _shingled(data: np.ndarray, ends: np.ndarray, width: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order."""
    h, upto = _word_hashes(data, ends)
    every = np.zeros(max(0, len(h) - width + 1), np.uint64)
    for j in range(width if len(every) else 0):
        every += h[j : len(h) - width + 1 + j] * TIMES[j]
    every = _mixed(every + np.uint64(width))
    out, first = [], 0
    for last in upto.tolist():
        if last - first >= width:
            own = every[first : last - width + 1]
        else:
            own = (h[first:last] * TIMES[: last - first]).sum(keepdims=True, dtype=np.uint64) + np.uint64(last - first)
            own = _mixed(own) if last > first else own[:0]
        own = np.sort(own)
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own)
        first = last
    return out


def shingle_sets(column: pa.Array, width: int = WIDTH, most: int = 250_000) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text of a column, worked out for about `most` bytes at a time."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        part = data[offsets[first] : offsets[last]]
        with np.errstate(over="ignore"):
            yield from _shingled(part, offsets[first + 1 : last + 1] - offsets[first], width)
        first = last


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    return next(shingle_sets(pa.array([text or ""]), width))


def head_length(n: int, similarity: int) -> int:
    return n - -(-similarity * n // 100) + 1


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each of as many places as the set has shingles (the next power of two) whether an odd number falls there."""
    width = max(128, 1 << (len(hashes) - 1).bit_length())
    return np.packbits(np.bincount((hashes & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The parity bits of the same set for `size` bytes."""
    return bits if len(bits) == size else np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def possible(
    n: np.ndarray, of: np.ndarray, bits: list[np.ndarray], similarity: int, few: int | None = None, side: np.ndarray | None = None
) -> Iterator[tuple]:
    """(i, places) of members i and those larger ones of another component that may link with it, at most `few`; with sides,
    of the other side alone (-1: of all)."""
    side = np.full(len(n), -1) if side is None else side
    size = np.array([len(b) for b in bits])
    order = np.lexsort((np.arange(len(n)), n))
    n, of, size, side, bits = n[order], of[order], size[order], side[order], [bits[k] for k in order]
    for width in np.unique(size):
        near = np.flatnonzero((size == width) | (size == 2 * width))
        level = np.stack([folded(bits[k], width) for k in near])
        for i in np.flatnonzero(size == width):
            later = np.searchsorted(near, i, side="right")
            stop = np.searchsorted(n[near], 100 * n[i] // similarity, side="right")
            if later >= stop:
                continue
            other = near[later:stop]
            apart = (of[other] != of[i]) & ((side[other] != side[i]) | (side[i] < 0))
            other, rows = other[apart], level[later:stop][apart]
            if len(other):
                differ = np.bitwise_count(rows ^ level[np.searchsorted(near, i)]).sum(axis=1, dtype=np.int64)
                other = other[differ * (100 + similarity) <= (n[other] + n[i]) * (100 - similarity)][:few]
                if len(other):
                    yield order[i], order[other]


# ---- passes over the texts


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, text_hash, id, n, bits) of every document: id names its set, bits are its parities."""
    rows = texts(docs, text_hash().alias("text_hash"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), width))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([parity(s).tobytes() if len(s) else b"" for s in sets], pa.binary()),
                ],
                names=["doc_id", "text_hash", "id", "n", "bits"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return staged(rows.mapInArrow(lean(over), f"doc_id {kind}, text_hash bigint, id bigint, n bigint, bits binary"))


def keys(hashes: np.ndarray, fragments: int) -> np.ndarray:
    """Fragment of a shingle and 32 bits that tell it from others there. Two shingles may share a key (one in a thousand does,
    at any size): they then count as one in frequencies, on which only the order rests."""
    fragment = ((hashes >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)
    return fragment << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)


def _frequencies(docs: DataFrame, width: int, fragments: int, more_than: int) -> DataFrame:
    """(key, df) of the shingles of more documents than that."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for hashes in shingle_sets(batch.column(0), width):
                held.append(keys(hashes, fragments))
                size += len(held[-1])
                if size >= CHUNK:
                    yield from _packed(held)
                    held, size = [], 0
        if size:
            yield from _packed(held)

    def added(table: pa.Table) -> pa.Table:
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), "<u4")
        times = np.frombuffer(b"".join(table.column("times").to_pylist()), "<u4")
        both = low.astype(np.uint64) << np.uint64(32) | times
        both.sort()
        low, times = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        starts = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]])) if len(low) else np.zeros(0, np.int64)
        df = np.add.reduceat(times.astype(np.int64), starts) if len(low) else np.zeros(0, np.int64)
        keep = df > more_than
        fragment = table.column("fragment")[0].as_py()
        key = (np.int64(fragment) << 32) | low[starts][keep].astype(np.int64)
        return pa.table({"key": pa.array(key), "df": pa.array(df[keep])})

    rows = texts(docs).select("text").mapInArrow(lean(counted), "fragment int, low binary, times binary")
    found = rows.groupBy("fragment").applyInArrow(added, "key bigint, df bigint")
    return checkpointed(gathered(found, fragments * TASK_ROWS))


def _packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The keys of some documents with their counts, a row for each fragment."""
    values, times = np.unique(np.concatenate(held), return_counts=True)
    fragment = (values >> np.uint64(32)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]]))
    stops = [*starts[1:], len(values)]
    low, times = values.astype("<u4"), times.astype("<u4")
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([int(fragment[a]) for a in starts], pa.int32()),
            pa.array([low[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary()),
            pa.array([times[a:b].tobytes() for a, b in zip(starts, stops)], pa.binary()),
        ],
        names=["fragment", "low", "times"],
    )


class Order:
    """The global order: frequent shingles (keys, ascending, and their frequencies) come last, by frequency."""

    def __init__(self, key: np.ndarray, df: np.ndarray, fragments: int):
        self.key, self.df, self.fragments = key, df, fragments

    def _place(self, hashes: np.ndarray) -> np.ndarray:
        """Place among the frequent ones; -1 for others."""
        if not len(self.key):
            return np.full(len(hashes), -1)
        own = keys(hashes, self.fragments)
        at = np.minimum(np.searchsorted(self.key, own), len(self.key) - 1)
        return np.where(self.key[at] == own, at, -1)

    def head(self, hashes: np.ndarray, similarity: int) -> tuple[np.ndarray, np.ndarray]:
        """The first shingles of a set that decide on its partners: those of few documents, and frequent ones."""
        want = head_length(len(hashes), similarity)
        first = hashes[: 2 * want + 8]
        rare = first[self._place(first) < 0]
        if len(rare) >= want or len(first) == len(hashes):
            place = self._place(first)
        else:
            first, place = hashes, self._place(hashes)
            rare = first[place < 0]
        if len(rare) >= want:
            return rare[:want], rare[:0]
        often, df = first[place >= 0], self.df[place[place >= 0]]
        return rare, often[np.lexsort((often, df))[: want - len(rare)]]


def _heads(docs: DataFrame, width: int, similarity: int, order) -> DataFrame:
    """(token, salt, id): the shingles in the heads of all sets. Frequent ones have a salt from 1 on, others 0."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, ids, salts = [], [], []
            seen: set[int] = set()
            for hashes in shingle_sets(batch.column(0), width):
                name = xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)
                if not len(hashes) or name in seen:
                    continue
                seen.add(name)
                for part, salt in zip(order.value.head(hashes, similarity), (0, 1 + name % SALTS)):
                    tokens.append(part)
                    ids.append(np.full(len(part), name, np.int64))
                    salts.append(np.full(len(part), salt, np.int32))
            join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
            yield pa.RecordBatch.from_arrays(
                [pa.array(join(tokens, np.uint64).view(np.int64)), pa.array(join(salts, np.int32)), pa.array(join(ids, np.int64))],
                names=["token", "salt", "id"],
            )

    return texts(docs).select("text").mapInArrow(lean(over), "token bigint, salt int, id bigint")


# ---- lists of sets that share a shingle of their heads


def _ended(batches):
    yield from batches
    yield None


def _lists(rows: DataFrame, about: int) -> DataFrame:
    """(token, frequent, ids) of the sets with one shingle in their heads; of shingles that are not frequent only where there
    are two or more. The rows of a shingle and salt are neighbours, and a list of frequent ones is in one row for each salt. about: a
    measure of the rows, by which tasks are made."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, np.int64)] * 3
        for batch in _ended(batches):
            if batch is None:
                token, salt, ids = rest
                stop = len(token)
            else:
                token, salt, ids = (np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns))
                ends = np.flatnonzero((token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))
                stop = int(ends[-1]) + 1 if len(ends) else 0
            rest = [token[stop:], salt[stop:], ids[stop:]]
            token, salt, ids = token[:stop], salt[:stop], ids[:stop]
            if not stop:
                continue
            new = np.concatenate([[True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])])
            fresh = new | np.concatenate([[True], ids[1:] != ids[:-1]])
            token, salt, ids, new = token[fresh], salt[fresh], ids[fresh], new[fresh]
            starts = np.flatnonzero(new)
            stops = np.append(starts[1:], len(token))
            keep = (stops - starts > 1) | (salt[starts] > 0)
            starts, stops = starts[keep], stops[keep]
            if len(starts):
                lists = [ids[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(token[starts]), pa.array(salt[starts] > 0), pa.array(lists, pa.list_(pa.int64()))],
                    names=["token", "frequent", "ids"],
                )

    near = rows.repartition("token", "salt").sortWithinPartitions("token", "salt", "id")
    return gathered(near, about).mapInArrow(lean(over), "token bigint, frequent boolean, ids array<bigint>")


def _little(df: DataFrame, most: int | None = None) -> tuple[DataFrame, int]:
    """A table of a few longs a row, of at most `most` rows, stored in no more partitions than it needs, to be broadcast if it
    is small; and its rows."""
    df = checkpointed(df if most is None else gathered(df, most))
    rows = df.count()
    df = gathered(df, rows)
    return (F.broadcast(df) if rows <= SMALL else df), rows


class Join:
    """What the steps share: the texts, and sets (id, n, bits, first)."""

    def __init__(self, docs: DataFrame, sets: DataFrame, width: int, similarity: int):
        self.docs, self.sets, self.width, self.similarity = docs, sets, width, similarity

    def _may_link(self, pairs: DataFrame, rows: int) -> tuple[DataFrame, int]:
        """(a, b, size): pairs whose sizes and parities allow a link; size is that of both sets. And their number."""
        side = lambda s: self.sets.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}"))
        similarity = self.similarity

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for x, y, size in zip(*(batch.column(c).to_pylist() for c in ("bits_a", "bits_b", "size"))):
                    x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                    least = min(len(x), len(y))
                    differ = int(np.bitwise_count(folded(x, least) ^ folded(y, least)).sum())
                    keep.append(differ * (100 + similarity) <= size * (100 - similarity))
                yield batch.select(["a", "b", "size"]).filter(pa.array(keep, pa.bool_()))

        met = side("b").join(pairs, "b").join(side("a"), "a")
        least, most = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
        met = met.filter(least * 100 >= most * similarity).withColumn("size", F.col("n_a") + F.col("n_b"))
        met = gathered(met.select("a", "b", "size", "bits_a", "bits_b"), HEAVY * rows)
        return _little(met.mapInArrow(lean(over), "a bigint, b bigint, size bigint"), rows)

    def links(self, pairs: DataFrame) -> DataFrame:
        """(a, b) of the pairs that link: common shingles are counted in each fragment and added up. The segments of b go to
        those of a; an a with many partners is in several places."""
        pairs, many = _little(pairs)
        if many:
            pairs, many = self._may_link(pairs, many)
        if not many:
            return pairs.select("a", "b")
        degrees = pairs.groupBy("a").agg(F.least(F.lit(SALTS), F.ceil(F.count("*") / SHARE)).cast("int").alias("salts"))
        degrees, _ = _little(degrees, many)
        met = pairs.join(degrees, "a")
        to = lambda key, salt, member, size: F.struct(key.alias("a"), salt.alias("salt"), member.alias("b"), size.alias("size"))
        none = F.lit(None).cast("bigint")
        own = degrees.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        own = own.select(F.col("a").alias("id"), to(F.col("a"), F.col("salt"), none, none).alias("to"))
        other = to(F.col("a"), F.pmod(F.xxhash64("b"), "salts").cast("int"), F.col("b"), F.col("size"))
        each = gathered(own.unionByName(met.select(F.col("b").alias("id"), other.alias("to"))), 2 * many)  # a has a pair or more
        sent = each.groupBy("id").agg(F.collect_list("to").alias("to"))
        sent = F.broadcast(sent) if many <= SMALL else sent
        sent = checkpointed(self.sets.select("id", "first.doc_id", "first.text_hash").join(sent, "id"))
        rows = texts(self.docs, text_hash().alias("text_hash"))
        same = rows["doc_id"].eqNullSafe(sent["doc_id"]) & (rows["text_hash"] == sent["text_hash"])
        with_text = rows.join(F.broadcast(sent) if sent.count() <= SMALL else sent, same).select("id", "text", "to")
        width = self.width

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cuts = np.array([(f << 64) // SEGMENTS for f in range(1, SEGMENTS)], np.uint64)
            for batch in batches:
                out = [[] for _ in range(6)]
                for hashes, to in zip(shingle_sets(batch.column(1), width), batch.column(2).to_pylist()):
                    for f, part in enumerate(np.split(hashes, np.searchsorted(hashes, cuts))):
                        part = part.astype("<u8").tobytes()
                        for t in to:
                            for column, value in zip(out, (t["a"], t["salt"], f, t["b"], t["size"], part)):
                                column.append(value)
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                names = ["a", "salt", "fragment", "b", "size", "hashes"]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names=names)

        def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, head, last = None, None, None
            for batch in batches:
                out = [[] for _ in range(4)]
                for *at, b, size, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                    hashes = np.frombuffer(hashes, "<u8")
                    if b is None:
                        place, head = at, hashes
                        continue
                    if at != place:
                        raise RuntimeError(f"no segment of {at}")
                    if (at, b) == last:  # the set's first document is there twice
                        continue
                    last = (at, b)
                    both = len(np.intersect1d(head, hashes, assume_unique=True))
                    for column, value in zip(out, (at[0], b, size, both)):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["a", "b", "size", "common"])

        segments = with_text.mapInArrow(lean(cut), "a bigint, salt int, fragment int, b bigint, size bigint, hashes binary")
        near = segments.repartition("a", "salt", "fragment").sortWithinPartitions("a", "salt", "fragment", F.col("b").asc_nulls_first())
        parts = gathered(near, HEAVY * SEGMENTS * many).mapInArrow(lean(counted), "a bigint, b bigint, size bigint, common bigint")
        added = parts.groupBy("a", "b").agg(F.first("size").alias("size"), F.sum("common").alias("common"))
        enough = F.col("common") * (100 + self.similarity) >= F.col("size") * self.similarity
        return _little(added.filter(enough).select("a", "b"), many)[0]

    def compared(self, groups: DataFrame, few: int | None) -> DataFrame:
        """Distinct (a, b) of different components that may link. groups: members (id, component, n, bits, side)."""
        similarity = self.similarity

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                a, b = [], []
                for group in batch.column(0):
                    rows = group.as_py()
                    ids, of, n, side = (np.array([r[c] for r in rows], np.int64) for c in ("id", "component", "n", "side"))
                    bits = [np.frombuffer(r["bits"], np.uint8) for r in rows]
                    for i, other in possible(n, of, bits, similarity, few, side):
                        a.append(np.minimum(ids[other], ids[i]))
                        b.append(np.maximum(ids[other], ids[i]))
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], names=["a", "b"])

        return groups.select("members").mapInArrow(lean(over), "a bigint, b bigint").distinct()

    def placed(self, rows: DataFrame, known: DataFrame) -> DataFrame:
        """rows with the component of their id."""
        met = rows.join(known.withColumnRenamed("node", "id"), "id", "left")
        return met.withColumn("component", F.coalesce("component", "id"))

    def apart(self, pairs: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs (a, b) of different components."""
        side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"of_{c}"))
        met = pairs.join(side("b"), "b", "left").join(side("a"), "a", "left")
        return met.filter(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).select("a", "b")

    def near(self, clusters: DataFrame, short: DataFrame, known: DataFrame) -> DataFrame:
        return self.in_long(clusters, known, FEW).unionByName(self.in_short(short, known)).distinct()

    def in_short(self, lists: DataFrame, known: DataFrame) -> DataFrame:
        """Pairs of lists (list, ids) of few sets."""
        rows = self.placed(lists.filter(F.size("ids") > 2).select("list", F.explode("ids").alias("id")), known)
        # A list longer than a block (where the bound of frequent shingles was raised) is dealt out like those of frequent ones.
        return self._in_blocks(rows, None)

    def in_long(self, clusters: DataFrame, known: DataFrame, few: int | None) -> DataFrame:
        """Pairs of sets with frequent shingles in their heads; clusters: (cluster, id), one row a set."""
        return self._in_blocks(self.placed(clusters.withColumnRenamed("cluster", "list"), known), few)

    def _in_blocks(self, rows: DataFrame, few: int | None) -> DataFrame:
        """Pairs of the lists whose sets (list, id, component) lie in several components. Such a list's sets are dealt to blocks
        of about BLOCK: those of its largest component, and the others. The others' blocks meet one another and the first kind;
        a task compares two blocks."""
        mixed = rows.groupBy("list").agg(F.min("component").alias("one"), F.max("component").alias("other"))
        rows = rows.join(mixed.filter("one != other").select("list"), "list").select("list", "id", "component")
        rows, many = _little(rows)
        if not many:
            return rows.select(F.col("id").alias("a"), F.col("id").alias("b"))
        sizes = rows.groupBy("list", "component").agg(F.count("*").alias("rows"))
        lists = sizes.groupBy("list").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.max("rows").alias("most"), F.sum("rows").alias("all"))
        blocks = lambda n: F.ceil(n / BLOCK).cast("int")
        lists = lists.select("list", "main", blocks(F.col("most")).alias("mains"), blocks(F.col("all") - F.col("most")).alias("others"))
        met = rows.join(lists, "list")
        met = self.sets.select("id", "n", "bits").join(F.broadcast(met) if many <= SMALL else met, "id")
        outside = F.col("component") != F.col("main")
        met = met.withColumn("own", F.pmod(F.xxhash64("id"), F.when(outside, F.col("others")).otherwise(F.col("mains"))).cast("int"))
        upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        own = F.col("own")
        task = lambda i, j, k: F.struct(i.alias("i"), j.alias("j"), F.lit(k).alias("with_main"))
        to_others = F.transform(upto("others"), lambda j: task(F.least(own, j), F.greatest(own, j), False))
        to_mains = F.transform(upto("mains"), lambda j: task(own, j, True))
        from_main = F.transform(upto("others"), lambda i: task(i, own, True))
        tasks = F.explode(F.when(outside, F.concat(to_others, to_mains)).otherwise(from_main)).alias("task")
        dealt = met.select("list", tasks, "id", "component", "n", "bits", outside.alias("outside"), "own")
        side = F.when(F.col("task.with_main"), F.col("outside").cast("int")).when(F.expr("task.i = task.j"), -1)
        side = side.otherwise((F.col("own") == F.col("task.i")).cast("int"))
        member = F.struct("id", "component", "n", "bits", side.alias("side"))
        tasks = dealt.groupBy("list", "task").agg(F.collect_list(member).alias("members"))
        return self.compared(gathered(tasks, TASK_ROWS // BLOCK * many), few)


def _hot(found: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and frequencies of at most `most` shingles, the most frequent ones."""
    power = F.floor(F.log2("df")).alias("power")
    left, bound = most, 0
    for row in sorted(found.groupBy(power).count().collect(), reverse=True):
        if row["count"] > left:
            bound = 2 ** (row["power"] + 1)
            break
        left -= row["count"]
    kept = found.filter(F.col("df") >= bound).toPandas().sort_values("key")
    return kept["key"].to_numpy(np.int64).view(np.uint64), kept["df"].to_numpy(np.int64)


def linked(
    docs: DataFrame, width: int = WIDTH, similarity: int = SIMILARITY, frequent: int = FREQUENT, hot: int = HOT
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, id, n) of every document and (node, component) of the set ids that link with another."""
    spark = with_code(docs.sparkSession)
    each = _sets(docs, width)
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    sets = each.filter("n > 0").groupBy("id").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), first)
    rows, total = each.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sets = staged(gathered(sets, HEAVY * rows))
    fragments = max(1, -(-total // COUNTED))
    order = spark.sparkContext.broadcast(Order(*_hot(_frequencies(docs, width, fragments, frequent), hot), fragments))

    lists = staged(_lists(_heads(docs, width, similarity, order), total // HEAVY))
    short = lists.filter("NOT frequent").select(F.xxhash64("ids").alias("list"), "ids").dropDuplicates(["list"])
    short = checkpointed(gathered(short, total // HEAVY))
    listed = short.agg(F.sum(F.size("ids"))).first()[0] or 0
    short = gathered(short, listed)
    long = checkpointed(lists.filter("frequent").select("token", F.explode("ids").alias("id")).distinct())
    wider = long.count()
    long = gathered(long, wider)
    join = Join(docs, sets, width, similarity)

    star = short.select(F.get("ids", F.lit(0)).alias("a"), F.explode(F.slice("ids", 2, 1 << 30)).alias("b"))
    heads = long.groupBy("token").agg(F.min("id").alias("a"))  # at most HOT rows of two longs
    wide = long.join(F.broadcast(heads), "token").select("a", F.col("id").alias("b")).filter("a != b")
    wide = checkpointed(gathered(wide.distinct(), wider))
    star, _ = _little(star.unionByName(wide).distinct(), listed + wider)
    joined = components(wide).withColumnRenamed("node", "id").withColumnRenamed("component", "cluster")
    clusters = checkpointed(gathered(joined.select("cluster", "id"), 2 * wider))

    links = join.links(star.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    known, _ = _little(components(links))
    for step in (lambda: join.apart(star, known), lambda: join.near(clusters, short, known), lambda: join.in_long(clusters, known, None)):
        new = join.links(step())
        if not new.isEmpty():
            links = checkpointed(links.unionByName(new))
            links = gathered(links, links.count())
            known, _ = _little(components(links))
    return each.select("doc_id", "text_hash", "id", "n"), known


def near_documents(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    each, known = linked(docs, **options)
    least = each.filter("n > 0").groupBy("id").agg(F.min("doc_id").alias("least"))
    labelled = least.join(known.withColumnRenamed("node", "id"), "id", "left")
    labelled = labelled.select("id", "least", F.coalesce("component", "id").alias("component"))
    lowest = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = checkpointed(labelled.join(lowest, "component").select("id", "component_id"))
    own = each.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    met = each.filter("n > 0").join(named, "id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return met.unionByName(own)
