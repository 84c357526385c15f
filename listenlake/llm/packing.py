"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token sequences (ids, then the end id 0); only those longer than a sequence are cut. Pieces are dealt at
random into shards of bounded size. A shard lives on several islands, each a population of packings; in a round, an island
breeds some generations. A child takes whole well-filled bins of one parent into the other, bins that would hold a piece
twice are dissolved, and their displaced pieces are placed best-fit, largest first. After a round each island gets the
elite of its neighbour. The best packing of a shard stays; the pieces of its ill-filled bins of all shards are packed
again together, as long as that saves sequences.

Only lengths travel between tasks, never texts. Everything is seeded by shard, island and round, so that a task which is
run again makes the same rows. Null and empty texts are one piece of one token. Rows that repeat are packed each for
itself. An empty table gives no rows. Extra columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenlake.llm.common import checkpointed, lean, staged, texts
from listenlake.llm.word_tokens import default_path, in_groups, tokenizer

CAPACITY = 2048
SHARD = 4096  # pieces in a shard, on average
ISLANDS, ROUNDS, GENERATIONS, POPULATION = 2, 2, 6, 6
WELL_FILLED = 0.985  # a bin of this fill is worth passing on; one below ILL_FILLED is dissolved at the end
ILL_FILLED = 0.97
LEVELS = 4

PIECES = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's token sequence, cut where it is too long."""
    path = path or default_path()
    rows = texts(docs)
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PIECES}"

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for at, group in in_groups(batch.column(1).to_pylist()):
                whose, number, start, length, crc = [], [], [], [], []
                for i, ids in enumerate(tok.encode(group), at):
                    ids += b"\0\0\0\0"
                    for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[a : a + 4 * capacity]
                        whose.append(i)
                        number.append(k)
                        start.append(a // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(whose, pa.int64())),
                        pa.array(number, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return rows.mapInArrow(lean(over), schema)


# ---- packings of one shard: arrays `bin_of` (bin of each piece) and nothing else


class Gaps:
    """Bins by what is free in them; a bit set finds the least gap that is wide enough."""

    def __init__(self, capacity: int):
        self.free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0

    def add(self, b: int, gap: int) -> None:
        if gap:
            self.free[gap].append(b)
            self.bits |= 1 << gap

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least gap of at least `size`, and that gap."""
        wide = self.bits >> size
        if not wide:
            return None
        gap = size + (wide & -wide).bit_length() - 1
        b = self.free[gap].pop()
        if not self.free[gap]:
            self.bits ^= 1 << gap
        return b, gap


def best_fit(sizes: list[int], order, bin_of: np.ndarray, gaps: Gaps, bins: int, capacity: int) -> int:
    """Places the pieces in the order given; returns the number of bins, new ones included."""
    for i in order:
        s = sizes[i]
        found = gaps.take(s)
        if found is None:
            b, gap, bins = bins, capacity, bins + 1
        else:
            b, gap = found
        bin_of[i] = b
        gaps.add(b, gap - s)
    return bins


def renumbered(bin_of: np.ndarray) -> np.ndarray:
    return np.unique(bin_of, return_inverse=True)[1].astype(np.int32)


def fitness(sizes: np.ndarray, bin_of: np.ndarray, capacity: int) -> float:
    """Mean squared fill of the bins: more is better, and full bins beside empty ones beat half-full ones."""
    fill = np.bincount(bin_of, weights=sizes) / capacity
    return float(np.mean(fill * fill)) if len(fill) else 1.0


def founder(sizes: np.ndarray, rng: np.random.Generator, noise: float, capacity: int) -> np.ndarray:
    """Best fit of the pieces, largest first, sizes blurred by `noise`."""
    order = np.argsort(-(sizes * (1 + noise * rng.standard_normal(len(sizes)))), kind="stable").tolist()
    bin_of = np.zeros(len(sizes), np.int32)
    best_fit(sizes.tolist(), order, bin_of, Gaps(capacity), 0, capacity)
    return bin_of


def crossed(sizes: np.ndarray, into: np.ndarray, other: np.ndarray, rng: np.random.Generator, capacity: int) -> np.ndarray:
    """A child: a random part of the other's well-filled bins, whole, and what they leave of `into`."""
    fill = np.bincount(other, weights=sizes)
    well = np.flatnonzero(fill >= WELL_FILLED * capacity)
    passed = np.zeros(len(fill), bool)
    passed[well[rng.random(len(well)) < rng.uniform(0.05, 0.25)]] = True
    injected = passed[other]
    own = np.bincount(into, weights=sizes)
    dissolved = np.zeros(len(own), bool)
    dissolved[into[injected]] = True
    # The worst of the other bins are dissolved too, so that their pieces may fill gaps.
    worst = rng.random(len(own)) < 0.5 * (own < ILL_FILLED * capacity)
    dissolved |= worst
    child = into.copy()
    child[injected] = other[injected] + len(own)
    displaced = np.flatnonzero(dissolved[into] & ~injected)
    gaps = Gaps(capacity)
    for b in np.flatnonzero(~dissolved & (own > 0) & (own < capacity)).tolist():
        gaps.add(b, capacity - int(own[b]))
    for b in np.flatnonzero(passed & (fill < capacity)).tolist():
        gaps.add(b + len(own), capacity - int(fill[b]))
    order = displaced[np.argsort(-sizes[displaced], kind="stable")].tolist()
    best_fit(sizes.tolist(), order, child, gaps, len(own) + len(fill), capacity)
    return renumbered(child)


def evolved(sizes: np.ndarray, guests: list[np.ndarray], seed: int, generations: int, population: int, capacity: int):
    """Packings after some generations, best first. guests: packings to begin with, beside founders."""
    rng = np.random.default_rng(seed)
    living = [np.asarray(g, np.int32) for g in guests]
    while len(living) < population:
        noise = 0.0 if not living else float(rng.choice([0.02, 0.05, 0.1, 0.2]))
        living.append(founder(sizes, rng, noise, capacity))
    rated = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(living)), key=lambda r: (-r[0], r[1]))
    born = len(rated)
    least = -(-int(sizes.sum()) // capacity)
    for _ in range(generations):
        if int(rated[0][2].max(initial=-1)) + 1 <= least:
            break
        children = []
        for _ in range(population // 2):
            a, b = rng.choice(len(rated), 2, replace=False) if len(rated) > 1 else (0, 0)
            child = crossed(sizes, rated[min(a, b)][2], rated[max(a, b)][2], rng, capacity)
            children.append((fitness(sizes, child, capacity), born, child))
            born += 1
        rated = sorted([*rated, *children], key=lambda r: (-r[0], r[1]))[:population]
    return [(f, p) for f, _, p in rated]


def _seed(*parts: int) -> int:
    return zlib.crc32(repr(parts).encode())


ISLAND = "shard int, island int, uids binary, sizes binary, best double, elite array<binary>"


def _bred(islands: DataFrame, round_: int, level: int, capacity: int, kept: int) -> DataFrame:
    """Each island after a round: its best packings, best first."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                sizes = np.frombuffer(r.sizes, "<i4").astype(np.int64)
                guests = [np.frombuffer(e, "<i4") for e in r.elite]
                seed = _seed(r.shard, r.island, round_, level)
                made = evolved(sizes, guests, seed, GENERATIONS, POPULATION, capacity)[:kept]
                rows.append((r.shard, r.island, r.uids, r.sizes, made[0][0], [p.astype("<i4").tobytes() for _, p in made]))
            yield pd.DataFrame(rows, columns=["shard", "island", "uids", "sizes", "best", "elite"])

    return islands.mapInPandas(lean(over), ISLAND)


def _packed_once(items: DataFrame, shards: int, level: int, capacity: int) -> DataFrame:
    """(shard, uid, size, bin, fill) of (uid, size): each shard by its islands."""
    spark = items.sparkSession
    seed = F.pmod(F.xxhash64(F.col("uid"), F.lit(level)), F.lit(shards)).cast("int")
    width = max(1, min(shards * ISLANDS, 4096))

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("uid")
        none: list[bytes] = []
        return pd.DataFrame(
            {
                "shard": [frame["shard"].iloc[0]],
                "island": [0],
                "uids": [frame["uid"].to_numpy("<i8").tobytes()],
                "sizes": [frame["size"].to_numpy("<i4").tobytes()],
                "best": [0.0],
                "elite": [none],
            }
        )

    homes = items.select(seed.alias("shard"), "uid", "size").groupBy("shard").applyInPandas(gather, ISLAND)
    islands = homes.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])))
    islands = checkpointed(_bred(islands.repartition(width, "shard", "island"), 0, level, capacity, 3))
    for r in range(1, ROUNDS):
        guests = islands.select(
            "shard",
            F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"),
            F.slice("elite", 1, 2).alias("guests"),
        )
        met = islands.join(guests, ["shard", "island"]).withColumn("elite", F.concat("elite", "guests")).drop("guests")
        islands = checkpointed(_bred(met.repartition(width, "shard", "island"), r, level, capacity, 3))
    best = islands.withColumn("elite", F.slice("elite", 1, 1)).groupBy("shard").agg(
        F.max_by(F.struct("uids", "sizes", "elite"), F.struct("best", -F.col("island"))).alias("b")
    )

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard, uids, sizes, elite in frame.itertuples(index=False):
                sizes = np.frombuffer(sizes, "<i4")
                bins = np.frombuffer(elite[0], "<i4")
                yield pd.DataFrame(
                    {
                        "shard": np.full(len(bins), shard, np.int32),
                        "uid": np.frombuffer(uids, "<i8"),
                        "size": sizes,
                        "bin": bins,
                        "fill": np.bincount(bins, weights=sizes).astype(np.int64)[bins],
                    }
                )

    return best.select("shard", "b.uids", "b.sizes", "b.elite").mapInPandas(
        rows, "shard int, uid bigint, size int, bin int, fill bigint"
    )


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """(uid, sequence_id, offset) of (uid bigint, distinct; size int, 1 to capacity): places in as few sequences as the
    islands find. Pieces that fill a sequence take one each and don't take part."""
    spark = items.sparkSession
    full = items.filter(F.col("size") >= capacity).select("uid", F.col("uid").alias("home"), F.lit(-1).alias("level"), "size", F.lit(0).alias("bin"))
    left = items.filter(F.col("size") < capacity).select("uid", F.col("size").cast("int").alias("size"))
    kept = [full.select("level", F.col("home").alias("shard"), "bin", "uid", "size")]
    before = None
    for level in range(LEVELS):
        count = left.count()
        if count == 0:
            break
        shards = -(-count // shard)
        packed = checkpointed(_packed_once(left, shards, level, capacity))
        last = shards == 1 or level == LEVELS - 1 or (before is not None and count > before // 2)
        good = packed if last else packed.filter(F.col("fill") >= ILL_FILLED * capacity)
        kept.append(good.select(F.lit(level).alias("level"), F.col("shard").cast("long").alias("shard"), "bin", "uid", "size"))
        if last:
            break
        left, before = packed.filter(F.col("fill") < ILL_FILLED * capacity).select("uid", "size"), count
    placed = kept[0]
    for more in kept[1:]:
        placed = placed.unionByName(more)
    # One number for (level, shard, bin): full pieces are told by their uid, the others by level, shard and bin.
    sequence = F.when(F.col("level") < 0, -F.col("shard") - 1).otherwise(
        F.shiftleft(F.col("level").cast("long"), 58) + F.shiftleft(F.col("shard"), 20) + F.col("bin")
    )
    placed = placed.select("uid", "size", sequence.alias("sequence_id"))
    order = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("size").over(order), F.lit(0)).cast("long")
    return placed.select("uid", "sequence_id", offset.alias("offset"))


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Every piece of every document with its place: pieces()' columns, sequence_id, offset."""
    made = pieces(docs, path, capacity)
    numbered = staged(made.withColumn("_uid", F.monotonically_increasing_id()))
    places = pack(numbered.select(F.col("_uid").alias("uid"), F.col("length").cast("int").alias("size")), capacity)
    placed = numbered.join(places.withColumnRenamed("uid", "_uid"), "_uid")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
