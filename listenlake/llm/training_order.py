"""Training order: token sequences in an order drawn by a key, in files of fixed stride.

Every document's ids, closed by the end id 0, follow one another as they lie in a partition of the stored table and are
cut into sequences of LENGTH tokens; only the last of a partition may be shorter. Sequences are stored once, compressed,
and counted by partition, so that each has a number from 0 to N - 1. A keyed Feistel network with cycle-walking permutes these numbers: each sequence
has its slot without any sort or draw, and the slot has its sequence by the inverse. Sequences are partitioned by ranges
of slots, and a range is one file of records of equal size, so that reading from any slot on is a seek and a sequential
read, and reading can be resumed at any slot.

A record: number of tokens (unsigned 32-bit), then LENGTH ids of 2 or 4 bytes, little-endian, 0 after the last one. A
file is written under another name and then moved, so a task that is run again leaves the same files.

Null and empty texts are the end id alone. Rows that repeat are written as often as they come. An empty table makes no
file. Extra columns are not looked at.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import staged, texts
from listenlake.llm.word_tokens import default_path, in_groups, tokenizer

LENGTH = 2048
PER_SHARD = 1024
KEY = 20240229
FEISTEL_ROUNDS = 6


class Permutation:
    """A keyed bijection of 0 .. n - 1."""

    def __init__(self, n: int, key: int):
        self.n = n
        self.half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = [self._mixed(np.array([key * 1_000_003 + r], np.uint64))[0] for r in range(FEISTEL_ROUNDS)]

    @staticmethod
    def _mixed(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            return x ^ (x >> np.uint64(31))

    def _f(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        with np.errstate(over="ignore"):
            return self._mixed(x * np.uint64(0x9E3779B97F4A7C15) + key) & self.mask

    def _once(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ self._f(right, key)
        return left << self.half | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ self._f(left, key), left
        return left << self.half | right

    def _walked(self, x, step) -> np.ndarray:
        out = step(np.asarray(x, np.uint64))
        while (far := out >= np.uint64(self.n)).any():
            out[far] = step(out[far])
        return out.astype(np.int64)

    def slots(self, numbers) -> np.ndarray:
        return self._walked(numbers, self._once) if len(numbers) else np.zeros(0, np.int64)

    def numbers(self, slots) -> np.ndarray:
        return self._walked(slots, self._back) if len(slots) else np.zeros(0, np.int64)


def _sequences(rows: DataFrame, path: str, length: int, width: int) -> DataFrame:
    """(part, place, n_tokens, ids_crc32, doc_ids, ids) of every sequence: its place in its partition; ids in `width` bytes
    each, compressed."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part, place = tokenizer(path), TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=3).compress
        buffer, owners = b"", []  # tokens not given out yet; (token where it ends, doc_id) of those in the buffer

        def cut(last: bool) -> pa.RecordBatch:
            nonlocal buffer, owners, place
            ids, docs = [], []
            at, total = 0, len(buffer) // 4
            o = 0
            while total - at >= length or (last and total > at):
                end = min(total, at + length)
                ids.append(buffer[4 * at : 4 * end])
                while owners[o][0] <= at:
                    o += 1
                whose, k = [], o
                while k < len(owners):
                    whose.append(owners[k][1])
                    if owners[k][0] >= end:
                        break
                    k += 1
                docs.append(whose)
                at = end
            buffer = buffer[4 * at :]
            owners = [(e - at, d) for e, d in owners if e > at]
            places = np.arange(place, place + len(ids), dtype=np.int64)
            place += len(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(ids), part, np.int64)),
                    pa.array(places),
                    pa.array([len(x) // 4 for x in ids], pa.int32()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array(docs, pa.list_(pa.int64())),
                    pa.array([pack(np.frombuffer(x, "<u4").astype(f"<u{width}").tobytes()) for x in ids], pa.binary()),
                ],
                names=["part", "place", "n_tokens", "ids_crc32", "doc_ids", "ids"],
            )

        for batch in batches:
            doc_ids = batch.column(1).to_pylist()
            for at, group in in_groups(batch.column(0).to_pylist(), 1_000_000):
                parts, end = [buffer], len(buffer) // 4
                for i, ids in enumerate(tok.encode(group), at):
                    parts += [ids, b"\0\0\0\0"]
                    end += len(ids) // 4 + 1
                    owners.append((end, doc_ids[i]))
                buffer = b"".join(parts)
                yield cut(False)
        yield cut(True)

    schema = "part bigint, place bigint, n_tokens int, ids_crc32 bigint, doc_ids array<bigint>, ids binary"
    return rows.select("text", F.col("doc_id").cast("long").alias("doc_id")).mapInArrow(over, schema)


def _with_slots(sequences: DataFrame, first: dict[int, int], permutation: Permutation) -> DataFrame:
    """Sequences with their number and slot. first: the number of each partition's first sequence."""

    @F.pandas_udf("number bigint, slot bigint")
    def of(part: pd.Series, place: pd.Series) -> pd.DataFrame:
        number = part.map(first).to_numpy(np.int64) + place.to_numpy(np.int64)
        return pd.DataFrame({"number": number, "slot": permutation.slots(number)})

    return sequences.withColumn("_of", of("part", "place")).select("*", "_of.number", "_of.slot").drop("_of", "part", "place")


def _open(folder: str):
    """(file system, path) of a folder that driver and executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _written(sequences: DataFrame, folder: str, length: int, width: int, per_shard: int, shards: int) -> DataFrame:
    """Writes the files; (slot, number, shard, byte_offset, n_tokens, ids_crc32, doc_ids) of every sequence."""
    stride = 4 + length * width

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(folder)
        out, shard, name = None, None, None
        unpack = zstandard.ZstdDecompressor().decompress

        def close() -> None:
            if out is not None:
                out.close()
                system.move(name, f"{base}/shard-{shard:06d}.bin")

        for batch in batches:
            slots = batch.column(1).to_pylist()
            tokens, ids = batch.column(3).to_pylist(), batch.column(6).to_pylist()
            for slot, n, raw in zip(slots, tokens, ids):
                if slot // per_shard != shard:
                    close()
                    shard = slot // per_shard
                    name = f"{base}/writing-{shard:06d}-{uuid.uuid4().hex}"
                    out = system.open_output_stream(name)
                out.write(n.to_bytes(4, "little") + unpack(raw).ljust(length * width, b"\0"))
            at = np.array(slots, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(1),
                    batch.column(2),
                    batch.column(0),
                    pa.array(at % per_shard * stride),
                    batch.column(3),
                    batch.column(4),
                    batch.column(5),
                ],
                names=["slot", "number", "shard", "byte_offset", "n_tokens", "ids_crc32", "doc_ids"],
            )
        close()

    shard = F.floor(F.col("slot") / per_shard).cast("int").alias("shard")
    dealt = sequences.select(
        shard, "slot", "number", "n_tokens", "ids_crc32", "doc_ids", "ids"
    ).repartition(max(1, min(shards, 20_000)), "shard")
    schema = "slot bigint, number bigint, shard int, byte_offset bigint, n_tokens int, ids_crc32 bigint, doc_ids array<bigint>"
    return dealt.sortWithinPartitions("slot").mapInArrow(over, schema)


def materialise(
    docs: DataFrame,
    folder: str,
    path: str | None = None,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    key: int = KEY,
) -> DataFrame:
    """Writes the files and `order.json` to the folder, which all executors share, and returns a row for each sequence."""
    path = path or default_path()
    rows = texts(docs)
    width = 2 if tokenizer(path).highest < 1 << 16 else 4
    sequences = staged(_sequences(rows, path, length, width))
    first, total = {}, 0
    for part, count in sorted(tuple(r) for r in sequences.groupBy("part").count().collect()):
        first[part] = total
        total += count
    system, base = _open(folder)
    system.create_dir(base, recursive=True)
    placed = _with_slots(sequences, first, Permutation(total, key))
    made = staged(_written(placed, folder, length, width, per_shard, -(-total // per_shard)))
    about = {"sequences": total, "length": length, "width": width, "per_shard": per_shard, "key": key}
    with system.open_output_stream(f"{base}/order.json") as f:
        f.write(json.dumps(about).encode())
    return made


class Reader:
    """Sequences of a folder by slot."""

    def __init__(self, folder: str):
        self.system, self.base = _open(folder)
        with self.system.open_input_file(f"{self.base}/order.json") as f:
            self.about = json.loads(f.read())
        self.stride = 4 + self.about["length"] * self.about["width"]

    def __len__(self) -> int:
        return self.about["sequences"]

    def read(self, slot: int = 0, most: int | None = None) -> Iterator[np.ndarray]:
        """The ids of the sequences from a slot on, file after file."""
        end = len(self) if most is None else min(len(self), slot + most)
        per = self.about["per_shard"]
        while slot < end:
            shard, at = divmod(slot, per)
            with self.system.open_input_file(f"{self.base}/shard-{shard:06d}.bin") as f:
                f.seek(at * self.stride)
                for _ in range(min(end, (shard + 1) * per) - slot):
                    raw = f.read(self.stride)
                    n = int.from_bytes(raw[:4], "little")
                    yield np.frombuffer(raw, f"<u{self.about['width']}", offset=4)[:n].astype(np.int64)
                    slot += 1
