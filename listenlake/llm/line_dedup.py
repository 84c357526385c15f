"""Line dedup by a deletion-neighbourhood join.

Lines are what line ends part, without white space around them. A line is dropped if an earlier line, in order of (doc_id,
hash of the whole text, line number), equals it, or if both have LEAST characters or more and are within edit distance 1. An
earlier line counts whether or not it stays itself. LEAST is a floor for edits alone: in short lines one character more or
less is often meant (numbers, names), while equal lines go at any length. Blank lines, and those below LEAST without a letter
or digit (rulers, braces), part the others and always stay; `signs` is how many letters and digits such a line must have to
be dropped.

Equal lines meet by a 128-bit hash, and of each distinct line only its first place goes on. For edit distance 1, every
line emits the hash of each variant with one character left out, and of itself: lines that differ by a replaced character
agree in a variant at the same place; a line with one character more has a variant that is the other line. Equal variants
are joined, each group to its earliest line only, so that no group is expanded into its pairs; what is joined is verified
on the texts.

Only lines that may have a partner emit. Cut the shorter of two lines within distance 1 into k parts: the edit lies in one
of them, and what is before and after that part is the same in both. So both have a hash in common of a line without its
jth part, taken for the length that the shorter has. A line that shares no such hash has no partner and is left out, which
loses no pair. First k is 2, on the hashes alone; the texts of what is left are fetched, and k goes through FINE.

Null texts have no lines and stay null; a text all of whose lines are dropped becomes empty. Rows that repeat with equal
doc_id and text are one document and get the same result; a null doc_id comes before all others. No document goes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import LARGE_WAIT, checkpointed, lean, released, staged

LEAST = 24
SIGNS = 1
EDITS = 1
FINE = (16, 64)
SMALL = 500_000  # so many rows of three longs, 12 MB, may be broadcast

BASE = np.uint64(0x9E3779B97F4A7C15)
PLACE = "id1 bigint, id2 bigint, chars int, doc_id bigint, doc_hash bigint, line_no int"


def split(text: str) -> list[str]:
    return text.split("\n")


def bare(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r")


def counts_as_line(line: str, least: int, signs: int) -> bool:
    """Whether a bare line may be dropped at all."""
    return len(line) >= least or sum(map(str.isalnum, line)) >= signs


def anchors(line: str, parts: int) -> list[int]:
    """Hashes of the line without its jth part, for each j and for a partner of its own length or one less."""
    n, out = len(line), []
    for m in (n - 1, n):
        for j in range(parts):
            before, after = m * j // parts, m - m * (j + 1) // parts
            rest = f"{line[:before]}\0{line[n - after :]}"
            out.append(xxhash.xxh64_intdigest(rest.encode(), m * parts + j) - (1 << 63))
    return out


def _lines(docs: DataFrame, least: int, edits: int, signs: int) -> DataFrame:
    """A row for each line that may be dropped: its hash, place and, if it is long enough for edits, anchors."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, place, chars, ids, rests = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for k, line in enumerate(split(text or "")):
                    line = bare(line)
                    if counts_as_line(line, least, signs):
                        of.append(i)
                        place.append(k)
                        chars.append(len(line))
                        ids.append(xxhash.xxh3_128_digest(line.encode()))
                        rests.append(anchors(line, 2) if edits and len(line) >= least else [])
            both = np.frombuffer(b"".join(ids), "<i8").reshape(-1, 2)
            rows = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.ascontiguousarray(both[:, 0])),
                    pa.array(np.ascontiguousarray(both[:, 1])),
                    pa.array(chars, pa.int32()),
                    batch.column(0).take(rows),
                    batch.column(1).take(rows),
                    pa.array(place, pa.int32()),
                    pa.array(rests, pa.list_(pa.int64())),
                ],
                names=["id1", "id2", "chars", "doc_id", "doc_hash", "line_no", "anchors"],
            )

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _doc_hash().alias("doc_hash"), "text")
    return keyed.mapInArrow(lean(over), f"{PLACE}, anchors array<bigint>")


def _doc_hash() -> Column:
    return F.xxhash64("text")


def _first(*more: str) -> Column:
    return F.min(F.struct("doc_id", "doc_hash", "line_no", *more)).alias("first")


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["doc_hash"] == b["doc_hash"])


def _eligible(distinct: DataFrame) -> DataFrame:
    """Distinct lines that share an anchor with another one."""
    keys = distinct.select("id1", F.explode("anchors").alias("anchor"))
    # Two lines or more if the least and the greatest differ; this needs no exchange of the distinct pairs before.
    ends = keys.groupBy("anchor").agg(F.min("id1").alias("least"), F.max("id1").alias("most"))
    shared = ends.filter("least < most").select("anchor")
    ids = keys.join(shared, "anchor").select("id1").distinct()
    return distinct.join(ids, "id1", "left_semi").drop("anchors")


def _finer(lines: DataFrame, parts: int) -> DataFrame:
    """The same of lines with texts, by finer parts."""

    @F.pandas_udf("array<bigint>")
    def of(line: pd.Series) -> pd.Series:
        return pd.Series([anchors(x, parts) for x in line], dtype=object)

    return _eligible(lines.withColumn("anchors", of("line")))


def _with_text(eligible: DataFrame, docs: DataFrame) -> DataFrame:
    """Eligible lines with their texts, taken from the documents where they stand first."""
    wanted = eligible.groupBy("doc_id", "doc_hash").agg(
        F.collect_list(F.struct("id1", "id2", "line_no")).alias("lines")
    )
    wanted = checkpointed(wanted)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _doc_hash().alias("doc_hash"), "text")
    keyed = keyed.filter(F.col("text").isNotNull())
    small = eligible.count() <= SMALL
    met = keyed.join(F.broadcast(wanted) if small else wanted, _same_document(keyed, wanted))
    met = met.select(keyed["doc_id"], keyed["doc_hash"], keyed["text"], wanted["lines"])

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, doc_hash, text, lines in frame.itertuples(index=False):
                own = split(text)
                for x in lines:
                    rows.append((x["id1"], x["id2"], doc_id, doc_hash, x["line_no"], bare(own[x["line_no"]])))
            made = pd.DataFrame(rows, columns=["id1", "id2", "doc_id", "doc_hash", "line_no", "line"])
            made["doc_id"] = made["doc_id"].astype("Int64")
            yield made

    found = met.mapInPandas(lean(over), "id1 bigint, id2 bigint, doc_id bigint, doc_hash bigint, line_no int, line string")
    return staged(found.dropDuplicates(["id1", "id2"]))


def variants(line: str) -> tuple[np.ndarray, np.uint64]:
    """Hashes of the line without its ith character, for each i, and of the line."""
    c = np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
    n = len(c)
    with np.errstate(over="ignore"):
        power = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64), dtype=np.uint64)])
        whole = c * power[n - 1 :: -1][:n] if n else c
        after = np.concatenate([np.cumsum(whole[::-1], dtype=np.uint64)[::-1], np.zeros(1, np.uint64)])
        moved = c[: n - 1] * power[n - 2 :: -1][: n - 1] if n > 1 else c[:0]
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(moved, dtype=np.uint64)])
        return before[:n] + after[1 : n + 1], after[0]


def _variant_rows(lines: DataFrame) -> DataFrame:
    """(variant, left_out, id1, id2, place): left_out is -1 for the line itself."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 2000):
                part = frame.iloc[at : at + 2000]
                made = [variants(line) for line in part["line"]]
                size = [len(v) + 1 for v, _ in made]
                rows = part[["id1", "id2", "doc_id", "doc_hash", "line_no"]].iloc[np.repeat(np.arange(len(part)), size)]
                keys = np.concatenate([np.append(v, w) for v, w in made]) if made else np.zeros(0, np.uint64)
                out = rows.reset_index(drop=True)
                out.insert(0, "variant", keys.astype(np.uint64).view(np.int64))
                left = [np.append(np.arange(n - 1), -1) for n in size]
                out.insert(1, "left_out", np.concatenate(left).astype(np.int32) if left else np.zeros(0, np.int32))
                out["doc_id"] = out["doc_id"].astype("Int64")
                yield out

    schema = "variant bigint, left_out int, id1 bigint, id2 bigint, doc_id bigint, doc_hash bigint, line_no int"
    place = F.struct("doc_id", "doc_hash", "line_no").alias("place")
    return lines.mapInPandas(lean(over), schema).select("variant", "left_out", "id1", "id2", place)


def within_one(a: str, b: str) -> bool:
    """Whether two texts are within edit distance 1."""
    if abs(len(a) - len(b)) > 1:
        return False
    short = min(len(a), len(b))
    i = 0
    while i < short and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else (a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:])


def _verified(links: DataFrame, lines: DataFrame) -> DataFrame:
    """Links whose texts are within the edit bound."""
    text = lambda n: lines.select(F.col("id1").alias(f"{n}1"), F.col("id2").alias(f"{n}2"), F.col("line").alias(f"{n}_line"))
    both = links.join(text("a"), ["a1", "a2"]).join(text("b"), ["b1", "b2"])

    @F.pandas_udf("boolean")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one(x, y) for x, y in zip(a, b)], dtype=bool)

    return both.filter(near("a_line", "b_line")).select("a1", "a2", "b1", "b2")


def near_repeats(lines: DataFrame) -> DataFrame:
    """(id1, id2) of distinct lines with an earlier line within edit distance 1. lines: id1, id2, place columns, line."""
    rows = _variant_rows(lines)
    # Replaced character: the same variant at the same place. The group's earliest line serves for all of them.
    left = rows.filter("left_out >= 0")
    groups = left.groupBy("variant", "left_out").agg(F.min(F.struct("place", "id1", "id2")).alias("e"), F.max("place").alias("last"))
    groups = groups.filter(F.col("e.place") < F.col("last")).select("variant", "left_out", "e")
    replaced = left.join(groups, ["variant", "left_out"]).filter(F.col("e.place") < F.col("place"))
    # One character more: a variant that is another line. Whichever is later has an earlier one.
    whole = rows.filter("left_out < 0").select("variant", F.struct("place", "id1", "id2").alias("e"))
    longer = left.select("variant", "id1", "id2", "place").distinct().join(whole, "variant")
    link = lambda df, late, early: df.select(
        late("id1").alias("a1"), late("id2").alias("a2"), early("id1").alias("b1"), early("id2").alias("b2")
    )
    own, other = (lambda c: F.col(c)), (lambda c: F.col(f"e.{c}"))
    links = (
        link(replaced, own, other)
        .unionByName(link(longer.filter(F.col("e.place") < F.col("place")), own, other))
        .unionByName(link(longer.filter(F.col("e.place") > F.col("place")), other, own))
        .distinct()
    )
    return _verified(links, lines).select(F.col("a1").alias("id1"), F.col("a2").alias("id2")).distinct()


def kept_lines(docs: DataFrame, least: int = LEAST, edits: int = EDITS, signs: int = SIGNS) -> DataFrame:
    """(doc_id, doc_hash, line_no) of the lines that stay among those that may be dropped."""
    if edits not in (0, 1):
        raise ValueError("the edit bound is 0 or 1")
    lines = _lines(docs, least, edits, signs)
    distinct = lines.groupBy("id1", "id2").agg(_first("anchors"))
    distinct = staged(distinct.select("id1", "id2", "first.doc_id", "first.doc_hash", "first.line_no", "first.anchors"))
    stay = distinct.drop("anchors")
    if edits:
        # Files of finished shuffles go before all texts are exchanged: after anchors, and after variants.
        eligible = checkpointed(_eligible(distinct))
        released(docs.sparkSession, LARGE_WAIT)
        lines = _with_text(eligible, docs)
        for parts in FINE:
            lines = checkpointed(_finer(lines, parts))
        dropped = checkpointed(near_repeats(lines))
        released(docs.sparkSession, LARGE_WAIT)
        stay = stay.join(dropped, ["id1", "id2"], "left_anti")
    return stay.select("doc_id", "doc_hash", "line_no")


def dedup_lines(
    docs: DataFrame, least: int = LEAST, edits: int = EDITS, counts: bool = False, signs: int = SIGNS
) -> DataFrame:
    """Documents with repeated lines taken out of `text` and n_chars brought up to date; counts: with n_lines and
    n_dropped."""
    names = docs.columns
    stay = kept_lines(docs, least, edits, signs).groupBy("doc_id", "doc_hash").agg(F.collect_list("line_no").alias("_stay"))
    stay = stay.select(F.col("doc_id").alias("_id"), F.col("doc_hash").alias("_hash"), "_stay")
    marked = docs.withColumn("_own_hash", _doc_hash())
    met = marked.join(stay, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_own_hash") == F.col("_hash")), "left")

    @F.pandas_udf("text string, n_lines int, n_dropped int")
    def rest(text: pd.Series, stay: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(text, stay):
            if t is None:
                rows.append((None, 0, 0))
                continue
            own, s = split(t), set() if s is None else set(s)
            kept = [x for k, x in enumerate(own) if k in s or not counts_as_line(bare(x), least, signs)]
            rows.append((t if len(kept) == len(own) else "\n".join(kept), len(own), len(own) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_lines", "n_dropped"])

    done = met.withColumn("_rest", rest("text", "_stay"))
    changed = F.col("_rest.n_dropped") > 0
    out = []
    for n in names:
        c = F.col(n)
        if n == "text":
            c = F.col("_rest.text").alias("text")
        elif n == "n_chars":
            c = F.when(changed, F.length("_rest.text").cast("long")).otherwise(c).alias("n_chars")
        out.append(c)
    more = [F.col("_rest.n_lines").alias("n_lines"), F.col("_rest.n_dropped").alias("n_dropped")] if counts else []
    return done.select(*out, *more)
