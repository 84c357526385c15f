"""SimHash, sharding, exact search and line dedup against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib

import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from listenlake.llm import components, line_dedup, sharding, simhash, vafile
from listenlake.llm.ops_join import op3_simhash_near_dedup, op5_exact_top_k, op7_sharding
from listenlake.llm.ops_lines import ORACLES, op9_line_dedup

SMALL = "/root/testdata/sf0.001"


class Sets:
    def __init__(self, items):
        self.root = {i: i for i in items}

    def top(self, i):
        while self.root[i] != i:
            i = self.root[i]
        return i

    def join(self, a, b):
        a, b = self.top(a), self.top(b)
        self.root[max(a, b)] = min(a, b)


def brute_fingerprint(text):
    text = text.translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_masks_cover_every_pair_of_places():
    for radius in (1, 2):
        masks = simhash.masks(radius)
        assert len(masks) == 2 ** (radius + 1) - 1 and min(m.bit_count() for m in masks) > 20
        for i in range(64):
            for j in range(64):
                places = 1 << i | (1 << j if radius == 2 else 0)
                assert any(m & places == 0 for m in masks)


def test_links_of_crowded_buckets_join_the_same_groups(spark):
    draw = random.Random(3)
    bits = set()
    for _ in range(6):  # clouds of neighbours around a few centres, and chains
        centre = draw.getrandbits(64)
        for _ in range(120):
            near = centre
            for _ in range(draw.randrange(0, 4)):
                near ^= 1 << draw.randrange(64)
            bits.add(near)
    bits |= {draw.getrandbits(64) for _ in range(200)} | {0, 1, 3, 7}
    as_long = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    sets, ordered = Sets(map(as_long, bits)), sorted(bits)
    for i, a in enumerate(ordered):
        for b in ordered[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                sets.join(as_long(a), as_long(b))
    expected = {(n, sets.top(n)) for n in sets.root}
    distinct = spark.createDataFrame([(as_long(b),) for b in bits], "bits long")
    for bucket in (1, 40, 256):
        found = {tuple(r) for r in components.components(simhash.links(distinct, bucket=bucket)).collect()}
        assert found | {(n, n) for n in sets.root} == expected | {(n, n) for n in sets.root}
        assert {n for n, _ in found} == {n for n, t in expected if sum(sets.top(m) == t for m in sets.root) > 1}


def test_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(3000))
    texts = ["A b C d", "a B c D", "", None, " \n\t", "one", "One\x0btwo", "é ß", long, long + " x", "É ß"]
    docs = spark.createDataFrame([(50 - i, t, 1) for i, t in enumerate(texts)] + [(50, "A b C d", 2)], "doc_id long, text string, bits int")
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) + 1
    got = {r.doc_id: r for r in rows}
    sets = Sets(got)
    prints = {50 - i: brute_fingerprint(t or "") for i, t in enumerate(texts)}
    for a in prints:
        assert got[a].bits % (1 << 64) == prints[a]
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                sets.join(a, b)
    assert {d: r.component_id for d, r in got.items()} == {d: sets.top(d) for d in got}
    kept = simhash.keep_one(docs.unionByName(spark.createDataFrame([(None, "one", 3)], docs.schema)))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == {sets.top(d) for d in got} | {None}
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_keep_one_keeps_one_row_of_a_component(spark):
    """Repeated rows, and a row that shares the kept doc_id but stands in a group with an earlier member."""
    one, two = "a text that stands in one group", "quite another text in a second group"
    rows = [(5, one)] * 3 + [(5, two), (3, two), (7, one), (9, "a third that is alone"), (None, one)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in simhash.keep_one(docs).collect()]
    assert sorted(got, key=str) == sorted([(5, one), (3, two), (9, "a third that is alone"), (None, one)], key=str)


def test_op3_on_a_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in op3_simhash_near_dedup(spark, SMALL).collect()}
    prints = {d: brute_fingerprint(t) for d, t in docs.items()}
    sets = Sets(docs)
    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                sets.join(a, b)
    assert {d: (r.fingerprint, r.component_id) for d, r in rows.items()} == {
        d: (f"{prints[d]:016x}", sets.top(d)) for d in docs
    }


# ---- sharding


def check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    return [sum(r.size for r in by.get(s, [])) for s in range(shards)]


def test_shards_are_equal_and_hot_texts_are_split(spark):
    draw = random.Random(1)
    texts = ["hot text " * 20] * 400 + ["".join(draw.choices("abc é", k=draw.randrange(300))) for _ in range(800)] + [None, ""]
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, shard int")
    rows = sharding.shard_records(docs, 8).collect()
    sizes = check_shards(rows, 8)
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 8
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    assert len({r.shard for r in rows if r.doc_id < 400}) > 1
    assert sharding.shard_records(docs.limit(0)).count() == 0


def test_op7_on_a_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op7_sharding(spark, SMALL).collect()
    assert len(rows) == len(docs) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    check_shards(rows, 24)
    home = {}
    for r in rows:
        home.setdefault(docs[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for s in home.values())


# ---- exact search


def brute_top(vectors, queries, k):
    usable = {
        i: [math.floor(1024 * float(x)) for x in v]
        for i, v in vectors
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    out = []
    for q in usable:
        if queries(q):
            scores = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(700, 6)))]
    rows += [(700 + i, rows[3][1]) for i in range(150)]  # ties
    rows += [(900, None), (901, [1.0, None]), (910, [math.nan]), (920, [math.inf]), (930, []), (940, [0.5])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, cells int").repartition(5)
    for block in (2048, 17):
        got = vafile.top_k(table, F.col("vec_id") % 10 == 0, 7, block=block).collect()
        assert sorted(map(tuple, got)) == brute_top(rows, lambda i: i % 10 == 0, 7)
    few = vafile.top_k(table.filter("vec_id < 3"), F.col("vec_id") == 0, 10).collect()
    assert sorted(map(tuple, few)) == brute_top(rows[:3], lambda i: i == 0, 10) and len(few) == 2
    assert vafile.top_k(table.limit(0), F.col("vec_id") == 0).count() == 0


def test_op5_on_a_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(map(tuple, op5_exact_top_k(spark, SMALL).collect())) == brute_top(rows, lambda i: i % 100 == 0, 10)


# ---- line dedup


def brute_lines(docs, least, edits=1):
    """Texts after dedup; docs in order of doc_id."""
    seen, out = [], {}
    for d, text in docs:
        if text is None:
            out[d] = None
            continue
        kept = []
        for line in text.split("\n"):
            bare = line.strip(" \t\n\x0b\x0c\r")
            if len(bare) >= least:
                if not any(s == bare or (edits and len(s) >= least and line_dedup.within_one(s, bare)) for s in seen):
                    kept.append(line)
                seen.append(bare)
            elif any(c.isalnum() for c in bare):
                if bare not in seen:
                    kept.append(line)
                seen.append(bare)
            else:
                kept.append(line)
        out[d] = "\n".join(kept)
    return out


def test_variants_meet_within_one_edit():
    draw = random.Random(3)
    for _ in range(1500):
        a = "".join(draw.choices("abé", k=draw.randrange(1, 8)))
        i, kind = draw.randrange(len(a)), draw.randrange(3)
        b = a[:i] + ["", "c", "c" + a[i]][kind] + a[i + 1 :]
        assert line_dedup.within_one(a, b) and line_dedup.within_one(b, a)
        (va, wa), (vb, wb) = line_dedup.variants(a), line_dedup.variants(b)
        assert (va == vb).any() if len(a) == len(b) else (wb in va or wa in vb)
        for parts in (2, 5, *line_dedup.FINE):
            assert set(line_dedup.anchors(a, parts)) & set(line_dedup.anchors(b, parts))
    assert not line_dedup.within_one("ab", "ba")


def test_line_dedup_against_brute_force(spark):
    draw = random.Random(6)
    stock = ["".join(draw.choices("ab é", k=draw.randrange(3, 14))) for _ in range(60)]

    def edited(line):
        i = draw.randrange(len(line) + 1)
        return draw.choice([line, line[:i] + "x" + line[i:], line[:i] + line[i + 1 :], line[:i] + "y" + line[i + 1 :]])

    docs = [(i, "\n".join(edited(draw.choice(stock)) for _ in range(draw.randrange(0, 6)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, "  " + stock[0] + "\t\nshort"), (206, "short\n--\n\n7\né"), (207, " short\n--\n\n7\n8\né"), (204, "z" * 5000), (205, "z" * 4999)]
    table = spark.createDataFrame([(*r, len(r[1] or ""), "e") for r in docs], "doc_id long, text string, n_chars long, line_no string")
    table = table.repartition(4)
    for edits in (0, 1):
        got = line_dedup.dedup_lines(table, least=6, edits=edits)
        assert got.columns == table.columns
        rows = {r.doc_id: r for r in got.collect()}
        expected = brute_lines(docs, 6, edits)
        assert {d: r.text for d, r in rows.items()} == expected
        assert all(r.n_chars == len(r.text or "") for r in rows.values())
    twice = spark.createDataFrame([(1, "same line here")] * 2 + [(None, "same line here")], "doc_id long, text string")
    assert sorted(r.text for r in line_dedup.dedup_lines(twice, least=6).collect()) == ["", "", "same line here"]
    assert line_dedup.dedup_lines(table.limit(0)).count() == 0


def test_op9_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    names = ["doc_id", "n_lines", "n_dropped", "text_sha256"]
    expected = sorted(con.sql(ORACLES["op9_line_dedup"]).df()[names].itertuples(index=False, name=None))
    assert sorted(map(tuple, op9_line_dedup(spark, SMALL).select(*names).collect())) == expected
