"""The Merkle manifest against a tree built in plain Python."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from listenlake.llm import merkle
from listenlake.llm.ops_merkle import ORACLES, op11_merkle_manifest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, hash string, tree int, at int, up string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(*values):
    texts = [None if v is None else str(v) for v in values]
    return digest("".join("-" if t is None else f"{len(t.encode())}:{t}" for t in texts))


def above(nodes):
    return [digest("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]


def path(nodes, i):
    """(siblings, sides) from node i to the root, and the root."""
    steps = []
    while len(nodes) > 1:
        other = i ^ 1
        steps.append(("L" if i % 2 else "R", nodes[other]) if other < len(nodes) else None)
        nodes, i = above(nodes), i // 2
    return steps, nodes[0]


def climb(node, steps):
    for s in steps:
        node = digest(node if s is None else s[1] + node if s[0] == "L" else node + s[1])
    return node


def brute(rows):
    """rows: (doc_id, text, lang, source, n_chars) -> sorted rows of op11."""
    low = lambda x: (x is not None, x if x is not None else 0)
    trees = {}
    for r in rows:
        leaf = brute_leaf(r[0], r[3], r[2], r[4], r[1])
        trees.setdefault(r[2], []).append((low(r[0]), leaf, r))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    paths, roots = {}, []
    for name in names:
        trees[name].sort(key=lambda x: x[:2])
        leaves = [leaf for _, leaf, _ in trees[name]]
        paths[name] = [path(leaves, i) for i in range(len(leaves))]
        roots.append(paths[name][0][1])
    out = []
    for t, name in enumerate(names):
        upper, root = path(roots, t)
        for (_, leaf, r), (steps, subroot) in zip(trees[name], paths[name]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            claimed = brute_leaf(r[0], r[3], r[2], r[4] + 1, r[1]) if changed else leaf
            siblings = "".join(s[1] for s in steps + upper if s)
            folded = climb(claimed, steps + upper)
            out.append((r[0], leaf, subroot, root, digest(siblings), folded, folded == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def run(spark, folder, rows):
    wide = [(*r, "x", 1, 2, "y") for r in rows]
    spark.createDataFrame(wide, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return sorted(map(tuple, op11_merkle_manifest(spark, str(folder)).select(*COLUMNS).collect()), key=str)


def test_odd_rows(spark, tmp_path):
    """Null in every column, empty and long texts, repeated rows, one leaf alone, clashing columns."""
    rows = [(i, f"text {i}", "en", "s", i) for i in range(301)]
    rows += [(7, "text 7", "en", "s", 7)] * 3 + [(7, "other", "en", "s", 7)]
    rows += [(None, "no id", "en", None, None), (5, None, None, None, None), (6, "", None, "é", 0)]
    rows += [(1000, "x" * 200_000, "de", "s", 200_000), (14, "ein", "äö", "s", None), (28, "zwei", "", "s", 4)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_sizes_at_the_edge_of_a_subtree(spark, tmp_path):
    rows = [(1000 * n + i, "t", f"{n} leaves", "s", 1) for n in (1, 2, 15, 16, 17, 33, 257) for i in range(n)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_only_every_few_levels_are_stored(spark):
    leaves = spark.range(1000).select("id", F.lit("a").alias("tree"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    made = merkle.manifest(leaves, "id", levels=3)
    stored = {r["level"]: r["count"] for r in made.groups.stored().groupBy("level").count().collect()}
    assert stored == {0: 1000, 3: 125, 6: 16, 9: 2}
    proofs = made.proofs()
    assert proofs.filter(merkle.fold(F.col("x.hash"), F.col("steps")) == F.col("root")).count() == 1000
    assert proofs.select("root").distinct().collect() == made.root().collect()


def test_sql_is_the_same_law(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    rows = con.execute("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    told = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLES['op11_merkle_manifest']})").fetchall()
    made = op11_merkle_manifest(spark, SMALL).select(*COLUMNS).collect()
    assert sorted(told, key=str) == sorted(map(tuple, made), key=str) == brute(rows)
