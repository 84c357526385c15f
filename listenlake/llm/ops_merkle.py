"""Query op11 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.llm import merkle
from listenlake.llm.common import documents


def op11_merkle_manifest(spark: SparkSession, directory: str) -> DataFrame:
    """Every document with its leaf, the roots above it, its proof's digest and the root that a tampered leaf leads to."""
    docs = documents(spark, directory)
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    leaf = lambda n: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    leaves = docs.select(
        "doc_id",
        F.col("lang").alias("tree"),
        leaf(F.col("n_chars")).alias("hash"),
        F.when(tampered, leaf(F.col("n_chars") + 1)).alias("claimed"),
    )
    made = merkle.manifest(leaves, "doc_id", ["claimed"]).proofs()
    folded = merkle.fold(F.coalesce("x.claimed", "x.hash"), F.col("steps"))
    made = made.select(
        "x.doc_id",
        F.col("x.hash").alias("leaf"),
        "subroot",
        "root",
        merkle.proof_digest(F.col("steps")).alias("proof_sha256"),
        folded.alias("folded_root"),
    )
    return made.withColumn("verified", F.col("folded_root") == F.col("root"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}

# A level after the other, all nodes kept. crc32 goes by its table of 256 remainders, made by the rule.
_field = lambda c: f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')"
_leaf = lambda n: f"sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {n} || {_field('text')})"
_half = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END"
_levels = """
  SELECT {t}, pos // 2 AS pos, lvl + 1 AS lvl, sha256(string_agg(h, '' ORDER BY pos)) AS h, any_value(n) AS n
  FROM {name} WHERE (n - 1) >> lvl > 0 GROUP BY {t}, pos // 2, lvl"""

ORACLES = {
    "op11_merkle_manifest": f"""
WITH RECURSIVE rem AS (
  SELECT i AS start, i AS c, 0 AS k FROM range(256) r(i) UNION ALL SELECT start, {_half}, k + 1 FROM rem WHERE k < 8
), crc AS (SELECT list(c ORDER BY start) AS r FROM rem WHERE k = 8),
d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, lang IS NULL AS none, {_leaf(_field('n_chars'))} AS leaf,
         {_leaf("coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-')")} AS claimed,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
           lambda s: CAST(ascii(s) AS BIGINT))),
           lambda a, x: xor(a // 256, r[CAST(xor(a % 256, x) AS INTEGER) + 1])), 4294967295) % 7 = 0 AS changed
  FROM documents JOIN crc ON true
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY none, lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY none, lang) AS n
  FROM d
), nodes AS (
  SELECT none, lang, pos, 0 AS lvl, leaf AS h, n FROM leaves UNION ALL {_levels.format(t='none, lang', name='nodes')}
), sub AS (
  SELECT none, lang, h AS subroot, row_number() OVER (ORDER BY none DESC, encode(lang)) - 1 AS pos, count(*) OVER () AS n
  FROM nodes WHERE (n - 1) >> lvl = 0
), tops AS (
  SELECT 0 AS t, pos, 0 AS lvl, subroot AS h, n FROM sub UNION ALL {_levels.format(t='t', name='tops')}
), walk AS (
  SELECT doc_id, leaf, none, lang, leaf AS first, CASE WHEN changed THEN claimed ELSE leaf END AS node, pos, 0 AS lvl, n, '' AS proof
  FROM leaves
  UNION ALL
  SELECT w.doc_id, w.leaf, w.none, w.lang, w.first,
         sha256(CASE WHEN s.h IS NULL THEN w.node WHEN w.pos % 2 = 1 THEN s.h || w.node ELSE w.node || s.h END),
         w.pos // 2, w.lvl + 1, w.n, w.proof || coalesce(s.h, '')
  FROM walk w LEFT JOIN nodes s ON s.none = w.none AND s.lang = w.lang AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1)
  WHERE (w.n - 1) >> w.lvl > 0
), over AS (
  SELECT doc_id, leaf, subroot, node, sub.pos, 0 AS lvl, sub.n, proof FROM walk JOIN sub USING (none, lang)
  WHERE (walk.n - 1) >> walk.lvl = 0
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot,
         sha256(CASE WHEN s.h IS NULL THEN w.node WHEN w.pos % 2 = 1 THEN s.h || w.node ELSE w.node || s.h END),
         w.pos // 2, w.lvl + 1, w.n, w.proof || coalesce(s.h, '')
  FROM over w LEFT JOIN tops s ON s.lvl = w.lvl AND s.pos = xor(w.pos, 1) WHERE (w.n - 1) >> w.lvl > 0
)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = h AS verified
FROM over JOIN (SELECT h FROM tops WHERE (n - 1) >> lvl = 0) r ON true WHERE (n - 1) >> lvl = 0""",
}
