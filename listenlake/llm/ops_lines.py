"""Query op9 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlake.llm import line_dedup
from listenlake.llm.common import documents


def op9_line_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Every document with the number of its lines, of those dropped, and the digest of what stays."""
    done = line_dedup.dedup_lines(documents(spark, directory).select("doc_id", "text"), counts=True)
    return done.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.col("n_dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("text_sha256"),
    )


QUERIES = {"op9_line_dedup": op9_line_dedup}

# Every pair is looked for, without the filter by halves. doc_id is the order; the tables have each once.
ORACLES = {
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS k
  FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT *, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l
), d AS (
  SELECT line, min((doc_id, k)) AS first, length(line) AS n
  FROM t WHERE length(line) >= 24 OR regexp_matches(line, '[\p{L}\p{N}]') GROUP BY line
), e AS (
  SELECT * FROM d WHERE n >= 24
), v AS (
  SELECT line, first, i, hash(substr(line, 1, i - 1) || substr(line, i + 1)) AS h
  FROM (SELECT line, first, unnest(range(1, n + 1)) AS i FROM e)
), late AS (
  SELECT line FROM (SELECT line, first, min(first) OVER (PARTITION BY h, i) AS e FROM v) WHERE e < first
  UNION
  SELECT CASE WHEN e.first < v.first THEN v.line ELSE e.line END FROM v JOIN e ON v.h = hash(e.line)
), m AS (
  SELECT t.doc_id, t.k, t.raw, d.line IS NULL OR ((t.doc_id, t.k) = d.first AND late.line IS NULL) AS stays
  FROM t LEFT JOIN d ON t.line = d.line LEFT JOIN late ON t.line = late.line
)
SELECT doc_id, CAST(coalesce(count(k), 0) AS BIGINT) AS n_lines,
       CAST(coalesce(sum(CASE WHEN stays THEN 0 ELSE 1 END) FILTER (WHERE k IS NOT NULL), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY k) FILTER (WHERE stays), '')) AS text_sha256
FROM (SELECT documents.doc_id, m.k, m.raw, m.stays FROM documents LEFT JOIN m USING (doc_id)) GROUP BY doc_id""",
}
