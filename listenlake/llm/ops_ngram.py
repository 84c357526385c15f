"""Query op12 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listenlake.llm import ngram_join
from listenlake.llm.common import documents


def op12_ngram_join(spark: SparkSession, directory: str) -> DataFrame:
    """Every document with the size of its set of five-word shingles and the least doc_id that links lead to."""
    return ngram_join.near_documents(documents(spark, directory).select("doc_id", "text"))


QUERIES = {"op12_ngram_join": op12_ngram_join}

_upper = "".join(map(chr, range(65, 91)))

# All pairs that share a shingle, counted one by one; components by passing on the least doc_id.
ORACLES = {
    "op12_ngram_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_upper}', '{_upper.lower()}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM w
), each AS (SELECT doc_id, len(s) AS n, hash(list_sort(s)) AS id, s FROM s),
sets AS (SELECT id, any_value(n) AS n, any_value(s) AS s FROM each WHERE n > 0 GROUP BY id),
tokens AS (SELECT id, n, unnest(s) AS t FROM sets),
counted AS (SELECT a.id AS a, b.id AS b, a.n + b.n AS size, count(*) AS common
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n),
links AS (SELECT a, b FROM counted WHERE 100 * common >= 80 * (size - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT id AS node, id AS other FROM sets UNION SELECT r.node, l.b FROM reach r JOIN both_ways l ON l.a = r.other),
least AS (SELECT id, min(doc_id) AS least FROM each WHERE n > 0 GROUP BY id),
named AS (SELECT node, min(least) AS component_id FROM reach JOIN least ON least.id = other GROUP BY node)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id
FROM each LEFT JOIN named ON node = id AND n > 0""",
}
