"""Query op13 and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listenlake.llm import ranked
from listenlake.llm.common import documents


def op13_ranked_search(spark: SparkSession, directory: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    docs = documents(spark, directory).select("doc_id", "text")
    return ranked.search(docs, spark.read.parquet(f"{directory}/benchmark.parquet"), 10)


QUERIES = {"op13_ranked_search": op13_ranked_search}

_upper = "".join(map(chr, range(65, 91)))
_terms = (
    rf"regexp_extract_all(translate(text, '{_upper}', '{_upper.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

ORACLES = {
    "op13_ranked_search": f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, {_terms} AS terms FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(terms)) AS BIGINT) AS total FROM t WHERE len(terms) > 0),
i AS (SELECT number, item_id, unnest(list_distinct(terms)) AS term FROM (
  SELECT row_number() OVER () AS number, item_id, {_terms} AS terms FROM (SELECT DISTINCT item_id, text FROM benchmark))),
f AS (SELECT r, doc_id, term, n, count(*) AS tf FROM (
  SELECT r, doc_id, unnest(terms) AS term, len(terms) AS n FROM t) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM f GROUP BY term) JOIN s ON true),
p AS (SELECT number, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN w USING (term) JOIN s ON true WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 10""",
}
