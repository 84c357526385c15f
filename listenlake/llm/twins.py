"""SQL of op5 and op8 for DuckDB, written from their contracts."""

from __future__ import annotations

import math

from listenlake.llm import secrets as S

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""

# RE2 folds some letters beyond ASCII, so the key words name both cases.
_key_words = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
ASSIGN = rf"""({_key_words})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = [(0, "assign", ASSIGN, 2), (1, "access", "AKIA[A-Z0-9]+", 0), (2, "hex", "[0-9a-f]+", 0)]
LEAST = {"assign": 12, "access": 18, "hex": 16}
# RE2 has no back-references: a sign six times over, one alternative for each.
_repeats = "|".join(f"[{c}]{{6}}" if c != "-" else "-{6}" for c in S.BASE64_CLASS.alphabet)
ALLOW = [_repeats if p.startswith("(.)") else p for p in S.ALLOW]


def _matches(name: str, pattern: str, group: int) -> str:
    """(doc_id, start, match, value) of all matches of a pattern."""
    return f"""
{name}_m AS (
  SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS found,
         regexp_extract_all(t, '{pattern}', {group}) AS vals
  FROM texts WHERE regexp_matches(t, '{pattern}')),
{name} AS (
  SELECT doc_id, found[i] AS match, vals[i] AS value,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
              + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM {name}_m))"""


def secret_sql(window: int = 20) -> str:
    parts = ["texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"]
    base = []
    for kind, name, pattern, group in PATTERNS:
        parts.append(_matches(name, pattern, group))
        base.append(
            f"SELECT doc_id, start, {kind} AS kind, '{name}' AS name, start + length(match) AS stop FROM {name} "
            f"WHERE length(value) >= {LEAST[name]}"
        )
    parts.append("base AS (" + " UNION ALL ".join(base) + ")")
    added = []
    for c in S.CLASSES:
        number, bound = S.KINDS.index(c.kind), math.floor(1e6 * window * (math.log2(window) - c.least_bits))
        parts.append(_matches(f"c{number}", f"[{c.run}]{{{window},}}", 0))
        keep = [f"regexp_matches(match, '{p}')" for p in c.must] + [f"NOT regexp_matches(match, '{p}')" for p in ALLOW]
        parts.append(
            f"""
w{number} AS (
  SELECT doc_id, start, i, unnest(string_split(substr(match, i, {window}), '')) AS ch
  FROM (SELECT *, unnest(range(1, length(match) - {window - 2})) AS i FROM c{number} WHERE {' AND '.join(keep)})),
h{number} AS (
  SELECT doc_id, start, i FROM (SELECT doc_id, start, i, ch, count(*) AS n FROM w{number} GROUP BY ALL)
  GROUP BY ALL HAVING sum(CAST(round(1e6 * n * log2(n)) AS BIGINT)) <= {bound})"""
        )
        added.append(
            f"SELECT doc_id, CAST(start + min(i) - 1 AS BIGINT), {number}, '{c.kind}', "
            f"CAST(start + max(i) - 1 + {window} AS BIGINT) FROM h{number} GROUP BY doc_id, start"
        )
    parts.append("every AS (SELECT * FROM base UNION ALL " + " UNION ALL ".join(added) + ")")
    joined = "string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    counts = ", ".join(f"coalesce(count(*) FILTER (kind = {k}), 0) AS n_{name}" for k, name, _, _ in PATTERNS)
    return f"""
WITH {','.join(parts)},
b AS (SELECT doc_id, {counts}, {joined} AS spans FROM base GROUP BY 1),
e AS (SELECT doc_id, {joined} AS spans FROM every GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(e.spans, '') AS spans
FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id"""


ORACLES = {"op5_exact_top_k": TOP_K, "op8_secret_scan": secret_sql()}
