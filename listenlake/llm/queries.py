"""All queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from listenlake.llm import (
    ops_join,
    ops_lines,
    ops_merkle,
    ops_native,
    ops_ngram,
    ops_ranked,
    ops_tokens,
    ops_toxicity,
    twins,
)

QUERIES = {
    **ops_toxicity.QUERIES,
    **ops_tokens.QUERIES,
    **ops_join.QUERIES,
    **ops_native.QUERIES,
    **ops_lines.QUERIES,
    **ops_merkle.QUERIES,
    **ops_ngram.QUERIES,
    **ops_ranked.QUERIES,
}
ORACLES: dict[str, str] = {
    **ops_lines.ORACLES,
    **ops_merkle.ORACLES,
    **ops_ngram.ORACLES,
    **ops_ranked.ORACLES,
    **twins.ORACLES,
}
