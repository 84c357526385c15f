"""Ranked search against a plain sum over terms."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from listenlake.llm import ranked
from listenlake.llm.ops_ranked import op13_ranked_search

SMALL = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items, k=10):
    bags = [(d, Counter(brute_terms(t))) for d, t in docs]
    bags = [(d, c) for d, c in bags if c]
    n = len(bags)
    length = sum(sum(c.values()) for _, c in bags)
    df = Counter(t for _, c in bags for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in bags:
            m = 10 + 90 * sum(c.values()) * n // length
            score = 0
            for t in set(brute_terms(text)):
                if t in c:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                    score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0 and d is not None:
                scores.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def made(spark, docs, items, **options):
    docs = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], "doc_id bigint, text string, term string, score int, number int")
    items = spark.createDataFrame([(*i, "x", 3) for i in items], "item_id bigint, text string, terms string, rank int")
    out = ranked.search(docs, items, **options).select("item_id", "rank", "doc_id", "score").collect()
    return sorted(map(tuple, out), key=str)


def table(seed, documents, items, words=60):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n))
    return [(i, text(rng.randrange(0, 50))) for i in range(documents)], [(i, text(rng.randrange(0, 12))) for i in range(items)]


def test_ties_at_the_edge_of_a_tile(spark):
    """Many equal documents: the least doc_ids of a score win, whichever batch or task holds them."""
    docs = [(i, "alpha beta" if i % 3 else "alpha") for i in range(5000, 0, -1)] + [(6000 + i, f"gamma {i}") for i in range(5000)]
    items = [(1, "alpha"), (2, "beta alpha"), (3, "gamma"), (4, "nowhere")]
    assert made(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("options", [{}, {"most_items": 32}, {"most_terms": 40}, {"most_terms": 3}, {"k": 1}])
def test_blocks_of_items(spark, options):
    docs, items = table(3, 300, 70)
    assert made(spark, docs, items, **options) == brute(docs, items, options.get("k", 10))


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "--- ..."), (4, "Ärger ÄRGER ärger"), (5, "a b\x7fc`d"), (None, "a b"), (7, "a b"), (7, "a b")]
    docs += [(8, "a " * 200_000 + "z")]
    items = [(1, "a"), (1, "a"), (1, "b"), (None, "z"), (2, None), (3, ""), (4, "ÄRGER Ärger ärger"), (5, "A-Z")]
    assert made(spark, docs, items) == brute(docs, items)
    assert made(spark, [], items) == [] and made(spark, docs, []) == []
    assert made(spark, [(1, None)], items) == []


def test_whole_query(spark):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(*c).collect()]
    out = op13_ranked_search(spark, SMALL).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, out), key=str) == brute(read("documents", "doc_id", "text"), read("benchmark", "item_id", "text"))


def test_partial_sums_stay_below_2_to_53():
    """Tiles are cut where a sum could pass 2^53; the products then are exact."""
    rng = np.random.default_rng(2)
    matrix = rng.integers(1 << 30, 1 << 32, (3, 64))
    cut = ranked.tiles(matrix, 1_000_000, width=64)
    assert len(cut) > 1 and [a for a, _ in cut[1:]] == [b for _, b in cut[:-1]]
    assert all(int(matrix[:, a:b].sum(axis=1).max()) * 1_000_000 < ranked.EXACT for a, b in cut)
    codes = np.concatenate([rng.permutation(64)[:40] for _ in range(5)])
    values = rng.integers(1, 1_000_000, 200)
    out = ranked.products(np.arange(0, 201, 40), codes, values, [(a, b, matrix[:, a:b].T.astype(float)) for a, b in cut])
    for d in range(5):
        for i in range(3):
            own = slice(40 * d, 40 * d + 40)
            assert int(out[d, i]) == sum(int(matrix[i, c]) * int(v) for c, v in zip(codes[own], values[own]))
