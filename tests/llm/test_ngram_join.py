"""The n-gram join against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from listenlake.llm import ngram_join
from listenlake.llm.ops_ngram import op12_ngram_join

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, id string, n int, token string, component string"


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted([(d, len(s), least.get(top(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=str)


def made(spark, rows, **options):
    docs = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    out = ngram_join.near_documents(docs, **options).select("doc_id", "n_shingles", "component_id").collect()
    return sorted(map(tuple, out), key=str)


def corpus(seed, groups, copies, words):
    """Groups of texts with some words of each changed, with a passage that all share."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(20, words))]
        for _ in range(rng.randrange(1, copies)):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 40) + 2)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.5:
                text += passage
            out.append(" ".join(text))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize("frequent", [64, 3, 0])
def test_links_are_those_of_all_pairs(spark, frequent):
    """With frequent=0 all lists go the way of long ones."""
    rows = corpus(frequent, 40, 12, 300)
    assert made(spark, rows, frequent=frequent) == brute(rows)


def test_chain_and_hot_group(spark):
    """A chain whose ends don't link; a large group of near copies whose members link with few others each; texts that are
    nearly all one passage."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(90000)}"
    base = [word() for _ in range(120)]
    rows, text = [], list(base)
    for i in range(150):
        text[(7 * i) % 120] = word()
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join([word() for _ in range(rng.randrange(8, 22))] + base[:80])) for i in range(150)]
    for options in ({}, {"frequent": 5}, {"frequent": 5, "hot": 40}):
        assert made(spark, rows, **options) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one Two"), (5, "ONE two"), (6, "one two three"), (None, "one two")]
    rows += [(7, "É é a b c d"), (8, "é é a b c d"), (9, "a b c d e " * 30_000), (9, "a b c d e " * 30_000), (9, "other text")]
    rows += [(None, "never seen elsewhere"), (10, "x\x0by\x0cz u v w"), (11, "x y z u v w"), (12, "x\xa0y z u v w")]
    assert made(spark, rows) == brute(rows)
    assert made(spark, []) == []


def test_whole_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    out = op12_ngram_join(spark, SMALL).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, out), key=str) == brute(rows)


def test_order_and_bound():
    """Heads keep the frequent ones for the end; parities never exclude a pair that links."""
    rng = np.random.default_rng(1)
    hashes = np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    none = ngram_join.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64), 3)
    want = ngram_join.head_length(len(hashes), 80)
    assert np.array_equal(none.head(hashes, 80)[0], hashes[:want])
    often = np.sort(ngram_join.keys(hashes[: len(hashes) - 10], 3))
    order = ngram_join.Order(often, np.arange(len(often)), 3)
    rare, last = order.head(hashes, 80)
    assert np.array_equal(rare, hashes[-10:]) and len(last) == want - 10
    df = dict(zip(often.tolist(), range(len(often))))
    assert [df[k] for k in ngram_join.keys(last, 3).tolist()] == list(range(want - 10))
    for n in (5, 100, 300):
        sets = [np.unique(np.concatenate([hashes[:n], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for k in range(0, n // 2, 3)]
        size = np.array([len(s) for s in sets])
        found = {(min(i, j), max(i, j)) for i, other in ngram_join.possible(size, np.arange(len(sets)), [np.frombuffer(ngram_join.parity(s).tobytes(), np.uint8) for s in sets], 80) for j in other}
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 80 * (len(a) + len(b) - both):
                    assert (j, i) in found
