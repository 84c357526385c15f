"""The pipeline's near-copy stage against brute force on planted copies."""

from __future__ import annotations

import random

import corpus_pipeline
from listenlake.llm import near_copies


def sets_of(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def planted(draw, origins=60):
    """Texts of invented words, each with copies in which one to nine of 200 words are replaced."""
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    out = []
    for _ in range(origins):
        words = [word() for _ in range(200)]
        out.append(" ".join(words))
        for edits in (1, 3, 4, 9):
            copy = list(words)
            for at in draw.sample(range(200), edits):
                copy[at] = word()
            out.append(" ".join(copy))
    return out


def test_stage_keeps_one_of_planted_near_copies(spark):
    texts = planted(random.Random(9))
    sets = [sets_of(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similarity(sets[i], sets[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert 60 < len(set(root)) < len(texts) - 100  # some copies are below 0.8 and stay
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").repartition(4)
    kept = corpus_pipeline.simhash_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root))


def test_large_groups_and_repeated_rows(spark):
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(300)]
    rows = [(i, " ".join([*words[: i + 1], f"x{i}", *words[i + 1 :]])) for i in range(290)]
    rows += [(1000, "a text of its own, which nobody repeats"), (1000, "a text of its own, which nobody repeats")]
    rows += [(2000, None), (2001, " \n"), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = [r.doc_id for r in near_copies.keep_one(docs).collect()]
    assert sorted(ids, key=str) == [0, 1000, 2000, None]
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def test_pairs_among_many_texts_that_are_nearly_as_alike(spark):
    """600 texts share three quarters of their words with all others, which is below 0.8; 300 pairs of them link. Sets of
    minima put all of them into the same buckets; no pair may be lost there."""
    draw = random.Random(6)
    word = lambda: "".join(draw.choices("abcdefghij", k=6))
    common = [word() for _ in range(150)]
    rows = []
    for i in range(300):
        own = [word() for _ in range(48)]
        rows += [(2 * i, " ".join(common + own + [word()])), (2 * i + 1, " ".join(common + own + [word()]))]
    sets = [sets_of(t) for _, t in rows]
    assert similarity(sets[0], sets[1]) >= 0.8 > max(similarity(sets[0], s) for s in sets[2:])
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert sorted(r.doc_id for r in near_copies.keep_one(docs).collect()) == list(range(0, 600, 2))
