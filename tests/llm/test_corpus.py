"""Toxicity by its accuracy, and the pipeline by its stages' contracts."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from listenlake.llm import toxicity
from listenlake.llm.common import staged
from listenlake.llm.ops_toxicity import op1_toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(draw, count=400):
    """Documents of invented words; every eighth is toxic by one of a few words or by a word beginning."""
    rows, labels = [], []
    for i in range(count):
        words = ["".join(draw.choices("abcdefgh", k=draw.randrange(2, 7))) for _ in range(draw.randrange(20, 80))]
        toxic = i % 8 == 0
        if toxic:
            bad = [draw.choice(["nasty", "vile", "rotten", "zork" + draw.choice("abcdefgh") * 2]) for _ in range(3)]
            for b in bad:
                words.insert(draw.randrange(len(words)), b)
        text = " ".join(words)
        rows.append((i, text, "en", "s", len(text)))
        if i % 2 == 0:
            labels.append((i, 0, int(toxic)))
    return rows, labels


def test_held_out_toxicity(spark):
    rows, labels = corpus(random.Random(2))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "vile nasty rotten things", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS).withColumn("x", F.lit("clash"))
    labels = labels + [(3, 0, None), (None, 0, 1), (labels[0][0], 0, 0)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model, seen = toxicity.fit(docs, marks)
    got = [(r.doc_id, r.score) for r in toxicity.scored(seen, model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    right = np.mean([(by[i] >= 0.5) == (i % 8 == 0) for i in range(400)])
    assert right > 0.98 and by[None] >= 0.5 and by[1000] == by[1001] < 0.5
    assert "zork" in model.stems or any(w.startswith("zork") for w in model.words)
    clean = toxicity.drop_toxic(docs, marks)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, s in got if s < 0.5}


def test_scores_come_through_posteriors(spark, monkeypatch):
    """Without what the label model says, labels alone tell no document from another."""
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    plain = toxicity.label_model

    def flat(patterns, prior):
        posterior, rates, shares = plain(patterns, prior)
        return np.full(len(posterior), 0.5), rates, shares

    monkeypatch.setattr(toxicity, "label_model", flat)
    model, seen = toxicity.fit(docs, marks)
    scores = [r.score for r in toxicity.scored(seen, model).collect()]
    assert len(scores) == docs.count() and max(scores) - min(scores) < 1e-3


def test_toxicity_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3)], DOCUMENTS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model, seen = toxicity.fit(docs, none)
    assert [r.score for r in toxicity.scored(seen, model).collect()] == [0.01]
    model, seen = toxicity.fit(docs.limit(0), none)
    assert toxicity.scored(seen, model).count() == 0
    assert toxicity.drop_toxic(docs, none).count() == 1


def test_label_model_weighs_correlated_voters_less():
    rng = np.random.default_rng(5)
    y = rng.random(20_000) < 0.2
    x = np.zeros((len(y), toxicity.VOTERS), int)
    for k in range(6):
        x[:, k] = rng.random(len(y)) < np.where(y, 0.6, 0.02)
    x[:, 6], x[:, 7] = x[:, 0], x[:, 0]  # two copies of one voter
    x[:, -1] = x[:, :8].sum(axis=1) == 0
    bits, n = np.unique(x @ (1 << np.arange(toxicity.VOTERS)), return_counts=True)
    patterns = [(int(b), int(c)) for b, c in zip(bits, n)]
    posterior, rates, shares = toxicity.label_model(patterns, 0.2)
    # Abstaining says nothing in this model, so one vote alone leans a document to toxic.
    assert abs(rates[1, 0] - 0.6) < 0.15 and rates[1, 1] < 0.05
    assert np.allclose(shares[[0, 6, 7]], 1 / 3, atol=0.05) and (shares[1:6] > 0.9).all()
    truth = dict(zip(bits.tolist(), posterior))
    guess = np.array([truth[b] for b in x @ (1 << np.arange(toxicity.VOTERS))])
    votes = x[:, :6].sum(axis=1)
    assert (guess[votes >= 2] > 0.9).all() and (guess[votes == 0] < 0.05).all()
    # A vote that is counted three times over moves a document no further than one that is counted once.
    odds = lambda p: np.log(p / (1 - p))
    one = [odds(truth[b]) for b in (0b11000001, 0b10)]
    assert abs(one[0] - one[1]) < 0.5


def test_op1_on_a_table(spark):
    folder = "/root/testdata/sf0.01"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = op1_toxicity(spark, folder).collect()
    assert len(rows) == 1000 and all(r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in marks]
    assert np.mean([r.predicted == marks[r.doc_id] for r in held]) > 0.95


def test_pipeline_stages(spark, tmp_path):
    rows, labels = corpus(random.Random(7), 160)
    line = "a line that many of the documents have in common, word by word"
    rows += [(500 + i, f"{line}\nbody of {i} " + "w" * i, "en", "s", 0) for i in range(4)]
    copy = rows[1][1]
    rows += [(600, copy, "en", "t", len(copy)), (601, None, None, None, None), (602, "", "en", "s", 0)]
    secret = 'then token = "9f8e7d6c5b4a39281706f5e4d3c2b1a0" was set for the service'
    rows += [(603, secret, "en", "s", len(secret))]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs, before = staged(stage(spark, docs, str(tmp_path))), docs
        if name != "packing":
            assert docs.columns == before.columns and docs.schema == before.schema
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {r[0] for r in rows} - {i for i in range(0, 160, 8)}
    assert set(kept["toxicity"]) == clean
    assert set(kept["line_dedup"]) == clean
    assert [line in kept["line_dedup"][500 + i] for i in range(4)] == [True, False, False, False]
    assert kept["line_dedup"][600] == "" and kept["line_dedup"][601] is None
    assert set(kept["simhash"]) == clean - {601, 602}  # with 600, the texts without words are one group
    assert "9f8e" not in kept["secrets"][603] and set(kept["secrets"]) == set(kept["simhash"])
    placed = docs.collect()
    assert {r.doc_id for r in placed} == set(kept["secrets"])
    direct = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, direct)) == sorted(map(key, placed))


def test_line_stage_drops_short_equal_lines(spark):
    rows = [(i, f"body of {i}\n  All rights reserved.\n\n}}\nend {i}") for i in range(6)]
    rows += [(10, "All rights reserved!"), (11, "All rights reserved.\nAll rights reserved."), (12, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, n_chars long").repartition(3)
    got = {r.doc_id: r for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert got[0].text == rows[0][1]
    assert all(got[i].text == f"body of {i}\n\n}}\nend {i}" and got[i].n_chars == len(got[i].text) for i in range(1, 6))
    assert got[10].text == "All rights reserved!" and got[11].text == "" and got[12].text is None  # no edits on short lines


def test_texts_without_a_label_stay_out_of_the_exchange(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.unionByName(docs.filter("doc_id = 7")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    marks = spark.range(0, 8000, 40).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias("toxic"))
    marks = marks.unionByName(spark.createDataFrame([(7, 1)], "doc_id bigint, toxic int"))
    made = toxicity._labelled(docs, marks)
    want = docs.join(marks, "doc_id")
    assert sorted(map(tuple, made.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "bitmap_construct_agg" in plan and "strategy=merge" in plan
    assert toxicity._labelled(docs, marks.limit(0)).isEmpty()


def test_simhash_stage_links_by_fingerprints(spark):
    """Texts that repeat one passage and end differently: fingerprints are equal, the Jaccard similarity is below a half."""
    texts = ["one two three four five " * 40 + end for end in ("six seven eight", "ten eleven twelve")]
    rows = [(1, texts[0], "en", "web", 9), (2, texts[1], "en", "web", 9), (3, "something else that stands alone here", "en", "web", 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = corpus_pipeline.simhash_stage(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]
