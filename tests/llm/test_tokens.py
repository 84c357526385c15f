"""Encoders against the libraries; packing and training order by their contracts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from listenlake.llm import packing, pieces, training_order, word_tokens
from listenlake.llm.ops_tokens import op2_best_fit_packing

ODD = list("abAB  é'’. \n\t1２<|>ßÉñİſΣς▁́　\xa0\x00\x1f😀한中️₂") + [
    "'s", "'ll", " the", "<|endoftext|>", "<0x41>", "</s>", "   ",
]


def odd_texts(count, seed=1):
    draw = random.Random(seed)
    texts = ["".join(draw.choices(ODD, k=draw.randrange(0, 40))) for _ in range(count)]
    return [*texts, "", " ", "a" * 3000, "ab" * 1000 + "  x", "\n\n a \n", "é" * 900, " " * 700]


def test_word_ids_are_those_of_the_library():
    texts = odd_texts(1500)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    tok = word_tokens.WordTokenizer(word_tokens.default_path())
    assert [np.frombuffer(b, "<u4").tolist() for b in tok.encode(texts)] == expected


def test_words_are_cut_at_any_block_and_forgotten(monkeypatch):
    draw = random.Random(5)
    parts = ["'", "'s", "'LL", "re", "!", "<|", "|>", " ", "\n", "\t", "7", "42", "É", "×", "÷", "Þ", "ÿ", "Ā", "\u0301", "中", "x" * 17, "=" * 40]
    texts = ["".join(draw.choices(parts, k=draw.randrange(0, 40))) for _ in range(3000)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(word_tokens, "BLOCK", 100)
    monkeypatch.setattr(word_tokens, "KEPT", 50)
    assert word_tokens.WordTokenizer(word_tokens.default_path()).encode(texts) == expected


def test_op2_ids_are_those_of_the_library(spark):
    directory = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = set()
    for row in spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text").collect():
        ids = [*library.encode(row.text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[a : a + 2048], "<u4").tobytes()
            expected.add((row.doc_id, k, a, len(part) // 4, zlib.crc32(part)))
    got = op2_best_fit_packing(spark, directory).select("doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_pieces_are_those_of_the_library(spark):
    texts = odd_texts(1500, 2)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = [library.encode(t, add_eos=True) for t in texts]
    tok = pieces.PieceTokenizer(pieces.default_path())
    assert [tok.encode(t) for t in texts] == expected
    counts, numbers, decoded = tok.texts(texts)
    assert counts == list(map(len, expected))
    assert numbers == [" ".join(map(str, e)) for e in expected]
    assert decoded == [library.decode(e) for e in expected] == [tok.decode(e) for e in expected]

    rows = [(1, texts[0]), (2, None), (2, None), (None, "x y")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, ids int")
    made = pieces.encode(docs)
    by = sorted(((r.doc_id or 0, list(r.ids)) for r in made.collect()), key=str)
    assert by == sorted(((d or 0, library.encode(t or "", add_eos=True)) for d, t in rows), key=str)
    assert {r.text for r in pieces.decode(made).collect()} == {library.decode(expected[0]), "", "x y"}
    assert pieces.digests(docs.limit(0)).count() == 0


def test_long_words_merge_like_short_ones():
    tok = word_tokens.tokenizer(word_tokens.default_path())
    draw = random.Random(4)
    for _ in range(30):
        raw = np.array([draw.choice(b"abe") for _ in range(draw.randrange(2, 60))], np.uint8)
        symbols = tok.inner[raw]
        flat, _ = tok.merges.merge(symbols, np.array([len(raw)]))
        assert tok.merges.one_word(symbols.tolist()) == flat.tolist()


# ---- packing


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_places_every_piece(spark):
    draw = random.Random(5)
    texts = [" ".join(["word"] * draw.randrange(0, 300)) for _ in range(300)] + [None, "", "a " * 700]
    docs = spark.createDataFrame([(i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, uid string")
    rows = packing.pack_documents(docs, capacity=256).collect()
    sequences = check_packing(rows, 256)
    assert sum(r.length for r in rows) == sum(len((t or "").split()) + 1 for t in texts)
    assert all(r.start == 256 * r.piece for r in rows)
    assert sequences <= 1.02 * -(-sum(r.length for r in rows) // 256) + 1
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_packing_of_several_shards_beats_first_guess(spark):
    draw = np.random.default_rng(1)
    sizes = draw.integers(200, 1100, 3000)
    items = spark.createDataFrame([(i, int(s)) for i, s in enumerate(sizes)], "uid long, size int")
    places = packing.pack(items, shard=700).collect()
    assert len({r.uid for r in places}) == len(places) == 3000
    load = {}
    for r in places:
        load[r.sequence_id] = load.get(r.sequence_id, 0) + int(sizes[r.uid])
    assert max(load.values()) <= 2048
    founder = packing.founder(sizes.astype(np.int64), np.random.default_rng(0), 0.0, 2048).max() + 1
    assert len(load) <= founder + 5


def test_children_are_packings():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 900, 400).astype(np.int64)
    a, b = (packing.founder(sizes, rng, noise, 1000) for noise in (0.0, 0.2))
    for _ in range(20):
        child = packing.crossed(sizes, a, b, rng, 1000)
        assert len(child) == 400 and np.bincount(child, weights=sizes).max() <= 1000
        a, b = b, child
    best = packing.evolved(sizes, [], 1, 4, 4, 1000)
    assert best == sorted(best, key=lambda x: -x[0]) or best[0][0] >= best[-1][0]


def test_op2_on_a_table(spark):
    rows = op2_best_fit_packing(spark, "/root/testdata/sf0.001").collect()
    assert check_packing(rows, 2048) <= -(-sum(r.length for r in rows) // 2048) + 2


# ---- training order


@pytest.mark.parametrize("n", [1, 2, 3, 100, 4097])
def test_permutation(n):
    p = training_order.Permutation(n, 9)
    slots = p.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert p.numbers(slots).tolist() == list(range(n))
    assert n < 100 or (slots != training_order.Permutation(n, 10).slots(np.arange(n))).any()


def test_training_order_round_trip(spark, tmp_path):
    texts = odd_texts(200, 6)
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate([*texts, None])], "doc_id long, text string, slot int")
    docs = docs.repartition(3)
    folder = str(tmp_path / "order")
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    made = sorted(training_order.materialise(stored, folder, length=64, per_shard=7).collect())
    reader = training_order.Reader(folder)
    got = list(reader.read())
    assert [r.slot for r in made] == list(range(len(got))) and len(reader) == len(got)
    assert [zlib.crc32(g.astype("<u4").tobytes()) for g in got] == [r.ids_crc32 for r in made]
    assert [g.tolist() for g in reader.read(11, 9)] == [g.tolist() for g in got[11:20]]
    # In order of their numbers the sequences are the documents' ids one after another, partition by partition.
    tok = word_tokens.tokenizer(word_tokens.default_path())
    stream = np.concatenate([got[r.slot] for r in sorted(made, key=lambda r: r.number)]).tolist()
    by_text = stored.rdd.glom().collect()
    expected = []
    for part in by_text:
        for r in part:
            expected += np.frombuffer(tok.encode([r.text or ""])[0], "<u4").tolist() + [0]
    assert stream == expected
    assert {d for r in made for d in r.doc_ids} == set(range(len(texts) + 1))
    empty = training_order.materialise(stored.limit(0), str(tmp_path / "none"))
    assert empty.count() == 0 and list(training_order.Reader(str(tmp_path / "none")).read()) == []
