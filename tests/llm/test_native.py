"""Secret scan and sketches against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re

import xxhash
from pyspark.sql import functions as F

from listenlake.llm import secrets, sketch
from listenlake.llm.ops_native import op8_secret_scan, op10_fingerprint

BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
    "access": ("AKIA[A-Z0-9]+", 0),
    "hex": ("[0-9a-f]+", 0),
}


def brute_base(text):
    out = []
    for k, (name, (pattern, flags)) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text, flags):
            if (len(m[2]) >= 12) if k == 0 else len(m[0]) >= (18 if k == 1 else 16):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def brute_entropy(text, window=20):
    out = []
    for c in secrets.CLASSES:
        for m in re.finditer(f"[{c.run}]{{{window},}}", text):
            s = m[0]
            if not all(re.search(p, s) for p in c.must) or any(re.search(p, s) for p in secrets.ALLOW):
                continue
            hot = []
            for i in range(len(s) - window + 1):
                w = s[i : i + window]
                total = sum(round(1e6 * n * math.log2(n)) for n in (w.count(x) for x in set(w)) if n)
                if total <= math.floor(1e6 * window * (math.log2(window) - c.least_bits)):
                    hot.append(i)
            if hot:
                out.append((m.start() + hot[0], secrets.KINDS.index(c.kind), m.start() + hot[-1] + window))
    return out


def secret_texts():
    draw = random.Random(8)
    parts = [
        "token", "TOKEN", "password", "api_key", "ſecret", " = ", ": ", "='", '"', " ", "\n", "é", "😀", "token=abc",
        "AKIA", "abcdefghijklmnop", "0123456789abcdef", "deadbeef", "Zz9/+_-=", "example", "KEY=secret: abcdefghijkl",
    ]
    texts = ["".join(draw.choices(parts, k=draw.randrange(0, 14))) for _ in range(300)]
    for n in (18, 40, 64, 500):
        texts.append("x " + "".join(draw.choices("0123456789abcdef", k=n)) + " é")
        texts.append("y=" + "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=n)))
        texts.append("AKIA" + "".join(draw.choices("ABCDEFGH0123", k=n)))
    return [*texts, "", "a" * 5000, "6f1c2b34-9a8d-4c3e-b1f0-0a1b2c3d4e5f"]


def test_findings_and_masks(spark):
    texts = secret_texts()
    docs = spark.createDataFrame(
        [(i, t, "s") for i, t in enumerate(texts)] + [(None, None, None)], "doc_id long, text string, findings string"
    )
    rows = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    assert rows[None].findings == []
    found = 0
    for i, t in enumerate(texts):
        base, added = brute_base(t), brute_entropy(t)
        assert [(s.start, s.kind, s.end) for s in rows[i].base_findings] == base, t
        assert [(s.start, s.kind, s.end) for s in rows[i].findings] == sorted(base + added), t
        found += len(added)
    assert found > 5
    masked = secrets.redact(docs.withColumn("n_chars", F.length("text").cast("long")))
    assert masked.columns == ["doc_id", "text", "findings", "n_chars"]
    for r in masked.collect():
        if r.doc_id is None:
            assert r.text is None
            continue
        t, out, at = texts[r.doc_id], "", 0
        for s, _, e in sorted(brute_base(t) + brute_entropy(t)):
            if s > at or not out:
                out += t[at:s] + secrets.MARK
            at = max(at, e)
        assert r.text == out + t[at:] and r.n_chars == len(r.text)
    assert secrets.redact(docs.limit(0)).count() == 0


def test_op8_on_a_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op8_secret_scan(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    names = ("assign", "access", "hex")
    for r in rows:
        base = brute_base(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == n for _, k, _ in base) for n in range(3)]
        text = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()


# ---- sketches


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def chained(hashes):
    h = 42
    for x in hashes:
        h = xxhash.xxh64_intdigest((x % (1 << 64)).to_bytes(8, "little"), h)
    return signed(h)


def brute_sketch(text, k=sketch.K, width=sketch.WORDS):
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    if not hashes:
        return []
    return sorted({chained(hashes[i : i + width]) for i in range(max(1, len(hashes) - width + 1))})[:k]


def brute_likeness(a, b, k=sketch.K):
    if not a and not b:
        return 1.0
    union = sorted({*a, *b})[:k]
    return len(set(union) & set(a) & set(b)) / len(union)


def test_op10_against_brute_force(spark, tmp_path):
    draw = random.Random(2)
    words = ["a", "bé", "c😀", "dd", " ", "e"]
    texts = [" ".join(draw.choices(words, k=draw.choice([0, 1, 4, 5, 30, 400]))) for _ in range(60)] + [None, "", "x\n\ty"]
    rows = [(i * 7 % 200, t, i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, next int").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op10_fingerprint(spark, str(tmp_path)).collect()}
    ordered = sorted((d, t or "") for d, t, _ in rows)
    assert len(got) == len(ordered)
    for i, (d, t) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + after[:cut]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(after)
        r = got[d]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == "".join(f"{h % (1 << 64):016x}" for h in a)
        assert r.edited_fingerprint == "".join(f"{h % (1 << 64):016x}" for h in b)
        assert abs(r.near_edited - brute_likeness(a, b)) < 1e-12 and abs(r.near_next - brute_likeness(a, c)) < 1e-12
    one = spark.createDataFrame([(None, "a b c d")], "doc_id long, text string")
    assert sketch.with_next(one).first().next.text == "a b c d"
    assert sketch.with_next(one.limit(0)).count() == 0


def test_sketches_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(2000)]
    parts = [(1, " ".join(words[:1200])), (1, " ".join(words[1196:])), (2, " ".join(words)), (3, None)]
    df = spark.createDataFrame(parts, "g int, text string").withColumn("s", sketch.sketch(F.col("text")))
    merged = {r.g: list(r.s) for r in sketch.merge_sketches(df, ["g"], "s").collect()}
    assert merged[1] == merged[2] == brute_sketch(" ".join(words)) and merged[3] == []
    half = spark.createDataFrame([(" ".join(words), " ".join(words[:1000]))], "a string, b string")
    half = half.select(sketch.sketch(F.col("a")).alias("a"), sketch.sketch(F.col("b")).alias("b"))
    r = half.select(
        sketch.resemblance(F.col("a"), F.col("b")).alias("j"),
        sketch.containment(F.col("b"), F.col("a")).alias("c"),
        sketch.distinct_shingles(F.col("a")).alias("n"),
        (sketch.sketch_of_hex(sketch.sketch_hex(F.col("a"))) == F.col("a")).alias("back"),
    ).first()
    assert abs(r.j - 0.5) < 0.15 and r.c > 0.8 and abs(r.n - 1996) < 500 and r.back


def test_places_and_masks_over_many_blocks(spark):
    draw = random.Random(8)
    texts = ["", "deadbeefdeadbeef"]
    for n in (255, 256, 257, 700):
        gap = lambda: draw.choice([" ", "", " é ", "\n"])
        texts.append("".join(gap() + draw.choice(["deadbeefdeadbeef", "AKIA" + "A" * 14, "x"]) for _ in range(n)) + gap())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in secrets.find_secrets(docs).collect()}
    masked = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    for i, text in enumerate(texts):
        assert sorted((f.start, f.kind, f.end) for f in rows[i].base_findings) == sorted(brute_base(text))
        out, at = "", 0
        for a, _, b, *_ in rows[i].findings:
            if a > at or not out:
                out += text[at:a] + secrets.MARK
            at = max(at, b)
        assert masked[i] == out + text[at:]
