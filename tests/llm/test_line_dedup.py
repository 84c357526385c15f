from __future__ import annotations

import time
from hashlib import md5

from test_common import shuffle_files

from listenlake.llm import common, line_dedup
from listenlake.llm.line_dedup import _eligible, kept_lines

SCHEMA = "doc_id bigint, doc_hash bigint, line_no int, id1 bigint, id2 bigint, anchors array<bigint>"


def test_shuffle_files_of_anchors_and_variants_go_before_texts_are_exchanged(spark, monkeypatch):
    monkeypatch.setattr(common, "RELEASE_EVERY", 10**9)  # no luck by how many tables were stored before
    text = lambda i: "\n".join(md5(f"{i // 2} {k}".encode()).hexdigest() + "ab"[i % 2] for k in range(5))
    rows = [(i, text(i)) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    calls, left = [], []

    def counted(session, wait):
        before = shuffle_files(session)
        common.released(session, wait)
        for _ in range(20):
            if shuffle_files(session) < before:
                break
            time.sleep(0.2)
        calls.append(before)
        left.append(shuffle_files(session))

    monkeypatch.setattr(line_dedup, "released", counted)
    stay = kept_lines(docs)
    assert len(calls) == 2 and all(a < b for a, b in zip(left, calls))
    # Documents 2k and 2k + 1 differ by one letter a line.
    assert sorted({r["doc_id"] for r in stay.collect()}) == list(range(0, 40, 2)) and stay.count() == 100


def test_lines_share_an_anchor_only_with_another_line(spark):
    rows = [
        (1, 1, 0, 10, 0, [7, 7, 8]),  # an anchor twice in one line is no partner
        (1, 1, 1, 11, 0, [5, 6]),
        (1, 1, 2, 12, 0, [6]),
        (1, 1, 3, 13, 0, []),
        (1, 1, 4, 10, 9, [7]),  # another line with the same first half of its hash
    ]
    found = _eligible(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["id1"], r["id2"]) for r in found.collect()) == [(11, 0), (12, 0)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # anchors once, lines once; pairs are not made distinct before
