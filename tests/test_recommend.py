from __future__ import annotations

import pytest
from conftest import rows

from listenlake import schemas
from listenlake.functions import links as L
from listenlake.operators import feedback as FB
from listenlake.operators import linking as LK
from listenlake.operators import recommend as RC

SONGS = [
    ("Song A", "Artist 1", 0.95, True, False, False, True),
    ("Song B", "Artist 2", 0.88, False, True, False, False),
    ("Song C", "Artist 1", 0.82, True, True, False, True),
    ("Song D", "Artist 3", 0.75, False, True, True, False),
    ("Song E", "Artist 2", 0.70, True, False, True, False),
]


@pytest.fixture
def candidates(spark):
    data = [
        ("u", f"{t}|{a}".lower(), t, a, s, sa, st, dc, old, "Src" if sa else None, 80.0 if sa else None, "a, b,a,c,d,e,f" if st else None, 3 if st else None, "Cut" if dc else "", 1, "t", f"https://youtu.be/{t[-1] * 11}" if t != "Song E" else None, None)
        for t, a, s, sa, st, dc, old in SONGS
    ]
    return spark.createDataFrame(data, schemas.TRACK_CANDIDATES)


@pytest.mark.parametrize(
    "tags, artists, cuts, expected",
    [(False, True, False, 3), (True, False, False, 3), (False, False, True, 2), (True, True, False, 5), (False, False, False, 0)],
)
def test_sources(candidates, tags, artists, cuts, expected):
    assert RC.filter_candidates(candidates, tags, artists, cuts).count() == expected


def test_exclusions_are_by_name_and_user(spark, candidates):
    tracks = spark.createDataFrame([("u", "Song A", "Artist 1"), ("other", "Song B", "Artist 2"), ("u", "Song B (Live)", "Artist 2")], "username string, track_name string, artist_name string")
    artists = spark.createDataFrame([("u", "Artist 1"), ("other", "Artist 2")], "username string, artist_name string")
    assert RC.without_excluded(candidates, tracks).count() == 4
    assert rows(RC.without_excluded(candidates, None, artists), "track_name") == [("Song B",), ("Song D",), ("Song E",)]


def test_weight_and_cap(candidates):
    got = {r.track_name: r.weighted_score for r in RC.filter_candidates(candidates, discovery_weight=1.0).collect()}
    assert got["Song A"] == pytest.approx(0.95 * 0.1) and got["Song B"] == pytest.approx(0.88 * 1.1)
    capped = RC.artist_cap(RC.filter_candidates(candidates, discovery_weight=0.5), 1)
    assert rows(capped, "track_name") == [("Song A",), ("Song B",), ("Song D",)]


def test_list_pool_and_refill(spark, candidates):
    pool = RC.recommend(candidates, n=2, max_songs_per_artist=5)
    assert rows(pool, "rank", "track_name", "shown") == [(1, "Song A", True), (2, "Song B", True), (3, "Song C", False), (4, "Song D", False), (5, "Song E", False)]
    assert pool.filter("rank = 1").first().score_pct == 100.0
    after = FB.exclude_and_refill(pool, spark.createDataFrame([("u", "Song B", "Artist 2")], "username string, track_name string, artist_name string"))
    assert rows(after, "track_name", "replacement") == [("Song A", False), ("Song C", True)]
    after = FB.exclude_and_refill(pool, None, spark.createDataFrame([("u", "Artist 1")], "username string, artist_name string"))
    assert rows(after, "track_name", "replacement") == [("Song B", False), ("Song D", True)]


def test_reasons(candidates):
    got = {r.track_name: r.reasons for r in RC.why_recommended(candidates).collect()}
    assert got["Song A"].similar_artist.source_artist == "Src" and got["Song A"].similar_tag is None
    assert got["Song C"].similar_tag.tags == ["a", "b", "c", "d", "e"]
    assert got["Song D"].deep_cut.source_artist == "Cut" and got["Song A"].deep_cut is None


def test_export(candidates):
    shown = RC.recommend(candidates, n=5, max_songs_per_artist=5).filter("shown")
    out = LK.export_list(shown, limit=4, owner_limit=4)
    assert rows(out, "position", "platform_id", "missing_url") == [(1, "A" * 11, False), (2, "B" * 11, False), (3, "C" * 11, False), (4, "D" * 11, False)]
    full = LK.export_list(shown, url="youtube_url", identify=L.video_id)
    assert rows(LK.export_summary(full)) == [("u", 4, 1, 1)]
    assert rows(RC.page_counts(shown)) == [("u", 5, 3, 2)]


def test_exclusion_store(spark):
    schema = schemas.table("username string, track_id string, excluded_at bigint")
    stored = spark.createDataFrame([("u", "a", 1), ("u", "b", 1)], schema)
    put = FB.put_exclusions(stored, spark.createDataFrame([("u", "a", 5)], schema), ["username", "track_id"])
    assert rows(put, "track_id", "excluded_at") == [("a", 5), ("b", 1)]
