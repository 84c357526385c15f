"""What a catalogue makes of users stays in the partition of the user: it is not exchanged, stored or sorted again."""

from __future__ import annotations

import os
import random
from datetime import datetime

import pytest
from conftest import rows

from listenlake import schemas
from listenlake.operators import keyed as K
from listenlake.operators.ranking import top_rank_by_user, top_rank_normalised
from listenlake.operators.recommend import without_excluded
from listenlake.plans import candidates as C
from listenlake.plans.merge import merge_candidates
from listenlake.sources.shared import shared_dir
from listenlake.sources.testbed import Testbed

COUNTS = "username string, track_id string"
SOURCES = "username string, artist_id string, artist_name string, play_count bigint"


def listed(*expected):
    return sorted(expected, key=str)


def exchanges(df):
    """Exchanges that Spark put in for what an operator needs."""
    return df._jdf.queryExecution().executedPlan().toString().count("ENSURE_REQUIREMENTS")


@pytest.fixture
def made(spark, monkeypatch):
    monkeypatch.setattr(K, "USERS_PER_TASK", 1)

    class Made:
        plays = spark.createDataFrame([("u", "one|x"), ("u", "old|x"), ("v", "two|y"), ("v", "two|y")], COUNTS)
        sources = spark.createDataFrame([("u", "a", "A", 3), ("u", "b", "B", 5), ("v", "a", "A", 2), (None, "a", "A", 1)], SOURCES)
        similar = spark.createDataFrame([("A", "X", 0.5, 1), ("B", "X", 0.4, 1), ("A", "Y", 0.25, 2)], schemas.SIMILAR_ARTISTS)
        top = spark.createDataFrame(
            [("X", "One", "X", 90, 10, 1), ("X", "Two", "Y", 90, 30, 2), ("Y", "Two", "Y", 90, 30, 1), ("Y", "Few", "Y", 1, 5, 2)],
            schemas.ARTIST_TOP_TRACKS,
        )
        albums = spark.createDataFrame([("A", "one|x", 7, "One", 2), ("B", "two|y", 4, "Two", 1), ("A", "three|x", 5, "Three", 1)],
                                       "artist_name string, track_id string, album_playcount bigint, track_name string, listings bigint")
        tags = spark.createDataFrame([("rock", "One", "x", 1), ("rock", "Two", "y", 2), ("indie", "One", "x", 1), ("indie", "Two", "y", 2)], schemas.TAG_TOP_TRACKS)
        profile = spark.createDataFrame([("u", "rock", 3), ("u", "indie", 2), ("v", "rock", 1)], "username string, tag string, tag_count bigint")

    return Made


def test_similar_artists_are_not_exchanged(made):
    out = C.similar_artist_candidates(made.plays, made.sources, made.similar, made.top, min_listeners=50)
    assert exchanges(out) == 0  # also where a track under two artists is ranked
    assert rows(out, "username", "track_id", "score", "source_artist_id") == listed((None, "one|x", 5.0, "a"), (None, "two|y", 15.0, "a"), ("u", "two|y", 60.0, "b"), ("v", "one|x", 10.0, "a"))


def test_similar_artists_listed_once(made):
    single = made.top.filter("NOT (artist_name = 'X' AND track_name = 'Two')")
    out = C.similar_artist_candidates(made.plays, made.sources, made.similar, single, min_listeners=50)
    assert exchanges(out) == 0
    assert rows(out, "username", "track_id", "score") == listed((None, "one|x", 5.0), (None, "two|y", 7.5), ("u", "two|y", 22.5), ("v", "one|x", 10.0))


def test_similar_artist_funnel_is_summed_from_the_catalogue(made):
    out = C.similar_artist_funnel(made.plays, made.sources, made.similar, made.top, min_listeners=50)
    assert rows(out) == listed((None, 4, 1, 0, 3), ("u", 6, 1, 2, 3), ("v", 4, 1, 2, 1))
    assert exchanges(out) == 0


def test_deep_cuts_and_their_funnel(spark, made):
    twice = made.sources.unionByName(spark.createDataFrame([("u", "a2", "A", 9)], SOURCES))
    out = C.deep_cut_candidates(made.plays, twice, made.albums)
    assert exchanges(out) == 0
    assert rows(out, "username", "track_id", "score", "source_artist_id") == listed((None, "one|x", 7.0, "a"), (None, "three|x", 5.0, "a"), ("u", "three|x", 45.0, "a2"), ("u", "two|y", 20.0, "b"), ("v", "one|x", 14.0, "a"), ("v", "three|x", 10.0, "a"))
    funnel = C.deep_cut_funnel(made.plays, twice, made.albums)
    assert rows(funnel) == listed((None, 3, 0, 3), ("u", 7, 4, 3), ("v", 3, 0, 3))
    assert exchanges(funnel) == 0
    free = made.albums.withColumn("album_playcount", made.albums["album_playcount"] * 0)
    assert rows(C.deep_cut_candidates(made.plays, twice, free).filter("username = 'u' AND track_id = 'three|x'"), "source_artist_id") == listed(("a",))


def test_tag_funnel_and_candidates(made):
    out = C.similar_tag_funnel(made.plays, made.profile, made.tags)
    assert rows(out) == listed(("u", 2, 0, 1, 1), ("v", 2, 2, 0, 0))
    assert exchanges(out) == 0
    found = C.similar_tag_candidates(made.plays, made.profile, made.tags)
    assert rows(found, "username", "track_id", "source_tags") == listed(("u", "two|y", "indie,rock"))
    assert exchanges(found) <= 1  # the lists of the catalogue


def test_tag_profile_is_dealt_once(spark, made):
    tracks = spark.createDataFrame([("one|x", "a"), ("old|x", "a"), ("two|y", "b")], "track_id string, artist_id string").coalesce(1)
    artists = spark.createDataFrame([("a", "rock,indie"), ("b", "rock")], "artist_id string, tags string")
    out = C.tag_profile(made.plays, tracks.hint("broadcast"), artists.hint("broadcast"))
    assert exchanges(out) == 1  # of the plays, to their distinct tracks
    assert rows(out, "username", "tag", "tag_count") == listed(("u", "rock", 2), ("u", "indie", 2), ("v", "rock", 1))


def test_a_long_catalogue_is_joined_by_its_key(spark, made, monkeypatch):
    monkeypatch.setattr(K, "TOLD_ROWS", 0)
    monkeypatch.setattr(K.expanded, "__defaults__", (0,))
    monkeypatch.setattr(K.told, "__defaults__", (0,))
    out = C.similar_artist_candidates(made.plays, made.sources, made.similar, made.top, min_listeners=50)
    assert rows(out, "username", "track_id", "score") == listed((None, "one|x", 5.0), (None, "two|y", 15.0), ("u", "two|y", 60.0), ("v", "one|x", 10.0))
    assert rows(C.deep_cut_funnel(made.plays, made.sources, made.albums)) == listed((None, 3, 0, 3), ("u", 4, 2, 2), ("v", 3, 0, 3))


def test_top_ranks_by_user_are_the_same(spark):
    draw = random.Random(7)
    data = [(u, s, f"t{i}", draw.choice([None, 1.0, 2.0, 2.5, -0.0, 0.0, float(i)])) for u in ("a", "b", None) for s in ("x", "y") for i in range(30)]
    df = spark.createDataFrame(data, "username string, source string, track_id string, score double")
    for n in (1, 5, 100):
        by = ["username", "source"]
        assert rows(top_rank_by_user(df, n, by), *df.columns, "normalized_score") == rows(top_rank_normalised(df, n, by), *df.columns, "normalized_score")


def test_merge_is_not_exchanged(spark, made):
    similar = C.similar_artist_candidates(made.plays, made.sources, made.similar, made.top.filter("artist_name = 'Y'"), min_listeners=50)
    deep = C.deep_cut_candidates(made.plays, made.sources, made.albums)
    tag = C.similar_tag_candidates(made.plays, made.profile, made.tags)
    old = spark.createDataFrame([("u", "old|x", 2.0)], "username string, track_id string, score double")
    tracks = spark.createDataFrame(
        [("two|y", "Two", "Y", 1, "t", "video", "s"), ("three|x", "Three", "X", 1, "t", "video", "s"), ("old|x", "Old", "X", 1, "t", None, "s"),
         ("old|x", "Old", "X", 1, "t", None, "s")],
        "track_id string, track_name string, artist_name string, duration_ms bigint, tags string, youtube_url string, spotify_url string")
    artists = spark.createDataFrame([("a", "A"), ("b", "B")], "artist_id string, artist_name string")
    merged = merge_candidates(made.plays, similar, tag, deep, old, tracks, artists)
    assert exchanges(merged) <= 1  # the lists of the tags
    assert rows(merged.filter("username IN ('u', 'v')"), "username", "track_id", "similar_artist", "similar_tag", "deep_cut_same_artist", "old_favorite") == listed(("u", "old|x", False, False, False, True), ("u", "two|y", True, False, False, False),
        ("v", "one|x", False, False, True, False), ("v", "three|x", False, False, True, False))
    gone = K.by_user(spark.createDataFrame([("u", "X")], "username string, artist_name string"), K.user_tasks(made.plays))
    left = without_excluded(merged, None, gone)
    assert exchanges(left) == exchanges(merged)
    assert "old|x" not in [r.track_id for r in left.collect()]


def test_candidates_are_not_stored(spark, tmp_path):
    def put(name, data, schema):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    put("part", [(i, f"song {i}", f"Brand#{i % 3 + 1}", "PROMO", i + 9) for i in range(9)],
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int")
    put("orders", [(i, i % 3, datetime(1999, 1, i + 1), "1-URGENT") for i in range(9)],
        "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp, o_orderpriority string")
    put("lineitem", [(i, (i * k) % 9, k, "N") for i in range(9) for k in range(1, 4)],
        "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_returnflag string")
    put("embeddings", [(i, [1.0, float(i)]) for i in range(5)], "vec_id bigint, embedding array<float>")
    seen = {os.path.join(d, n) for d, names, _ in os.walk(shared_dir(spark)) for n in names}
    found = Testbed(spark, str(tmp_path)).candidates()
    assert found.columns == schemas.TRACK_CANDIDATES.names
    kept = {n for d, names, _ in os.walk(shared_dir(spark)) for n in names if os.path.join(d, n) not in seen}
    assert "track_play_count" in kept
    assert not kept & {"track_candidates", "candidate_similar_artist", "candidate_similar_tag", "candidate_deep_cut"}
