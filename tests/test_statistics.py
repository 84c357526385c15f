from __future__ import annotations

import math
from datetime import datetime

from conftest import rows

from listenlake.operators import dimensions as D
from listenlake.operators import ranking as R
from listenlake.operators import statistics as ST

AS_OF = "2025-01-21 00:00:00"
PLAYS = [
    ("user1", "2025-01-01", "Song A|Artist X", "Song A", "Artist X"),
    ("user1", "2025-01-05", "Song A|Artist X", "Song A", "Artist X"),
    ("user1", "2025-01-10", "Song B|Artist Y", "Song B", "Artist Y"),
    ("user1", "2025-01-15", "Song A|Artist X", "Song A", "Artist X"),
    ("user2", "2025-01-01", "Song C|Artist Z", "Song C", "Artist Z"),
    ("user2", "2025-01-20", "Song C|Artist Z", "Song C", "Artist Z"),
]


def plays(spark):
    df = spark.createDataFrame(PLAYS, "username string, t string, track_id string, track_name string, artist_name string")
    return df.withColumn("scrobbled_at_utc", df.t.cast("timestamp")).drop("t")


def half_lives(spark):
    return spark.createDataFrame([("user1", 30.0), ("user2", 30.0)], "username string, user_half_life_days double")


def test_track_counts(spark):
    got = {(r.username, r.track_id): r for r in ST.track_play_counts(plays(spark), half_lives(spark), AS_OF).collect()}
    a, b = got["user1", "Song A|Artist X"], got["user1", "Song B|Artist Y"]
    assert (a.play_count, a.days_since_last_play, a.last_played_on) == (3, 6, datetime(2025, 1, 15))
    expected = sum(math.exp(-d / 30) for d in (20, 16, 6)) / 3
    assert abs(a.recency_score - expected) < 1e-12 and b.recency_score > 0
    assert all(0 < r.recency_score <= 1 for r in got.values())


def test_look_back(spark):
    recent = ST.track_play_counts(ST.look_back(plays(spark), AS_OF, 10), half_lives(spark), AS_OF)
    assert rows(recent.filter("username = 'user1'"), "track_id", "play_count") == [("Song A|Artist X", 1)]


def test_artist_counts(spark):
    tracks = spark.createDataFrame([("Song A|Artist X", "x"), ("Song C|Artist Z", "z")], "track_id string, artist_id string")
    artists = spark.createDataFrame([("x", "Artist X"), ("z", "Artist Z")], "artist_id string, artist_name string")
    out = ST.artist_play_counts(plays(spark), half_lives(spark), tracks, artists, AS_OF)
    got = rows(out, "username", "artist_id", "artist_name", "play_count", "days_since_last_play")
    assert got == [("user1", "x", "Artist X", 3, 6), ("user1", None, None, 1, 11), ("user2", "z", "Artist Z", 2, 1)]


def test_dim_users_whole_days(spark):
    df = spark.createDataFrame([("u", "2025-01-01 23:00:00"), ("u", "2025-01-02 01:00:00")], "username string, t string")
    out = D.dim_users(df.withColumn("scrobbled_at_utc", df.t.cast("timestamp"))).first()
    assert (out.listening_span_days, out.user_half_life_days, out.total_plays) == (0, 30.0, 2)


def brute_rank_share(scores):
    ranks = {s: sum(x < s for x in scores) + (scores.count(s) + 1) / 2 for s in scores}
    return {s: r / max(ranks.values()) for s, r in ranks.items()}


def test_rank_share_against_brute_force(spark):
    data = {"hot": [float(i * i % 97) for i in range(400)], "flat": [2.0] * 7, "one": [0.5], "wide": [0.0, 1e-9, 1e9, 1e9, 3.0]}
    scored = [(u, f"{u}{i}", s) for u, values in data.items() for i, s in enumerate(values)]
    df = spark.createDataFrame(scored, "username string, track_id string, score double")
    for bands in (1, 3, 1024):
        for r in R.rank_normalised(df, bands).collect():
            assert abs(r.normalized_score - brute_rank_share(data[r.username])[r.score]) < 1e-12
    top = R.top_rank_normalised(df, 5).collect()
    assert len(top) == 5 + 5 + 1 + 5
    for r in top:
        assert abs(r.normalized_score - brute_rank_share(data[r.username])[r.score]) < 1e-12


def test_sample_is_repeatable(spark):
    df = spark.createDataFrame([("big", f"a{i}") for i in range(500)] + [("small", f"a{i}") for i in range(5)], "username string, artist_id string")
    first = rows(R.sample_large(df, "artist_id", 30, 0.2))
    assert first == rows(R.sample_large(df.repartition(7), "artist_id", 30, 0.2))
    big = [r for r in first if r[0] == "big"]
    assert 50 < len(big) < 150 and len(first) - len(big) == 5
    assert first != rows(R.sample_large(df, "artist_id", 30, 0.2, seed=1))


def test_rows_without_a_score_stay(spark):
    df = spark.createDataFrame([("u", "a", 1.0), ("u", "b", None), ("u", "c", 3.0)], "username string, track_id string, score double")
    for ranked in (R.rank_normalised(df), R.top_rank_normalised(df, 5)):
        assert rows(ranked, "track_id", "normalized_score") == [("a", 0.5), ("b", None), ("c", 1.0)]
