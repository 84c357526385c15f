from __future__ import annotations

import pytest
from conftest import rows

from listenlake import schemas
from listenlake.operators import keyed as K
from listenlake.plans import candidates as C
from listenlake.plans.jobs import DEEP_CUT, SIMILAR_ARTIST, Jobs
from listenlake.plans.merge import merge_candidates


@pytest.fixture
def small(spark):
    class Small:
        plays = spark.createDataFrame([("user1", "known|artist a")], "username string, track_id string")
        tracks = spark.createDataFrame(
            [("known|artist a", "a1"), ("new track|artist b", "b1"), ("tag track|artist c", "c1")], "track_id string, artist_id string"
        )
        artists = spark.createDataFrame(
            [("a1", "Artist A", "rock,indie,alt"), ("b1", "Artist B", "indie"), ("c1", "Artist C", "rock")],
            "artist_id string, artist_name string, tags string",
        )
        counts = spark.createDataFrame(
            [("user1", "a1", 10), ("user1", "b1", 5), ("user1", "c1", 3)], "username string, artist_id string, play_count bigint"
        )

    return Small


def test_similar_artists(spark, small):
    similar = spark.createDataFrame([("Artist A", "Artist B", 0.5, 1), ("Artist A", "Artist A", 0.95, 2)], schemas.SIMILAR_ARTISTS)
    top = spark.createDataFrame(
        [
            ("Artist B", "New Track", "Artist B", 5000, 10000, 1),
            ("Artist B", "New Track (Live)", None, 5000, 4000, 2),
            ("Artist B", "Too Small", "Artist B", 10, 20, 3),
            ("Artist B", "Known", "Artist A", 5000, 10, 4),
        ],
        schemas.ARTIST_TOP_TRACKS,
    )
    played = C.user_artists(small.plays, small.tracks, small.artists, small.counts)
    sources = C.similar_artist_sources(played)
    out = C.similar_artist_candidates(small.plays, sources, similar, top)
    assert rows(out) == [("user1", "new track|artist b", "New Track", "Artist B", 0.5, 0.5 * 10 * 10000, "a1")]
    funnel = C.similar_artist_funnel(small.plays, sources, similar, top)
    assert rows(funnel) == [("user1", 4, 1, 1, 2)]
    done = out.select("username", "source_artist_id")
    assert "a1" not in [r.artist_id for r in C.similar_artist_sources(played, done).collect()]


def test_similar_artist_paths_against_brute_force(spark):
    """Best source per track chosen before and after the expansion is the same."""
    sources = [("u", f"s{i}", f"S{i}", (i * 7) % 5 + 1) for i in range(8)]
    edges = [(f"S{i}", f"N{j}", ((i * 3 + j * 5) % 9) / 10, j + 1) for i in range(8) for j in range(4)]
    top = [(f"N{j}", f"song {(j + k) % 6}x", "Someone", 5000, 100 * k + j, k + 1) for j in range(4) for k in range(5)]
    plays = spark.createDataFrame([("u", "song 1x|someone")], "username string, track_id string")
    src = spark.createDataFrame(sources, "username string, artist_id string, artist_name string, play_count bigint")
    out = C.similar_artist_candidates(
        plays, src, spark.createDataFrame(edges, schemas.SIMILAR_ARTISTS), spark.createDataFrame(top, schemas.ARTIST_TOP_TRACKS), similarity_threshold=0.7
    )
    best = {}
    for _, sid, name, n in sources:
        for a, b, match, _ in edges:
            for c, track, _, _, count, _ in top:
                if a == name and b == c and match <= 0.7 and track != "song 1x":
                    best[track] = max(best.get(track, 0), match * n * count)
    assert {r.track_name: r.score for r in out.collect()} == best


def test_tags(spark, small):
    listed = [("rock", "Rock Track A", "X", 1), ("rock", "Rock Track B", "X", 2), ("indie", "Rock Track A", "X", 1), ("alt", "Rock Track A (Live)", "X", 1), ("alt", "Rock Track A", "X", 2)]
    tag_tracks = spark.createDataFrame(listed, schemas.TAG_TOP_TRACKS)
    profile = C.tag_profile(small.plays, small.tracks, small.artists)
    assert rows(profile, "tag") == [("alt",), ("indie",), ("rock",)]
    out = C.similar_tag_candidates(small.plays, profile, tag_tracks, min_tag_matches=3)
    assert rows(out, "track_id", "tag_match_count", "score", "source_tags") == [("rock track a|x", 3, 3.0, "alt,indie,rock")]
    assert C.similar_tag_candidates(small.plays, profile, tag_tracks, previous=out).count() == 0
    none = spark.createDataFrame([], schemas.CANDIDATE_SIMILAR_TAG)
    assert C.similar_tag_candidates(small.plays, profile, tag_tracks, previous=none).count() == 1


def test_many_tags_fill_several_words(spark):
    tags = [f"t{i:03d}" for i in range(130)]
    profile = spark.createDataFrame([("u", t, 1) for t in tags], "username string, tag string, tag_count bigint")
    listed = spark.createDataFrame([(t, "Song", "A", 1) for t in tags], schemas.TAG_TOP_TRACKS)
    plays = spark.createDataFrame([], "username string, track_id string")
    out = C.similar_tag_candidates(plays, profile, listed, top_tags_count=130).first()
    assert (out.tag_match_count, out.source_tags) == (130, ",".join(tags))


def test_deep_cuts(spark, small):
    albums = spark.createDataFrame([("Artist A", "Album One", 10000, 1), ("Artist A", "Album Two", 1000000, 2), ("Artist A", "Rare", 5, 3)], schemas.ARTIST_TOP_ALBUMS)
    listed = [("Album One", "Artist A", "Hidden Gem", 1), ("Album One", "Artist A", "Known", 2), ("Album Two", "Artist A", "Popular Track", 1), ("Rare", "Artist A", "Nobody", 1)]
    played = C.user_artists(small.plays, small.tracks, small.artists, small.counts)
    catalogue = C.album_catalogue(albums, spark.createDataFrame(listed, schemas.ALBUM_TRACKS))
    out = C.deep_cut_candidates(small.plays, C.deep_cut_sources(played), catalogue)
    assert rows(out, "track_id", "score") == [("hidden gem|artist a", 100000.0), ("popular track|artist a", 10000000.0)]


def test_old_favorites(spark):
    data = [("u", "old", "2024-01-01"), ("u", "old", "2024-01-11"), ("u", "fresh", "2024-12-01"), ("v", "old", "2024-10-03")]
    plays = spark.createDataFrame(data, "username string, track_id string, t string")
    plays = plays.withColumn("scrobbled_at_utc", plays.t.cast("timestamp"))
    lives = spark.createDataFrame([("u", 60.0)], "username string, user_half_life_days double")
    got = {r.username: r for r in C.old_favorites(plays, "2025-01-01 00:00:00", lives).collect()}
    assert (got["u"].track_id, got["u"].play_count, got["u"].days_since_last_play) == ("old", 2, 356)
    assert got["u"].score == pytest.approx(2 * 2 ** (-356 / 60))
    assert got["v"].score == pytest.approx(2 ** (-90 / 30))


def test_cleanup_drops_what_was_played(spark, lake, small):
    stored = [("user1", "known|artist a", "Known", "Artist A", 1.0, "a1"), ("user1", "other|artist a", "Other", "Artist A", 1.0, "a1")]
    jobs = Jobs(lake)
    lake.write(small.plays, "silver/plays", "error", ["username"])
    report = jobs._store(spark.createDataFrame(stored, schemas.CANDIDATE_DEEP_CUT), DEEP_CUT)
    assert report.deleted == 1
    assert rows(lake.read(DEEP_CUT), "track_id") == [("other|artist a",)]
    assert not lake.exists(SIMILAR_ARTIST)


def merge_inputs(spark):
    return {
        "plays": spark.createDataFrame([("user1", "known|artist a")], "username string, track_id string"),
        "similar_artist": spark.createDataFrame(
            [("user1", "new track|artist b", "New Track", "Artist B", 0.85, 100.0, "a1"), ("user1", "known|artist a", "Known", "Artist A", 0.5, 900.0, "zz_top-x")],
            schemas.CANDIDATE_SIMILAR_ARTIST,
        ),
        "similar_tag": spark.createDataFrame(
            [("user1", "new track|artist b", "New Track", "Artist B", 3, 3.0, "rock,indie,alt"), ("user1", "tag track|artist c", "Tag Track", "Artist C", 4, 4.0, "rock,indie,alt,pop")],
            schemas.CANDIDATE_SIMILAR_TAG,
        ),
        "deep_cut": spark.createDataFrame([("user1", "tag track|artist c", "Tag Track", "Artist C", 50.0, "c1")], schemas.CANDIDATE_DEEP_CUT),
        "old_favorite": spark.createDataFrame([("user1", "known|artist a", 2.0, 2, 100)], schemas.CANDIDATE_OLD_FAVORITES),
        "tracks": spark.createDataFrame(
            [("new track|artist b", "New Track", "Artist B", "vid-1"), ("known|artist a", "Known!", "Artist A", "vid-2")],
            "track_id string, track_name string, artist_name string, youtube_url string",
        ).selectExpr("*", "1L AS duration_ms", "'t' AS tags", "CAST(NULL AS STRING) AS spotify_url"),
        "artists": spark.createDataFrame([("a1", "Artist A"), ("c1", "Artist C")], "artist_id string, artist_name string"),
    }


def test_merge(spark):
    out = merge_candidates(**merge_inputs(spark))
    assert out.columns == schemas.TRACK_CANDIDATES.names
    got = {r.track_id: r for r in out.collect()}
    assert set(got) == {"new track|artist b", "tag track|artist c", "known|artist a"}
    new, tag, known = got["new track|artist b"], got["tag track|artist c"], got["known|artist a"]
    assert (new.similar_artist, new.similar_tag, new.why_similar_artist_name, new.why_similar_artist_pct) == (True, True, "Artist A", 85.0)
    assert (new.why_similar_tags, new.why_tag_match_count, new.youtube_url, new.score) == ("rock,indie,alt", 3, "vid-1", 1.0 + 0.5)
    assert (tag.deep_cut_same_artist, tag.similar_tag, tag.why_deep_cut_artist, tag.why_tag_match_count) == (True, True, "Artist C", 4)
    assert (tag.score, tag.youtube_url) == (2.0, None)
    assert (known.old_favorite, known.similar_artist, known.track_name) == (True, False, "Known!")


def test_one_video_once(spark):
    inputs = merge_inputs(spark)
    inputs["tracks"] = inputs["tracks"].withColumn("youtube_url", inputs["tracks"].tags)
    assert rows(merge_candidates(**inputs), "track_id") == [("new track|artist b",), ("tag track|artist c",)]


def test_keyed_helpers(spark):
    a = spark.createDataFrame([("u", "t1", 1)], "username string, track_id string, x int")
    b = spark.createDataFrame([("v", 2)], "username string, x int")
    assert rows(K.union_common(a, b)) == [("u", 1), ("v", 2)]
    typed = K.union_typed([a, b], schemas.table("username string, track_id string, x bigint"))
    assert rows(typed) == [("u", "t1", 1), ("v", None, 2)]
    assert typed.schema["x"].dataType.simpleString() == "bigint"


def test_no_artist_of_a_large_user_is_left_out(spark):
    played = spark.createDataFrame(
        [("u", f"a{i}", f"A{i}", None, i + 1) for i in range(80)],
        "username string, artist_id string, artist_name string, tags string, play_count bigint",
    )
    assert C.similar_artist_sources(played).count() == 80
    assert C.deep_cut_sources(played, top_artists_count=70).count() == 70
    sampled = C.similar_artist_sources(played, sample_above=30, artist_sample_rate=0.2).count()
    assert 0 < sampled < 80


def test_limits_can_be_lifted(spark):
    albums = spark.createDataFrame(
        [("A", f"Album {i}", 100 - i, i + 1) for i in range(30)], "artist_name string, album_name string, playcount bigint, pos int"
    )
    listed = spark.createDataFrame([("A", f"Album {i}", f"t{i}x") for i in range(30)], "artist_name string, album_name string, track_name string")
    assert C.album_catalogue(albums, listed, 0).count() == 10
    assert C.album_catalogue(albums, listed, 0, None, None).count() == 30


def test_a_third_of_the_rows_on_one_artist(spark):
    users = spark.createDataFrame([(f"u{i}", "hot" if i % 3 == 0 else f"a{i}") for i in range(600)], "username string, artist_name string")
    catalogue = spark.createDataFrame([("hot", t) for t in range(50)] + [(f"a{i}", 0) for i in range(600)], "artist_name string, t int")
    joined = K.catalogue_join(users, catalogue, "artist_name")
    assert joined.count() == users.join(catalogue, "artist_name").count() == 200 * 50 + 400
    assert joined.columns == ["artist_name", "username", "t"]
