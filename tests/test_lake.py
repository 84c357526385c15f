from __future__ import annotations

import os
import re

import pytest
from conftest import rows
from pyspark.sql import functions as F

from listenlake import schemas
from listenlake.operators import ingest as I
from listenlake.operators.statistics import serving_key
from listenlake.plans.jobs import Jobs
from listenlake.sources import lake as L
from listenlake.sources.lake import Lake
from listenlake.sources.shared import shared_dir

KEYS, SCHEMA = ["username", "scrobbled_at"], "username string, scrobbled_at bigint, track_name string"


def first_write(spark, lake, part):
    data = [("user1", 1000, "A"), ("user1", 2000, "B"), ("user2", 3000, "C"), ("user2", 3000, "B older copy")]
    return lake.upsert(spark.createDataFrame(data, SCHEMA), "silver/plays", KEYS, part)


@pytest.mark.parametrize("part", [[], ["username"]])
def test_upsert(spark, lake, part):
    report = first_write(spark, lake, part)
    assert (report.rows, report.updated) == (3, 0)
    second = spark.createDataFrame([("user1", 1000, "A2"), ("user1", 4000, "D"), ("user3", 5000, "E")], SCHEMA)
    report = lake.upsert(second, "silver/plays", KEYS, part)
    assert (report.rows, report.inserted, report.updated) == (3, 2, 1)
    expected = [("user1", 1000, "A2"), ("user1", 2000, "B"), ("user1", 4000, "D"), ("user2", 3000, "C"), ("user3", 5000, "E")]
    assert rows(lake.read("silver/plays"), "username", "scrobbled_at", "track_name") == expected
    again = lake.upsert(second, "silver/plays", KEYS, part)
    assert (again.inserted, again.updated) == (0, 3)
    assert rows(lake.read("silver/plays"), "username", "scrobbled_at", "track_name") == expected


def files_of(df):
    return sorted(r[0] for r in df.select(F.input_file_name()).distinct().collect())


def pruned(df):
    """Whether Spark picks partitions before it lists and reads files."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return all(re.search(r"PartitionFilters: \[[^]]*_part", line) for line in plan.split("FileScan")[1:])


def test_untouched_partitions_are_not_read_or_written(spark, lake):
    first_write(spark, lake, ["username"])
    before = files_of(lake.read("silver/plays").filter("username = 'user1'"))
    scanned = []
    read = lake._rows
    lake._rows = lambda *a: (scanned.append(pruned(read(*a))), read(*a))[1]
    lake.upsert(spark.createDataFrame([("user2", 3000, "new")], SCHEMA), "silver/plays", KEYS, ["username"])
    lake.delete(spark.createDataFrame([("user2", 3000)], "username string, scrobbled_at bigint"), "silver/plays", KEYS)
    users = spark.createDataFrame([("user2",)], "username string")
    lake.replace_users(spark.createDataFrame([("user2", 5, "Z")], SCHEMA), "silver/plays", users, ["username"])
    del lake._rows
    assert len(scanned) >= 3 and all(scanned)
    assert files_of(lake.read("silver/plays").filter("username = 'user1'")) == before
    assert lake.user_rows("silver/plays", schemas.PLAYS, "user2").count() == 1


@pytest.mark.parametrize("buckets", [16, 200, 512])
def test_a_users_bucket_is_found_whatever_their_number(spark, lake, buckets):
    data = spark.range(300).selectExpr("concat('u', id) AS username", "id AS scrobbled_at", "'t' AS track_name")
    lake.write(L.with_user_bucket(data, buckets), "silver/plays", "error", ["user_bucket"])
    lake.upsert(L.with_user_bucket(data.limit(5), buckets), "silver/plays", KEYS, ["user_bucket"])
    assert lake.table("silver/plays").buckets == buckets
    for user in ("u0", "u7", "u299"):
        found = lake.user_rows("silver/plays", schemas.PLAYS, user)
        assert found.count() == 1 and pruned(found)


def test_names_of_any_look_stay_text(spark, lake):
    names = ["007", "7", "8", "alice", "2024-01-01", "a/b=c", "", "ü"]
    data = spark.createDataFrame([(n, i, "A") for i, n in enumerate(names)], SCHEMA)
    for _ in range(2):
        lake.upsert(data, "silver/plays", KEYS, ["username"])
    assert rows(lake.read("silver/plays")) == rows(data)
    assert lake.read("silver/plays").schema["username"].dataType.simpleString() == "string"


@pytest.mark.parametrize("part", [[], ["username"]])
def test_rows_without_a_key_are_kept_aside(spark, lake, part):
    data = spark.createDataFrame([("u", 1, "A"), ("u", None, "B"), (None, 2, "C"), ("u", None, "D")], SCHEMA)
    for time in range(1, 4):
        assert lake.upsert(data, "silver/plays", KEYS, part).rejected == 3
        assert rows(lake.read("silver/plays")) == [("u", 1, "A")]
        assert lake.read("silver/plays__rejects").count() == 3 * time


@pytest.mark.parametrize("part", [[], ["username"]])
def test_a_change_that_breaks_off_leaves_the_table_as_it_was(spark, lake, part):
    first_write(spark, lake, part)
    before = rows(lake.read("silver/plays"))
    change = spark.createDataFrame([("user1", 1000, "A2"), ("user9", 1, "N")], SCHEMA)
    put = lake._put

    def broken(*_):
        raise OSError("lost the connection")

    lake._put = broken
    with pytest.raises(OSError):
        lake.upsert(change, "silver/plays", KEYS, part)
    assert rows(lake.read("silver/plays")) == before
    lake._put = put
    for _ in range(2):
        lake.upsert(change, "silver/plays", KEYS, part)
        assert len(rows(lake.read("silver/plays"))) == len(before) + 1


def test_nothing_is_left_behind(spark, lake):
    part, staging = ["username"], f"{shared_dir(spark)}/staging"
    before = set(os.listdir(staging)) if os.path.isdir(staging) else set()
    first_write(spark, lake, part)
    for i in range(4):
        lake.upsert(spark.createDataFrame([("user2", 3000, f"v{i}")], SCHEMA), "silver/plays", KEYS, part)
    path = lake.path("silver/plays")
    assert sorted(n[0] for n in os.listdir(path) if n.startswith("_part")) == ["_", "_"]
    assert rows(lake.read("silver/plays"), "username", "track_name") == [("user1", "A"), ("user1", "B"), ("user2", "v3")]
    assert set(os.listdir(staging) if os.path.isdir(staging) else []) <= before


def test_batches_are_appended_once(spark, lake):
    df = spark.createDataFrame([("u", 1, "A")], SCHEMA)
    for _ in range(2):
        lake.write(df, "silver/x", "append", batch=("s", 0))
    lake.write(df, "silver/x", "append", batch=("s", 1))
    assert lake.read("silver/x").count() == 2
    lake.upsert(spark.createDataFrame([("u", 1, "B")], SCHEMA), "silver/x", KEYS)
    assert rows(lake.read("silver/x"), "track_name") == [("B",), ("B",)]
    lake.delete(spark.createDataFrame([("u", 1)], "username string, scrobbled_at bigint"), "silver/x", KEYS)
    assert lake.read("silver/x").count() == 0 and lake.read("silver/x").columns == df.columns


@pytest.mark.parametrize("part", [[], ["username"]])
def test_delete_also_last_row_of_a_partition(spark, lake, part):
    first_write(spark, lake, part)
    gone = spark.createDataFrame([("user2", 3000), ("nobody", 1)], "username string, scrobbled_at bigint")
    assert lake.delete(gone, "silver/plays", KEYS).deleted == 1
    assert rows(lake.read("silver/plays"), "username", "scrobbled_at") == [("user1", 1000), ("user1", 2000)]
    assert lake.delete(gone, "silver/plays", KEYS).deleted == 0
    assert lake.delete(gone, "silver/none", KEYS).skipped


@pytest.mark.parametrize("part", [[], ["username"]])
def test_replace_users(spark, lake, part):
    first_write(spark, lake, part)
    users = spark.createDataFrame([("user1",), ("user2",)], "username string")
    lake.replace_users(spark.createDataFrame([("user1", 9, "Z")], SCHEMA), "silver/plays", users, part)
    assert rows(lake.read("silver/plays"), "username", "scrobbled_at", "track_name") == [("user1", 9, "Z")]


def test_modes_and_missing_tables(spark, lake):
    df = spark.createDataFrame([("u", 1, "A")], SCHEMA)
    assert lake.read_or_empty("silver/x", schemas.PLAYS).columns == schemas.PLAYS.names
    assert lake.write(df, "silver/x", "error").rows == 1
    lake.write(df, "silver/x", "append")
    assert lake.read("silver/x").count() == 2
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        lake.write(df, "silver/x", "error")
    assert tuple(lake.user_stats("gold/user_stats", "u").first()) == ("u", 0, 0, 0)
    assert shared_dir(spark)


def test_pages_and_plays(spark, lake):
    play = '{"name":"Track %d (Live)","loved":"%d","url":"u","date":{"uts":"%d"},"artist":{"name":"Artist 1"}}'
    now = '{"name":"Now","artist":{"name":"Artist 1"}}'
    one, two = play % (1, 1, 1609459200), play % (2, 0, 1609545600)
    pages = [f'{{"recenttracks":{{"track":{one}}}}}', f'{{"recenttracks":{{"track":[{now},{two}]}}}}', '{"recenttracks":{"track":[]}}', "{}"]
    raw = I.flatten_pages(spark.createDataFrame([(p,) for p in pages], "value string"))
    lake.land_json(raw, "bronze/plays")
    plays = I.plays_from_raw(lake.read_json("bronze/plays", schemas.RAW_PLAY), "user1")
    assert plays.columns == schemas.PLAYS.names
    got = rows(plays.withColumn("t", plays.scrobbled_at_utc.cast("string")), "scrobbled_at", "t", "is_loved", "track_id")
    assert got == [(1609459200, "2021-01-01 00:00:00", True, "track 1|artist 1"), (1609545600, "2021-01-02 00:00:00", False, "track 2|artist 1")]


def test_raw_dimensions(spark, tmp_path):
    tags = ",".join(f'{{"name":"t{i}"}}' for i in range(7))
    (tmp_path / "tracks.json").write_text(
        f'[{{"name":"A","duration":"10","listeners":5,"playcount":"x","artist":{{"name":"B"}},"toptags":{{"tag":[{tags}]}}}},'
        '{"name":"C","artist":{"name":"B"},"toptags":{"tag":[]}}]'
    )
    raw = Lake(spark, str(tmp_path)).read_json("tracks.json", schemas.RAW_TRACK, array_file=True)
    got = rows(I.tracks_from_raw(raw), "track_name", "duration_ms", "listeners", "playcount", "tags", "youtube_url")
    assert got == [("A", 10, 5, None, "t0, t1, t2, t3, t4", None), ("C", None, None, None, "", None)]


def test_pages_that_cannot_be_read_are_counted(spark, lake):
    play = '{"name":"T","loved":"0","url":"u","date":{"uts":"%s"},"artist":{"name":"A"}}'
    pages = ['{"recenttracks":{"track":[' + play % 5 + "," + play % "soon" + "]}}", '{"recenttracks":{"track":[{"na', '"x', "{}", '{"recenttracks":{"track":7}}']
    report = Jobs(lake).ingest_pages(spark.createDataFrame([(p,) for p in pages], "value string"), "user1")
    assert (report.rows, report.rejected) == (1, 4)  # three pages, and one play without a time
    assert lake.read("bronze/pages__rejects").count() == 3 and lake.read("silver/plays__rejects").count() == 1


def test_jobs_land_backfill_refresh_and_enrich(spark, lake):
    jobs = Jobs(lake)
    raw = lambda day, n: spark.createDataFrame(
        [(f"T{i}", "u", {"uts": str(86400 * day + i)}, {"name": "A"}, "0") for i in range(n)],
        "name string, url string, date struct<uts:string>, artist struct<name:string>, loved string",
    )
    assert jobs.land_day(raw(3, 2), "u1", "1970-01-04").rows == 2
    assert jobs.land_day(raw(3, 0), "u1", "1970-01-05").skipped
    assert lake.read_json("bronze/plays/username=u1/date=1970-01-04", schemas.RAW_PLAY).count() == 2
    report, summary = jobs.backfill(raw(3, 2).unionByName(raw(9, 3)), "1970-01-03", "1970-01-06", "u1")
    assert report.rows == 2 and tuple(summary.first())[:4] == ("u1", 2, 1, 3)
    assert jobs.backfill(raw(9, 1), "1970-01-03", "1970-01-06", "u1")[0].skipped
    jobs.ingest_plays(raw(1, 1), "u2")
    jobs.refresh_users(spark.createDataFrame([("u1",)], "username string"), "1970-02-01")
    assert rows(lake.read("gold/track_play_count"), "username", "play_count") == [("u1", 1), ("u1", 1)]
    jobs.refresh_users(spark.createDataFrame([("u2",)], "username string"), "1970-02-01")
    assert lake.read("silver/dim_users").count() == 2 and lake.read("gold/track_play_count").count() == 3
    track = "name string, url string, artist struct<name:string>, toptags struct<tag:array<struct<name:string>>>, duration string, listeners string, playcount string, youtube_url string, spotify_url string"
    jobs.upsert_tracks(spark.createDataFrame([("T0", "page", {"name": "A"}, None, "1", "2", "3", "https://known/", None)], track))
    page = '<a class="play-this-track-playlink play-this-track-playlink--spotify" data-spotify-url="https://open.spotify.com/track/0000000000000000000007">p</a>'
    search = spark.createDataFrame([], "track_id string, platform string, search string, result_type string, result_id string, title string, channel string, pos int")
    found = spark.createDataFrame([], "track_id string, url string, pos int")
    jobs.enrich_links(search, found, spark.createDataFrame([("page", page)], "url string, html string"))
    assert rows(lake.read("silver/tracks"), "youtube_url", "spotify_url") == [("https://known/", "https://open.spotify.com/track/0000000000000000000007")]


def test_serving_key(spark):
    df = spark.createDataFrame([("id", "n"), (None, "n"), ("", "n"), (None, None), ("", "")], "artist_id string, artist_name string")
    assert rows(df.select(serving_key().alias("k"))) == [("id",), ("n",), ("n",), ("unknown",), ("unknown",)]


def test_jobs_on_an_empty_lake(spark, lake):
    jobs = Jobs(lake)
    assert jobs.compute_users().skipped and jobs.compute_track_counts("2025-01-01").skipped
    assert jobs.recommend().count() == 0
    assert jobs.missing_artists().count() == 0
