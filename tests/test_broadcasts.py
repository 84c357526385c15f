"""Sides that are much larger than Spark expects from their files are merged, not broadcast from the driver."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from listenlake.operators.keyed import join_spread
from listenlake.operators.ranking import rank_normalised
from listenlake.plans.candidates import album_catalogue
from listenlake.sources.testbed import Testbed


def broadcasts(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


@pytest.fixture
def read(spark, tmp_path):
    """Rows as a Parquet table, whose size Spark knows."""

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return spark.read.parquet(str(tmp_path / f"{name}.parquet"))

    return put


def test_salted_copies_of_users_are_merged(read):
    rows = read("rows", [("a", "x", 1), ("a", "y", 2), ("b", "x", 3), ("d", "x", 4)], "username string, track_id string, n int")
    users = read("users", [("a", 30), ("b", 60), ("c", 90), (None, 1)], "username string, days int")
    inner = join_spread(rows, users, "username", F.col("track_id"))
    outer = join_spread(rows, users, "username", F.col("track_id"), "left")
    assert broadcasts(inner) == broadcasts(outer) == 0
    assert sorted(tuple(r) for r in inner.select("username", "n", "days").collect()) == [("a", 1, 30), ("a", 2, 30), ("b", 3, 60)]
    assert [tuple(r) for r in outer.filter("days IS NULL").select("username", "n").collect()] == [("d", 4)]


def test_salted_copies_of_scores_are_merged(read):
    rows = read("scored", [("a", "x", 1.0), ("a", "y", 3.0), ("a", "z", None)], "username string, track_id string, score double")
    ranked = rank_normalised(rows)
    last = ranked._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert "strategy=merge" in next(line for line in last if "Join LeftOuter" in line)
    found = {r["track_id"]: r["normalized_score"] for r in ranked.collect()}
    assert found["y"] == 1.0 and found["z"] is None


def test_parts_are_merged(spark, read, tmp_path):
    parts = [(1, "blue sky", "Brand#1", 10), (2, "red sea", "Brand#2", 20)]
    read("part", parts, "p_partkey bigint, p_name string, p_brand string, p_size int")
    orders = [(1, 7, "1999-01-01", "1-URGENT"), (2, 8, "1999-01-02", "5-LOW")]
    read("orders", orders, "o_orderkey bigint, o_custkey bigint, o_orderdate string, o_orderpriority string")
    lines = [(1, 2, "R"), (1, 2, "R"), (2, 1, "N"), (2, 1, "R")]
    read("lineitem", lines, "l_orderkey bigint, l_partkey bigint, l_returnflag string")
    tables = Testbed(spark, str(tmp_path))
    for made in (tables.excluded_artists(), album_catalogue(tables.artist_top_albums(), tables.album_tracks(), min_listeners=0)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "strategy=merge" in plan
    rows = tables.excluded_artists().select("username", "artist_name").collect()
    assert [tuple(r) for r in rows] == [("7", "Brand#2")]
