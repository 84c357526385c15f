from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from listenlake.operators.dimensions import dim_users
from listenlake.operators.keyed import one_per_key
from listenlake.operators.statistics import artist_play_counts, track_play_counts
from listenlake.streaming import plays as SP


def land(spark, directory, batch, data):
    df = spark.createDataFrame(data, "username string, t string, track_id string")
    df = df.select(
        "username",
        F.unix_timestamp(F.col("t").cast("timestamp")).alias("scrobbled_at"),
        F.col("t").cast("timestamp").alias("scrobbled_at_utc"),
        F.col("track_id").alias("track_name"),
        F.lit("A").alias("artist_name"),
        "track_id",
    )
    df.coalesce(1).write.mode("append").parquet(f"{directory}/day={batch}")
    return df


DAYS = [
    [("u", "2025-01-01 10:00:00", "a"), ("u", "2025-01-01 10:00:00", "a"), ("v", "2025-01-01 11:00:00", "b")],
    [("u", "2025-01-02 10:00:00", "a"), ("v", "2025-01-01 11:00:00", "b")],
    [("u", "2025-01-05 10:00:00", "c")],
]


def test_stream_equals_batch(spark, lake, tmp_path):
    source = str(tmp_path / "landed")
    batches = [land(spark, source, i, data) for i, data in enumerate(DAYS)]
    union = batches[0].unionByName(batches[1]).unionByName(batches[2])
    stream = SP.landed_files(spark, source, union.schema, files_per_batch=1)
    run = SP.refresh_statistics(stream, lake, "silver/plays", "gold/counts", "2025-02-01 00:00:00", lake.path("_c"), ["username"])
    run.awaitTermination()
    plays = one_per_key(union, SP.PLAY_KEY)
    assert rows(lake.read("silver/plays"), *union.columns) == rows(plays, *union.columns)
    expected = track_play_counts(plays, dim_users(plays), "2025-02-01 00:00:00")
    assert rows(lake.read("gold/counts"), *expected.columns) == rows(expected)


def test_repeats_and_days(spark, lake, tmp_path):
    source = str(tmp_path / "landed")
    schema = [land(spark, source, i, data) for i, data in enumerate(DAYS)][0].schema
    stream = SP.landed_files(spark, source, schema)
    SP.append_rows(SP.without_repeats(stream), lake, "fresh", lake.path("_f")).awaitTermination()
    assert lake.read("fresh").count() == 4
    run = SP.store_daily_counts(stream, lake, "days", lake.path("_d"))
    run.awaitTermination()
    got = rows(lake.read("days").withColumn("day", F.date_format("day", "yyyy-MM-dd")), "username", "day", "plays")
    # The last day is still open and in the table.
    assert got == [("u", "2025-01-01", 2), ("u", "2025-01-02", 1), ("u", "2025-01-05", 1), ("v", "2025-01-01", 2)]
    assert SP.late_rows(run) == 0


def test_late_rows_are_told(spark, lake, tmp_path):
    source = str(tmp_path / "landed")
    schema = [land(spark, source, i, data) for i, data in enumerate([DAYS[2], DAYS[2], DAYS[0]])][0].schema
    stream = SP.landed_files(spark, source, schema, files_per_batch=1)
    run = SP.store_daily_counts(stream, lake, "days", lake.path("_d"))
    run.awaitTermination()
    kept = sum(r.plays for r in lake.read("days").collect())
    assert kept + SP.late_rows(run) >= 4 and kept in (2, 5)


def test_refresh_of_all_statistics(spark, lake, tmp_path):
    source = str(tmp_path / "landed")
    union = [land(spark, source, i, data) for i, data in enumerate(DAYS)]
    union = union[0].unionByName(union[1]).unionByName(union[2])
    tracks = spark.createDataFrame([("a", "x"), ("b", "x")], "track_id string, artist_id string")
    artists = spark.createDataFrame([("x", "X")], "artist_id string, artist_name string")
    run = SP.refresh_statistics(
        SP.landed_files(spark, source, union.schema, files_per_batch=1), lake, "plays", "counts", "2025-02-01 00:00:00",
        lake.path("_c"), ["user_bucket"], "users", "artist_counts", tracks, artists,
    )
    run.awaitTermination()
    plays = one_per_key(union, SP.PLAY_KEY)
    who = dim_users(plays)
    assert rows(lake.read("users"), *who.columns) == rows(who)
    expected = artist_play_counts(plays, who, tracks, artists, "2025-02-01 00:00:00")
    assert rows(lake.read("artist_counts"), *expected.columns) == rows(expected)


def test_first_copies_are_kept_however_late(spark, lake, tmp_path):
    source = str(tmp_path / "landed")
    batches = [land(spark, source, i, data) for i, data in enumerate([DAYS[2], DAYS[2], DAYS[0], DAYS[1]])]
    stream = SP.landed_files(spark, source, batches[0].schema, files_per_batch=1)
    SP.store_first_copies(stream, lake, "fresh", lake.path("_f"), ["user_bucket"]).awaitTermination()
    got = rows(lake.read("fresh"), "username", "scrobbled_at", "track_id")
    union = batches[0].unionByName(batches[2]).unionByName(batches[3])
    assert got == rows(one_per_key(union, SP.PLAY_KEY), "username", "scrobbled_at", "track_id") and len(got) == 4
