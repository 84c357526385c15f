from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_streaming import land

from listenlake.operators import history as H
from listenlake.operators.dimensions import dim_users
from listenlake.operators.keyed import one_per_key
from listenlake.operators.statistics import artist_counts_by_age, artist_play_counts, track_counts_by_age, track_play_counts
from listenlake.streaming import plays as SP

BATCHES = [
    [("u", "2025-01-01 10:00:00", "a"), ("u", "2025-01-01 10:00:00", "a"), ("v", "2025-01-02 00:00:00", "b"), (None, "2025-01-01", "x")],
    [("u", "2025-01-02 00:00:01", "a"), ("v", "2025-01-02 00:00:00", "b"), ("u", "2024-12-01 10:00:00", "c")],
    [("u", "2025-03-05 10:00:00", "c"), ("u", "2025-01-01 10:00:00", "a"), ("u", "2025-01-03 23:59:59", "a")],
]


def told(counts):
    return rows(counts.withColumn("recency_score", F.round("recency_score", 9)))


@pytest.mark.parametrize("part", [[], ["user_bucket"]])
def test_statistics_of_any_midnight_from_days_alone(spark, lake, tmp_path, part):
    source = str(tmp_path / "landed")
    landed = [land(spark, source, i, data) for i, data in enumerate(BATCHES)]
    union = landed[0].unionByName(landed[1]).unionByName(landed[2])
    stream = SP.landed_files(spark, source, union.schema, files_per_batch=1)
    SP.keep_history(stream, lake, "silver/plays", "gold/days", lake.path("_h"), part).awaitTermination()
    plays = one_per_key(union.filter("username IS NOT NULL"), SP.PLAY_KEY)
    assert rows(lake.read("silver/plays"), *SP.PLAY_KEY) == rows(plays, *SP.PLAY_KEY)
    assert lake.read("silver/plays__rejects").count() == 1
    days = lake.read("gold/days")
    lake.files.delete(lake.path("silver/plays"))
    who = dim_users(plays)
    assert rows(H.users_of_days(days), *who.columns) == rows(who)
    artists = plays.select("track_id", "artist_name", F.col("artist_name").alias("artist_id")).distinct()
    for as_of in ("2025-03-06 00:00:00", "2026-01-01 00:00:00"):
        by_age = H.aged(days, as_of)
        assert told(track_counts_by_age(by_age, who, as_of)) == told(track_play_counts(plays, who, as_of))
        expected = artist_play_counts(plays, who, artists, artists, as_of)
        assert told(artist_counts_by_age(by_age, who, artists, artists, as_of)) == told(expected)
    with pytest.raises(ValueError, match="midnights"):
        H.aged(days, "2025-03-06 12:00:00")


def test_a_batch_that_breaks_off_anywhere_can_be_repeated(spark, lake, tmp_path):
    """The second batch stops before either table, between the two, or after both, and comes again."""
    first, second = (land(spark, str(tmp_path / "l"), i, BATCHES[i]).filter("username IS NOT NULL") for i in (0, 1))
    write = lake.write
    for stop in range(3):
        tables = f"silver/p{stop}", f"gold/d{stop}"
        SP.fold_batch(first, lake, *tables, ("s", 0), ["user_bucket"])
        done = []

        def stops(df, name, *rest):
            if len(done) == stop:
                raise OSError("lost the connection")
            done.append(name)
            return write(df, name, *rest)

        lake.write = stops
        try:
            SP.fold_batch(second, lake, *tables, ("s", 1), ["user_bucket"])
        except OSError:
            assert stop < 2
        lake.write = write
        SP.fold_batch(second, lake, *tables, ("s", 1), ["user_bucket"])
        assert lake.read(tables[0]).count() == 4
        assert lake.read(tables[1]).agg(F.sum("n")).first()[0] == 4
