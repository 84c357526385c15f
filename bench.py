"""Headline timings: one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]

Every query is executed in full (all columns, all rows), once. Queries that build a table of the test lake write it, the
others go to a no-op sink and read what was written before them. The total holds both.
"""

from __future__ import annotations

import json
import os
import sys
import time

from listenlake.queries import QUERIES
from listenlake.session import build_session
from listenlake.sources.testbed import Testbed

DIRECTORY = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# Query -> table of the test lake it builds, in the order of the jobs.
BUILDS = {
    "plays": "plays",
    "listing": "listing",
    "dedup_tracks": "tracks",
    "dedup_artists": "artists",
    "dim_users": "users",
    "track_play_count": "track_counts",
    "artist_play_count": "artist_counts",
    "similar_artist_candidates": "candidate_similar_artist",
    "similar_tag_candidates": "candidate_similar_tag",
    "deep_cut_candidates": "candidate_deep_cut",
    "old_favorites": "candidate_old_favorites",
    "merge_candidates": "candidates",
    "recommend": "recommended",
}
READS = [
    "raw_plays_flatten",
    "normalize_names",
    "user_stats",
    "rank_normalise",
    "best_link",
    "upsert_plays",
    "replacements",
    "export_list",
    "upsert_table",
    "stream_ingest",
    "daily_play_windows",
]


def main(only: list[str]) -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(CPUS)),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "20g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    bed = Testbed(spark, DIRECTORY)
    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        started = time.time()
        action()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)

    for name, table in BUILDS.items():
        if not only or name in only or name in ("plays", "listing"):
            timed(name, getattr(bed, table))
    for name in READS:
        if not only or name in only:
            timed(name, lambda: QUERIES[name](spark, DIRECTORY).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(DIRECTORY.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
