"""Session settings the plans count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings; all can be changed on a running session.
SQL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A user, track or tag may hold a third of the rows. Joins on such a key are split by AQE, also where the
    # split costs one more exchange in front of the next aggregate.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rows dealt by user (keyed.by_user) are joined by user and track where they lie.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply SQL_CONF to a session made by someone else (a cluster, a notebook, a test driver)."""
    for key, value in SQL_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "listenlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_CONF, **conf}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())
