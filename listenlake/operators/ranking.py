"""Ranks, caps and samples per user.

A user may hold a third of all rows, so operators here don't send all rows of a user to one task: caps use the
``rank <= n`` form that Spark cuts before the exchange, and the full percentile rank works on score bands. Only
``top_rank_by_user`` counts on rows that lie by user already.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.operators.keyed import SALTS, best_per_key, join_spread

BANDS = 64


def cap(df: DataFrame, by: Sequence[str], n: int, score: str = "score", key: str = "track_id") -> DataFrame:
    """Best ``n`` rows per group: score descending, key ascending."""
    return best_per_key(df, list(by), [F.col(score).desc_nulls_last(), F.col(key).asc_nulls_first()], n)


def _average_rank(below: Column, ties: Column) -> Column:
    """Mean place of ``ties`` equal scores above ``below`` smaller ones."""
    return below + (ties + 1) / 2


def top_rank_normalised(df: DataFrame, n: int, by: Sequence[str] = ("username",)) -> DataFrame:
    """Best ``n`` rows per group with ``normalized_score`` = average ascending rank / greatest rank, over all rows.

    Only the ``n`` best distinct scores of a group can occur in the result. What lies below them enters as a count,
    so the window holds at most ``n`` rows per group whatever the group's share of the data.
    """
    by = list(by)
    by_score = df.filter(F.col("score").isNotNull()).groupBy(*by, "score").agg(F.count("*").alias("ties"))
    totals = by_score.groupBy(*by).agg(
        F.sum("ties").alias("total"), F.max_by("ties", "score").alias("top_ties")
    )
    top = best_per_key(by_score, by, [F.col("score").desc_nulls_last()], n)
    higher = Window.partitionBy(*by).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    above = F.coalesce(F.sum("ties").over(higher), F.lit(0))
    top = top.withColumn("above", above).join(totals, by)
    below = F.col("total") - F.col("above") - F.col("ties")
    best = _average_rank(F.col("total") - F.col("top_ties"), F.col("top_ties"))
    scale = top.select(*by, "score", (_average_rank(below, F.col("ties")) / best).alias("normalized_score"))
    # A NULL score has no rank; it ranks behind all others in the cut and keeps its row.
    return cap(df, by, n).join(scale, [*by, "score"], "left")


def top_rank_by_user(df: DataFrame, n: int, by: Sequence[str] = ("username",)) -> DataFrame:
    """``top_rank_normalised`` where rows lie by user and a user has a bounded number (what a catalogue holds for one): places,
    ties and totals are windows over one order, so the rows are sorted once and neither exchanged nor joined again."""
    by = list(by)
    group = Window.partitionBy(*by)
    falling = group.orderBy(F.col("score").desc_nulls_last())
    ordered = group.orderBy(F.col("score").desc_nulls_last(), F.col("track_id").asc_nulls_first())
    placed = df.withColumn("_place", F.row_number().over(ordered))
    placed = placed.withColumns({"_above": F.rank().over(falling) - 1, "_upto": F.count("score").over(falling)})
    first = F.max(F.when(F.col("_above") == 0, F.col("_upto")))
    placed = placed.withColumns({"_total": F.count("score").over(group), "_first": first.over(group)}).filter(F.col("_place") <= n)
    rank = _average_rank(F.col("_total") - F.col("_upto"), F.col("_upto") - F.col("_above"))
    best = _average_rank(F.col("_total") - F.col("_first"), F.col("_first"))
    ranked = reduce(and_, [F.col(c).isNotNull() for c in [*by, "score"]])
    return placed.withColumn("normalized_score", F.when(ranked, rank / best)).drop("_place", "_above", "_upto", "_total", "_first")


def rank_normalised(df: DataFrame, bands: int = BANDS, key: str = "track_id") -> DataFrame:
    """All rows with ``normalized_score``; NULL where the score is NULL.

    Distinct scores of a user are cut into bands at their quantiles, so that bands hold about as many scores each, however
    the scores lie. A window over at most ``bands`` sums per user gives the number of rows in lower bands, a window inside
    each band gives the rest. The way back to the rows is salted by ``key``: many of a user's rows may share a score.
    """
    by_score = df.filter(F.col("score").isNotNull()).groupBy("username", "score").agg(F.count("*").alias("ties"))
    shares = [i / bands for i in range(1, bands)]
    users = by_score.groupBy("username").agg(
        (F.percentile_approx("score", shares, 10 * bands) if shares else F.lit(None)).alias("cuts"),
        F.sum("ties").alias("total"),
        F.max_by("ties", "score").alias("top_ties"),
    )
    banded = join_spread(by_score, users, "username", F.col("score"))
    band = F.size(F.filter("cuts", lambda c: c < F.col("score"))) if shares else F.lit(0)
    banded = banded.withColumn("band", band)
    banded = banded.select("username", "score", "ties", "total", "top_ties", "band")

    lower_bands = Window.partitionBy("username").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    per_band = banded.groupBy("username", "band").agg(F.sum("ties").alias("n"))
    offsets = per_band.select(
        "username", "band", F.coalesce(F.sum("n").over(lower_bands), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("username", "band").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    lower_scores = F.coalesce(F.sum("ties").over(inside), F.lit(0))
    below = F.col("offset") + F.col("lower")
    best = _average_rank(F.col("total") - F.col("top_ties"), F.col("top_ties"))
    scale = (
        banded.withColumn("lower", lower_scores)
        .join(offsets.repartition("username", "band"), ["username", "band"])
        .select("username", "score", (_average_rank(below, F.col("ties")) / best).alias("normalized_score"))
    )
    salt = F.pmod(F.xxhash64(F.col(key)), F.lit(SALTS)).cast("int")
    copies = scale.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = copies.repartition("username", "_salt").hint("merge")
    return df.withColumn("_salt", salt).join(copies, ["username", "score", "_salt"], "left").drop("_salt")


def share_of_best(df: DataFrame, score: str = "weighted_score", name: str = "score_pct") -> DataFrame:
    """Score as percentage of the user's best, one decimal, half to even. For capped lists (a page of results)."""
    best = F.max(score).over(Window.partitionBy("username"))
    return df.withColumn(name, F.bround(F.col(score) / best * 100, 1))


def sample_large(df: DataFrame, entity: str, above: int, rate: float, seed: int = 0) -> DataFrame:
    """Keep a share of a user's rows where the user has more than ``above``; a rerun keeps the same rows.

    The draw is a digest of user, entity and seed. Another seed gives another sample.
    """
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", "username", F.col(entity), F.lit(str(seed)))), 1, 7), 16, 10)
    kept = draw.cast("bigint") % 10000 < int(rate * 10000)
    sizes = df.groupBy("username").agg(F.count("*").alias("_size"))
    # Nothing is grouped by user after this join, so Spark may split a hot user's rows.
    return df.join(sizes, "username").filter((F.col("_size") <= above) | kept).select(df.columns)
