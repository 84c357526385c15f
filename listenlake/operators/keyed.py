"""Operators on keys: deterministic best row, upsert and delete as pure frames, joins that spread a hot key, and steps
that stay in the partition of a user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SALTS = 16
#: So many users at most are dealt to a task where what is made of them is many times what they bring.
USERS_PER_TASK = 250
#: A catalogue of up to so many rows is told to every task.
TOLD_ROWS = 500_000


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], top: int = 1) -> DataFrame:
    """First ``top`` rows per key in a total order.

    The ``rank <= n`` form lets Spark cut every map partition to ``top`` rows per key before the exchange, so a key
    with a third of all rows sends a handful of rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top).drop("_rn")


def one_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key; among copies the greatest row in column order wins, so a second run gives the same row."""
    rest = sorted(c for c in df.columns if c not in keys)
    return best_per_key(df, keys, [F.col(c).desc_nulls_last() for c in rest])


def join_spread(
    rows: DataFrame,
    per_key: DataFrame,
    key: str,
    spread_by: Column,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join many ``rows`` with at most one ``per_key`` row on ``key``, a hot key cut into ``salts`` pieces.

    ``_salt`` stays in the result: grouping by ``(key, _salt, ...)`` afterwards needs no second exchange as long as
    ``spread_by`` is made of group columns. The copies are ``salts`` times what Spark expects from the size of
    ``per_key``, and a broadcast once planned stays; so both sides are sorted and merged. They are dealt by the salt, as
    ``per_key`` may lie by the key alone, which Spark would take for the join.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies.repartition(key, "_salt").hint("merge"), [key, "_salt"], how)


def catalogue_join(rows: DataFrame, catalogue: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """Rows of users with all catalogue rows of their key, a popular key cut into ``salts`` pieces.

    The join multiplies rows, and a key may be a third of either side. Users' rows are dealt to the salts by user, and the
    catalogue is copied to each salt; both are small next to what the join makes. Nothing groups by this partitioning, so
    Spark may still broadcast a side whose size it has seen, or split a partition further.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("username"), F.lit(salts)).cast("int"))
    copies = catalogue.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"]).drop("_salt")


def user_tasks(rows: DataFrame) -> int:
    """In how many partitions the users of ``rows`` lie where lists are made of them. Spark deals rows by their size, which
    tells little of what a catalogue makes of them; users are about as many as they are, so they are counted."""
    users = rows.agg(F.approx_count_distinct("username")).first()[0]
    return max(1, -(-users // USERS_PER_TASK))


def by_user(rows: DataFrame, tasks: int) -> DataFrame:
    """Rows in the partition of their user. Joins and groups by the user and more then need no exchange, also after a
    union, as long as all sides lie in as many ``tasks``."""
    return rows.repartition(tasks, "username")


def told(catalogue: DataFrame, most: int = TOLD_ROWS) -> DataFrame:
    """A catalogue that goes to every task if it has few rows; otherwise Spark chooses. It should be stored: it is counted."""
    return F.broadcast(catalogue) if catalogue.count() <= most else catalogue


def expanded(rows: DataFrame, catalogue: DataFrame, key: str, tasks: int, most: int = TOLD_ROWS) -> DataFrame:
    """Rows of users, each in the partition of its user, with all catalogue rows of their key. A short catalogue comes to the
    rows and nothing the join makes is exchanged; a long one is joined by its key, and what it makes goes to the users."""
    if catalogue.count() <= most:
        return rows.join(F.broadcast(catalogue), key)
    return by_user(catalogue_join(rows, catalogue, key), tasks)


def without_by_user(rows: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``delete_frame`` where both sides lie by user: what is gone is looked up in the partition of the user, and the rows
    are neither exchanged nor sorted. (An anti join would be pushed below what made the rows, and their dealing with it.)"""
    marks = gone.select(*keys).distinct().withColumn("_gone", F.lit(True))
    return rows.join(marks.hint("shuffle_hash"), list(keys), "left").filter(F.col("_gone").isNull()).drop("_gone")


def upsert_frame(target: DataFrame, source: DataFrame, keys: Sequence[str], action: str | None = None) -> DataFrame:
    """Keyed upsert as a relation: source rows replace target rows with the same key, others are added.

    Source copies of one key are reduced to one row first. ``action`` names an extra column with ``updated``,
    ``inserted`` or ``copied``.
    """
    keys = list(keys)
    rest = [c for c in target.columns if c not in keys]
    old = target.select(*keys, F.struct(*rest).alias("_old"))
    new = one_per_key(source.select(target.columns), keys).select(*keys, F.struct(*rest).alias("_new"))
    label = (
        F.when(F.col("_new").isNull(), "copied").when(F.col("_old").isNull(), "inserted").otherwise("updated")
    )
    both = old.join(new, keys, "full_outer").withColumn("_row", F.coalesce("_new", "_old"))
    columns = [F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in target.columns]
    return both.select(*columns, *([label.alias(action)] if action else []))


def delete_frame(target: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target without the rows whose key is in ``gone``."""
    return target.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def matched(target: DataFrame, gone: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key is in ``gone``: what ``delete_frame`` drops."""
    return target.join(gone.select(*keys).distinct(), list(keys), "left_semi")


def only_new(members: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Members whose key is not known yet."""
    return members.join(known.select(key).distinct(), key, "left_anti")


def active_users(plays: DataFrame) -> DataFrame:
    return plays.select("username").distinct()


def union_typed(frames: Sequence[DataFrame], schema) -> DataFrame:
    """Union by name; columns a frame lacks become typed NULLs and every column takes the schema's type."""
    out = None
    for df in frames:
        have = set(df.columns)
        typed = df.select(
            *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
        )
        out = typed if out is None else out.unionByName(typed)
    return out


def union_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union over the columns both sides have, in the order of the left side."""
    common = [c for c in left.columns if c in right.columns]
    return left.select(common).unionByName(right.select(common))
