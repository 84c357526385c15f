"""Connected components of links, by alternating large-star and small-star steps.

Links and labels stay in Spark; each round is written to the shared folder, so a lost executor costs no more than the
round. A round keeps the number of links or lessens it; the number of rounds grows with the logarithm of the largest
component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenlake.llm.common import checkpointed, gathered


def _star(links: DataFrame, larger_only: bool) -> DataFrame:
    """Links of each node's neighbours to the least of them. Large star: neighbours above the node; small star: those
    below it, and the node itself."""
    way = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    # Several rows of one, and not a union, which would break up a table of one partition.
    both = links.select(F.inline(F.array(way("a", "b"), way("b", "a")) if larger_only else F.array(way("a", "b"))))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    link = lambda a: F.struct(F.col(a).alias("a"), F.col("m").alias("b"))
    if larger_only:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.inline(F.array(link("v"), link("u"))))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link, component being the least node; links: (a, b), of long ids, in any
    direction, repeats and loops allowed."""
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = checkpointed(links.select(a.alias("a"), b.alias("b")).filter(F.col("a") != F.col("b")).distinct())
    rows, digest = now.count(), None
    for _ in range(most_rounds):
        far = gathered(_star(gathered(now, rows), True), rows)
        now = checkpointed(gathered(_star(far, False), rows))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        rows = seen[0]
        if tuple(seen) == digest:
            node = lambda c: F.struct(F.col(c).alias("node"), F.col("b").alias("component"))
            return gathered(now.select(F.inline(F.array(node("a"), node("b")))).distinct(), 2 * rows)
        digest = tuple(seen)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
