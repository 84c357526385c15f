"""Document fingerprints: bottom-k sketches of shingle hashes.

A sketch is the sorted array of the k least distinct 64-bit hashes of a text's shingles. Two sketches estimate the
resemblance of the texts, the containment of one in the other and the number of distinct shingles, and the sketch of a
whole is had from those of its parts. All of it is Column expressions: no Python runs on the rows.

A text of fewer words than a shingle has its whole word sequence as one shingle; a text without words, null among them,
has the empty sketch. Two empty sketches have likeness 1, an empty and another one 0. Equal texts have equal sketches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlake.llm.common import SPACE, let, long_array, shuffle_width, texts

K = 128
WORDS = 5
LEAST = -(2**63)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def sketch(text: Column, k: int = K, width: int = WORDS) -> Column:
    """Bottom-k sketch of a text column."""

    def shingles(h: Column) -> Column:
        # Places behind the last word are null, and hashing skips null: a short text is one shingle of all its words.
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - width, F.lit(0)))
        many = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)]))
        return F.when(F.size(h) > 0, many).otherwise(F.array().cast("array<bigint>"))

    hashed = F.transform(words(F.coalesce(text, F.lit(""))), lambda w: F.xxhash64(w))
    return F.slice(F.sort_array(F.array_distinct(let(hashed, shingles))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(df: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """Sketch of each group, however many parts it has: hashes are made distinct, then the k least are kept. Groups all of
    whose sketches are empty or null have the empty sketch."""
    hashes = df.select(*keys, F.explode_outer(column).alias("_hash")).distinct()
    order = Window.partitionBy(*keys).orderBy(F.col("_hash").asc_nulls_last())
    least = hashes.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("_hash")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1: the part of the k least hashes of both that both have."""
    both = F.array_intersect(a, b)
    estimate = let(merged(a, b, k), lambda u: F.size(F.array_intersect(u, both)) / F.size(u))
    return F.when(F.size(F.array_union(a, b)) == 0, F.lit(1.0)).otherwise(estimate.cast("double"))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles, exact below k."""
    kth = (F.element_at(a, -1).cast("double") - float(LEAST)) / float(2**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated part of a's shingles that b has, 0 to 1; 1 for an empty a."""
    j, n, m = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (n + m) / n))


def sketch_hex(a: Column) -> Column:
    """Sketch as text: 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def sketch_of_hex(s: Column) -> Column:
    """The sketch that sketch_hex() wrote."""
    digits = lambda i, n: F.conv(F.substr(s, i * 16 + n, F.lit(8)), 16, 10).cast("bigint")
    one = lambda i: F.shiftleft(digits(i, 1), 32).bitwiseOR(digits(i, 9))
    count = (F.length(s) / 16).cast("int")
    return F.when(count == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), one))


def with_next(docs: DataFrame, derive=None, buckets: int | None = None) -> DataFrame:
    """(doc_id, text, what derive adds) and the same of the document next in order of doc_id as the struct `next`; after
    the last comes the first. Null ids come first, equal ids in the order of their texts' hashes.

    Ids are cut into buckets at their quantiles; a copy of each bucket's first rows ends the bucket before it, so that one
    exchange of the texts serves and no task sees more than a bucket. At most 1024 cuts and first ids pass the driver."""
    spark = docs.sparkSession
    buckets = buckets or max(1, min(1024, 4 * shuffle_width(spark)))
    derive = derive or (lambda df: df)
    rows = texts(docs).withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = rows.agg(F.percentile_approx("_key", shares, 10000)).first()[0] if shares else []
    cuts = sorted(set(cuts or []))
    rows = rows.withColumn("_bucket", F.size(F.filter(long_array(cuts), lambda c: c <= F.col("_key"))))
    firsts = sorted(tuple(r) for r in rows.groupBy("_bucket").agg(F.min("_key")).collect())
    before = [(key, firsts[i - 1][0], 1) for i, (_, key) in enumerate(firsts)]
    ends = spark.createDataFrame(before, "_first long, _before int, _end int")
    last = rows.join(F.broadcast(ends), F.col("_key") == F.col("_first")).select(
        "doc_id", "text", "_key", F.col("_before").alias("_bucket"), "_end"
    )
    dealt = rows.withColumn("_end", F.lit(0)).unionByName(last).repartition(shuffle_width(spark), "_bucket")
    made = derive(dealt)
    kept = [c for c in made.columns if not c.startswith("_")]
    order = Window.partitionBy("_bucket").orderBy("_end", "_key", F.xxhash64("text"))
    return made.withColumn("next", F.lead(F.struct(*kept)).over(order)).filter("_end = 0").select(*kept, "next")
