"""Global places of rows within their group, by ranges of the order: no group passes through one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from listenlake.llm.common import shuffle_width, staged


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `at`, the place of each within its group (from 0, nulls first), and `n`, the size of the group.

    Rows are dealt to ranges of (group, order), so a group of any size is many tasks; each counts its own rows, and the
    counts of the ranges before it, one row for each range and group, are added. Rows equal in group and order follow one
    another in any order. rows should be staged, as ranges need a sample of them. `_part` and `_k` must not be columns."""
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    ranged = rows.repartitionByRange(max(2, shuffle_width(spark)), *keys).sortWithinPartitions(*keys)
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_k", LongType())])
    place = rows.columns.index(group)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, count = object(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = pc.dictionary_encode(batch.column(place), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            first, end = batch.column(place)[0].as_py(), batch.column(place)[-1].as_py()
            starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
            sizes = np.diff(np.append(starts, len(codes)))
            k = np.arange(len(codes)) - np.repeat(starts, sizes)
            if first == last:
                k[: sizes[0]] += count
            last, count = end, int(k[-1]) + 1
            columns = [*batch.columns, pa.array(np.full(len(k), part, np.int32)), pa.array(k.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    placed = staged(ranged.mapInArrow(over, schema))
    counts = placed.groupBy("_part", group).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.partitionBy(group)
    counts = counts.select(
        F.col("_part").alias("_p"),
        F.col(group).alias("_g"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        F.sum("_rows").over(total).alias("n"),
    )
    same = (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g"))
    return placed.join(counts, same).select(*rows.columns, (F.col("_before") + F.col("_k")).alias("at"), "n")
