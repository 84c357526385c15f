"""Tables on a shared file system: landing, write modes, keyed upsert, delete, replacement per user.

A table is a Parquet directory as Spark writes it, partitioned by one text column, ``_part``: a digest of the values of the
table's partition columns, which themselves stay in the files with their types (``"007"`` stays text, NULL stays NULL). A
change works out the rows of the partitions it touches, stores them in the shared folder, and puts them in the place of the
old ones by a dynamic partition overwrite. Partitions it does not touch are neither read nor written: their digests are a
literal filter on ``_part``, which Spark applies before it lists files. Beside the data lies ``_table``, an empty Parquet
table: its schema is that of the table, and the metadata of its fields tell the partition columns and the number of user
buckets.

A change that breaks off before the overwrite leaves the table as it was; one that breaks off within it may have replaced
some partitions, and the same call repeated completes it, as upsert, delete and replacement give the same rows again. A
batch of a stream has partitions of its own, which a repeated batch overwrites. There is one writer a table at a time; a
relation that was read before a change is read anew after it.

Rows whose key has a NULL can't be matched; upserts put them into the table ``<name>__rejects`` and count them.
"""

from __future__ import annotations

import contextlib
import hashlib
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from listenlake import schemas
from listenlake.operators.keyed import delete_frame, matched, one_per_key, upsert_frame
from listenlake.sources.shared import shared_dir

USER_BUCKETS = 256
PART = "_part"
KEY_LENGTH = 33  # of a digest with its letter in front; a batch's mark follows


def with_user_bucket(df: DataFrame, buckets: int = USER_BUCKETS) -> DataFrame:
    """Partition column for lakes with too many users for one directory each. The number of buckets goes with the column,
    and so into the table."""
    bucket = F.pmod(F.xxhash64("username"), F.lit(buckets)).cast("int")
    return df.withColumn("user_bucket", bucket).withMetadata("user_bucket", {"buckets": buckets})


class Files:
    """The few file operations Spark's readers and writers lack, on whatever file system Spark has for the path."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        where = self.jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def exists(self, path: str) -> bool:
        fs, where = self._at(path)
        return fs.exists(where)

    def names(self, path: str) -> list[str]:
        fs, where = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def state(self, path: str) -> list[tuple[str, int, int]]:
        """Name, length and time of change of what is in a directory."""
        fs, where = self._at(path)
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(where))

    def delete(self, path: str) -> None:
        fs, where = self._at(path)
        fs.delete(where, True)


@dataclass
class WriteReport:
    """What a write did; ``skipped`` with a reason where there was nothing to do."""

    path: str
    rows: int = 0
    inserted: int = 0
    updated: int = 0
    copied: int = 0
    deleted: int = 0
    rejected: int = 0
    skipped: bool = False
    reason: str | None = None
    columns: list[str] = field(default_factory=list)


@dataclass
class Table:
    """What is told of a table: its schema, the columns it is partitioned by, the number of user buckets if it has any."""

    schema: StructType
    partition_by: list[str]

    @property
    def buckets(self) -> int | None:
        if "user_bucket" not in self.schema.names:
            return None
        return self.schema["user_bucket"].metadata.get("buckets")

    @staticmethod
    def of(schema: StructType) -> Table:
        places = {f.name: f.metadata["partition"] for f in schema.fields if "partition" in f.metadata}
        return Table(schema, sorted(places, key=places.get))


def _key(values: Sequence[str | None]) -> str:
    """Name of a partition. Its first letter keeps Spark from taking it for a number or a date."""
    return "p" + hashlib.md5("\x1f".join("\x00" if v is None else v for v in values).encode()).hexdigest()


def _mark(batch: tuple[str, int]) -> str:
    """What a batch of a stream adds to the names of partitions."""
    return "." + hashlib.md5(f"{batch[0]} {batch[1]}".encode()).hexdigest()


def _key_column(partition_by: Sequence[str]) -> Column:
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in partition_by]
    return F.concat(F.lit("p"), F.md5(F.concat_ws("\x1f", *texts)))


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def path(self, name: str) -> str:
        """``name`` is layer and table, such as ``silver/plays``."""
        return f"{self.root}/{name}"

    # ---- landing

    def land_json(self, records: DataFrame, name: str, partition_by: Sequence[str] = ()) -> WriteReport:
        """JSON Lines, so that large landings can be split between tasks."""
        rows, columns = self._counted(records)
        rows.write.mode("overwrite").partitionBy(*partition_by).json(self.path(name))
        return WriteReport(self.path(name), rows=columns.get["rows"], columns=records.columns)

    def read_json(self, name: str, schema: StructType, array_file: bool = False) -> DataFrame:
        """``array_file`` reads files that hold one JSON array; such a file is one task's work."""
        return self.spark.read.schema(schema).option("multiLine", array_file).json(self.path(name))

    # ---- tables

    def table(self, name: str) -> Table | None:
        where = f"{self.path(name)}/_table"
        return Table.of(self.spark.read.parquet(where).schema) if self.files.exists(where) else None

    def read(self, name: str) -> DataFrame:
        found = self.table(name)
        if found is None:
            raise FileNotFoundError(f"no table {self.path(name)}")
        return self._rows(name, found)

    def read_or_empty(self, name: str, schema: StructType) -> DataFrame:
        """Typed empty relation where the table does not exist yet."""
        found = self.table(name)
        return self.spark.createDataFrame([], schema) if found is None else self._rows(name, found)

    def read_partitions(self, name: str, like: DataFrame) -> DataFrame:
        """Rows of the partitions that rows of ``like`` lie in; all rows if ``like`` lacks a partition column."""
        found = self.table(name)
        known = set(found.partition_by) <= set(like.columns)
        return self._rows(name, found, self._keys(like, found.partition_by) if known else None)

    def exists(self, name: str) -> bool:
        return self.table(name) is not None

    def _rows(
        self, name: str, table: Table, only: set[str] | None = None, apart_from: tuple[str, int] | None = None
    ) -> DataFrame:
        """Rows of a table, or of some of its partitions: no other is listed or read. Those of a batch can be left out."""
        schema = StructType([*table.schema.fields, StructField(PART, StringType())])
        rows = self.spark.read.schema(schema).parquet(self.path(name))
        if only is not None:
            rows = rows.filter(F.substring(PART, 1, KEY_LENGTH).isin(sorted(only)))
        if apart_from is not None:
            rows = rows.filter(~F.endswith(F.col(PART), F.lit(_mark(apart_from))))
        return rows.drop(PART)

    def write(
        self,
        df: DataFrame,
        name: str,
        mode: str = "overwrite",
        partition_by: Sequence[str] = (),
        batch: tuple[str, int] | None = None,
    ) -> WriteReport:
        """``append``, ``overwrite`` (the whole table) or ``error``. ``batch`` (stream, number): the rows get partitions of
        their own, so a batch that is repeated after a crash replaces itself."""
        if mode not in ("append", "overwrite", "error"):
            raise ValueError(f"unknown mode {mode}")
        old = self.table(name)
        if old is not None and mode == "error":
            raise FileExistsError(f"PATH_ALREADY_EXISTS: {self.path(name)}")
        if mode == "append" and old is not None:
            df, partition_by = df.select(old.schema.names), old.partition_by
        rows, counted = self._counted(df)
        key = _key_column(partition_by)
        if batch:
            key = F.concat(key, F.lit(_mark(batch)))
        if mode == "append" and batch:
            self._put(rows, name, partition_by, key, "overwrite", "dynamic")
        elif mode == "append":
            self._put(rows, name, partition_by, key, "append", "static")
        else:
            self._put(rows, name, partition_by, key, "overwrite", "static")
        if old is None or mode != "append":
            self._define(name, df.schema, partition_by)
        return WriteReport(self.path(name), rows=counted.get["rows"], columns=df.columns)

    def upsert(self, source: DataFrame, name: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> WriteReport:
        """Replace rows with a known key, add the others; create the table if there is none. Partitions the source does
        not touch are neither read nor written. Partition columns must be functions of the key."""
        old = self.table(name)
        keyed = F.lit(True)
        for key in keys:
            keyed = keyed & F.col(key).isNotNull()
        with self._staged(source if old is None else source.select(old.schema.names)) as rows:
            count, good = rows.agg(F.count("*"), F.count_if(keyed)).first()
            if count > good:
                self.write(rows.filter(~keyed), f"{name}__rejects", "append")
            report = self._upserted(rows.filter(keyed), name, keys, partition_by, old, good)
        report.rejected = count - good
        return report

    def insert_new(self, source: DataFrame, name: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> WriteReport:
        """Add one row of each key the table lacks; stored rows stay as they are. Partitions the source does not touch are
        not read. Rows whose key has a NULL go to ``<name>__rejects``."""
        old = self.table(name)
        if old is None:
            return self.upsert(source, name, keys, partition_by)
        keyed = F.lit(True)
        for key in keys:
            keyed = keyed & F.col(key).isNotNull()
        with self._staged(source.select(old.schema.names)) as rows:
            rejected = rows.filter(~keyed).count()
            if rejected:
                self.write(rows.filter(~keyed), f"{name}__rejects", "append")
            good = rows.filter(keyed)
            known = self._rows(name, old, self._keys(good, old.partition_by))
            with self._staged(delete_frame(one_per_key(good, list(keys)), known, keys).select(old.schema.names)) as new:
                if new.isEmpty():
                    report = WriteReport(self.path(name), skipped=True, reason="no new key", columns=old.schema.names)
                else:
                    report = self.write(new, name, "append")
        report.inserted, report.rejected = report.rows, rejected
        return report

    @contextlib.contextmanager
    def unknown(
        self, source: DataFrame, name: str, keys: Sequence[str], partition_by: Sequence[str], batch: tuple[str, int]
    ) -> Iterator[DataFrame]:
        """One row of each key that the table lacked before this batch, stored as long as they are in use. A batch that is
        repeated gets the same rows, though it has written some of them. Rows whose key has a NULL go to the rejects."""
        keyed = F.lit(True)
        for key in keys:
            keyed = keyed & F.col(key).isNotNull()
        old = self.table(name)
        with self._staged(source if old is None else source.select(old.schema.names)) as rows:
            if not rows.filter(~keyed).isEmpty():
                self.write(rows.filter(~keyed), f"{name}__rejects", "append", batch=batch)
            new = one_per_key(rows.filter(keyed), list(keys)).select(rows.columns)
            if old is not None:
                known = self._rows(name, old, self._keys(rows, old.partition_by), batch)
                new = delete_frame(new, known, keys).select(old.schema.names)
            with self._staged(new) as stored:
                yield stored

    def _upserted(self, source, name, keys, partition_by, old: Table | None, rows: int) -> WriteReport:
        if old is None:
            report = self.write(one_per_key(source, list(keys)), name, "error", partition_by)
            report.inserted = report.rows
            return report
        if not rows:
            return WriteReport(self.path(name), columns=old.schema.names)
        touched = self._keys(source, old.partition_by)
        frame = upsert_frame(self._rows(name, old, touched), source, list(keys), action="_action")
        seen = Observation(f"upsert-{uuid.uuid4().hex}")
        kinds = ("inserted", "updated", "copied")
        frame = frame.observe(seen, *[F.count_if(F.col("_action") == k).alias(k) for k in kinds]).drop("_action")
        self._replace(frame, name, old, touched)
        n = seen.get
        return WriteReport(self.path(name), n["inserted"] + n["updated"], *[n[k] for k in kinds], columns=old.schema.names)

    def delete(self, gone: DataFrame, name: str, keys: Sequence[str]) -> WriteReport:
        """Delete rows whose key is in ``gone``; a missing table or key is no error."""
        old = self.table(name)
        if old is None:
            return WriteReport(self.path(name), skipped=True, reason="no such table")
        wanted = list(dict.fromkeys([*keys, *[c for c in old.partition_by if c in gone.columns]]))
        with self._staged(gone.select(*wanted).distinct()) as gone:
            within = self._keys(gone, old.partition_by) if set(old.partition_by) <= set(wanted) else None
            hit = matched(self._rows(name, old, within), gone, keys)
            hit = hit.groupBy(_key_column(old.partition_by).alias(PART)).count().collect()
            if hit:
                touched = {r[PART] for r in hit}
                self._replace(delete_frame(self._rows(name, old, touched), gone, keys), name, old, touched)
        return WriteReport(self.path(name), deleted=sum(r["count"] for r in hit), columns=old.schema.names)

    def replace_users(self, df: DataFrame, name: str, users: DataFrame, partition_by: Sequence[str] = ()) -> WriteReport:
        """Put ``df`` in the place of everything stored for ``users``; a user without new rows ends up with none, the
        others keep theirs."""
        old = self.table(name)
        if old is None:
            return self.write(df, name, "error", partition_by)
        wanted = [c for c in users.columns if c in ("username", *old.partition_by)]
        with self._staged(df.select(old.schema.names)) as df, self._staged(users.select(*wanted).distinct()) as users:
            if set(old.partition_by) <= set(wanted):
                touched = self._keys(users, old.partition_by)
            else:
                touched = self._keys(matched(self._rows(name, old), users, ["username"]), old.partition_by)
            touched |= self._keys(df, old.partition_by)
            kept = delete_frame(self._rows(name, old, touched), users, ["username"])
            self._replace(kept.unionByName(df), name, old, touched)
        return WriteReport(self.path(name), columns=old.schema.names)

    # ---- how a change is stored

    def _keys(self, df: DataFrame, partition_by: Sequence[str]) -> set[str]:
        """The partitions some rows lie in: at most as many as Spark's own index of the table holds on the driver."""
        return {r[0] for r in df.select(_key_column(partition_by)).distinct().collect()}

    def _put(self, df: DataFrame, name: str, partition_by: Sequence[str], key: Column, mode: str, overwrite: str) -> None:
        """Files of even size: a hot partition is split into several files, small ones are not cut up by every task."""
        dealt = df.withColumn(PART, key)
        if partition_by:
            dealt = dealt.hint("rebalance", PART)
        dealt.write.mode(mode).option("partitionOverwriteMode", overwrite).partitionBy(PART).parquet(self.path(name))

    def _define(self, name: str, schema: StructType, partition_by: Sequence[str]) -> None:
        fields = []
        for f in schema.fields:
            place = {"partition": list(partition_by).index(f.name)} if f.name in partition_by else {}
            kept = {k: v for k, v in f.metadata.items() if k == "buckets"}
            fields.append(StructField(f.name, f.dataType, True, {**kept, **place}))
        empty = self.spark.createDataFrame([], StructType(fields))
        empty.coalesce(1).write.mode("overwrite").parquet(f"{self.path(name)}/_table")

    def _replace(self, df: DataFrame, name: str, old: Table, touched: set[str]) -> None:
        """``df`` takes the place of the touched partitions; those without rows in it, and the parts that batches of a stream
        have in them, go."""
        with self._staged(df.select(old.schema.names)) as rows:
            kept = {f"{PART}={k}" for k in self._keys(rows, old.partition_by)}
            self._put(rows, name, old.partition_by, _key_column(old.partition_by), "overwrite", "dynamic")
        start = len(PART) + 1
        for part in self.files.names(self.path(name)):
            if part.startswith(f"{PART}=") and part not in kept and part[start : start + KEY_LENGTH] in touched:
                self.files.delete(f"{self.path(name)}/{part}")

    @contextlib.contextmanager
    def _staged(self, df: DataFrame) -> Iterator[DataFrame]:
        """The rows of a source, worked out once and stored until the change is done."""
        path = f"{shared_dir(self.spark)}/staging/{uuid.uuid4().hex}"
        try:
            df.write.parquet(path)
            yield self.spark.read.schema(df.schema).parquet(path)
        finally:
            self.files.delete(path)

    def _counted(self, df: DataFrame) -> tuple[DataFrame, Observation]:
        seen = Observation(f"write-{uuid.uuid4().hex}")
        return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen

    # ---- serving reads

    def user_rows(self, name: str, schema: StructType, username: str) -> DataFrame:
        """A user's rows; of a table partitioned by user or by ``user_bucket`` only that partition is read."""
        found = self.table(name)
        if found is None:
            return self.spark.createDataFrame([], schema)
        only = None
        if found.partition_by == ["username"]:
            only = {_key((username,))}
        elif found.partition_by == ["user_bucket"] and found.buckets:
            user = self.spark.range(1).select(F.lit(username).alias("username"))
            only = self._keys(with_user_bucket(user, found.buckets), ["user_bucket"])
        return self._rows(name, found, only).filter(F.col("username") == username)

    def top_candidates(self, name: str, username: str, limit: int | None = None) -> DataFrame:
        rows = self.user_rows(name, schemas.TRACK_CANDIDATES, username)
        rows = rows.orderBy(F.col("score").desc_nulls_last(), "track_id").select(*schemas.TRACK_CANDIDATES.names)
        return rows if limit is None else rows.limit(limit)

    def top_artists(self, name: str, username: str, limit: int = 10) -> DataFrame:
        """Most played artists; rows without a name are left out after the cut."""
        rows = self.user_rows(name, schemas.ARTIST_PLAY_COUNT, username)
        best = rows.orderBy(F.col("play_count").desc(), F.col("artist_id").asc_nulls_last()).limit(limit)
        return best.filter(F.col("artist_name").isNotNull())

    def track_counts(self, name: str, username: str) -> DataFrame:
        return self.user_rows(name, schemas.TRACK_PLAY_COUNT, username)

    def user_stats(self, name: str, username: str) -> DataFrame:
        """One row, zeros for a user without statistics."""
        stored = self.user_rows(name, schemas.USER_STATS, username)
        wanted = self.spark.range(1).select(F.lit(username).alias("username"))
        joined = wanted.join(stored, "username", "left")
        return joined.select("username", *[F.coalesce(c, F.lit(0)).alias(c) for c in schemas.USER_STATS.names[1:]])
