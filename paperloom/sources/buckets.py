"""A table stored by buckets of its key: writes touch the buckets of the keys they change, and nothing else.

``data/version=<n>/bucket=<b>`` holds the files that write ``n`` made. ``versions/<n>`` lists, for every bucket, the
writes whose files make it up after write ``n``; it is written last, so a write that is killed leaves the version before
as it was, and its files are never read. A reader keeps the version that it opened.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from paperloom.operators.windows import dedup_first
from paperloom.sources import store
from paperloom.staging import stage

BUCKETS = 64
#: Writes that may make up a bucket before the next one to insert into it writes it anew.
MOST_PARTS = 16

_FILES = "bucket int, version long"


class BucketTable:
    """One version of a table; every change returns the next."""

    def __init__(self, spark: SparkSession, path: str, version: int, key: str, schema: StructType, buckets: int, parts: list[tuple[int, int]]):
        self.spark, self.path, self.version, self.key, self.schema, self.buckets, self.parts = spark, path, version, key, schema, buckets, parts

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> "BucketTable":
        """A new table with the first version holding ``rows``."""
        spark = rows.sparkSession
        spark.createDataFrame([(key, buckets, rows.schema.json())], "key string, buckets int, schema string").coalesce(1).write.parquet(f"{path}/table")
        return cls(spark, path, -1, key, rows.schema, buckets, [])._write(rows, range(buckets), keep=False)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> "BucketTable":
        """The last complete version, or an earlier one."""
        about = spark.read.parquet(f"{path}/table").first()
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        names = [int(s.getPath().getName()) for s in files.listStatus(folder)]
        done = [n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{n}/_SUCCESS"))]
        version = max(done) if version is None else version
        parts = [tuple(r) for r in spark.read.schema(_FILES).parquet(f"{path}/versions/{version}").collect()]
        return cls(spark, path, version, about.key, StructType.fromJson(json.loads(about.schema)), about.buckets, parts)

    def _bucket(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows, of all buckets or of some."""
        wanted = None if buckets is None else set(buckets)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in self.parts if wanted is None or b in wanted]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _touched(self, keys: DataFrame) -> list[int]:
        found = keys.select(self._bucket(self.key).alias("b")).distinct().collect()  # at most one row a bucket
        return sorted(r.b for r in found)

    def _write(self, rows: DataFrame, buckets: Iterable[int], keep: bool) -> "BucketTable":
        """The next version: ``rows`` replace the content of ``buckets``, or with ``keep`` are added to it."""
        number = self.version + 1
        while self._exists(f"{self.path}/data/version={number}"):  # left by a write that was killed
            number += 1
        target = f"{self.path}/data/version={number}"
        dealt = rows.select(*self.schema.names).withColumn("bucket", self._bucket(self.key)).repartition("bucket")
        dealt.write.partitionBy("bucket").parquet(target)
        changed = set(buckets)
        made = {b for b in changed if self._exists(f"{target}/bucket={b}")}
        parts = [(b, v) for b, v in self.parts if keep or b not in changed] + [(b, number) for b in sorted(made)]
        self.spark.createDataFrame(parts, _FILES).coalesce(1).write.parquet(f"{self.path}/versions/{number}")
        return BucketTable(self.spark, self.path, number, self.key, self.schema, self.buckets, parts)

    def _exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def insert_if_absent(self, new: DataFrame, order: Sequence[str | Column]) -> "BucketTable":
        """The first row of every key that the table lacks is added; only the buckets of new keys are looked at."""
        taken = stage(dedup_first(new.where(F.col(self.key).isNotNull()), [self.key], order).select(*self.schema.names), "taken")
        known = self.read(self._touched(taken)).select(self.key)
        absent = stage(taken.join(known, self.key, "left_anti").select(*self.schema.names), "absent")
        touched = self._touched(absent)
        if not touched:
            return self
        many = {b for b in touched if sum(part == b for part, _ in self.parts) >= MOST_PARTS}
        if many:
            return self.compact(many)._write(absent, touched, keep=True)
        return self._write(absent, touched, keep=True)

    def update(self, updates: DataFrame, columns: Sequence[str], order: Sequence[str | Column] | None = None) -> "BucketTable":
        """``columns`` of the rows whose key is among ``updates``; the buckets of keys that the table holds are written anew."""
        updates = stage(updates, "updates")
        known = self.read(self._touched(updates)).select(self.key).join(updates.select(self.key), self.key, "left_semi")
        touched = self._touched(known)
        if not touched:
            return self
        return self._write(store.update_by_key(self.read(touched), updates, self.key, columns, order), touched, keep=False)

    def delete(self, predicate: Column) -> "BucketTable":
        """Rows for which the predicate is true go; the buckets that hold one are written anew."""
        touched = self._touched(self.read().where(predicate).select(self.key))
        if not touched:
            return self
        return self._write(store.delete_where(self.read(touched), predicate), touched, keep=False)

    def compact(self, buckets: Iterable[int] | None = None) -> "BucketTable":
        """Buckets as one write each."""
        own = set(range(self.buckets) if buckets is None else buckets)
        return self._write(self.read(own), own, keep=False)

    def changed_since(self, before: "BucketTable") -> list[int]:
        """Buckets whose files differ from those of another version."""
        return sorted({b for b, _ in set(self.parts) ^ set(before.parts)})
