"""The bucketed table: contents as by whole rewrites, writes limited to what they change, versions that survive a killed write."""

import os

import pytest
from pyspark.sql import functions as F

from paperloom.sources import buckets, store
from paperloom.sources.buckets import BucketTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", i, f"v{i % 7}") for i in range(200)] + [(None, -1, "no key")], "k string, n int, s string")
    return df, BucketTable.create(df, str(tmp_path / "t"), "k", 16)


def files(table, version):
    return {os.path.basename(d) for d, _, names in os.walk(f"{table.path}/data/version={version}") if any(n.endswith(".parquet") for n in names)}


def test_one_changed_row_rewrites_one_bucket(spark, table):
    df, first = table
    assert rows(first.read()) == rows(df) and len(files(first, 0)) == 16
    second = first.update(spark.createDataFrame([("k5", "new"), ("absent", "x")], "k string, s string"), ["s"])
    assert len(files(second, second.version)) == 1 and len(second.changed_since(first)) == 1
    assert rows(second.read()) == rows(store.update_by_key(df, spark.createDataFrame([("k5", "new")], "k string, s string"), "k", ["s"]))
    assert rows(first.read()) == rows(df) and rows(BucketTable.open(spark, first.path, 0).read()) == rows(df)
    assert rows(BucketTable.open(spark, first.path).read()) == rows(second.read())


def test_insert_adds_files_and_reads_only_their_buckets(spark, table):
    df, first = table
    new = spark.createDataFrame([("k3", 0, "known"), ("n1", 1, "a"), ("n1", 2, "b"), (None, 3, "c")], df.schema)
    second = first.insert_if_absent(new, ["n"])
    assert rows(second.read()) == rows(store.insert_if_absent(new, df, "k", ["n"]))
    assert len(files(second, second.version)) == 1 and second.insert_if_absent(new, ["n"]) is second
    assert not (set(first.parts) - set(second.parts))


def test_delete(spark, table):
    df, first = table
    second = first.delete((F.col("n") == 17) | F.col("n").isNull())
    assert rows(second.read()) == rows(store.delete_where(df, F.col("n") == 17)) and len(second.changed_since(first)) == 1
    empty = second.delete(F.lit(True))
    assert empty.read().count() == 0 and empty.read().schema == df.schema
    again = BucketTable.open(spark, empty.path).insert_if_absent(df, ["n"])
    assert again.read().count() == 200
    assert first.delete(F.lit(False)) is first


def test_a_killed_write_leaves_the_version_before(spark, table, monkeypatch):
    df, first = table
    update = spark.createDataFrame([(f"k{i}", "new") for i in range(50)], "k string, s string")
    broken = F.when(F.col("n") < 30, F.raise_error(F.lit("killed"))).otherwise(F.col("s"))
    with pytest.raises(Exception, match="killed"):  # in the middle of the data
        first._write(first.read().withColumn("s", broken.cast("string")), range(16), keep=False)
    assert rows(BucketTable.open(spark, first.path).read()) == rows(df)

    class Killed(Exception):
        pass

    def refuse(*_):
        raise Killed

    monkeypatch.setattr(spark, "createDataFrame", refuse, raising=False)  # after the data, before the version
    with pytest.raises(Killed):
        first.update(update, ["s"])
    monkeypatch.undo()
    again = BucketTable.open(spark, first.path)
    assert again.version == 0 and rows(again.read()) == rows(df)
    done = again.update(update, ["s"])
    assert done.version > 1 and rows(done.read()) == rows(store.update_by_key(df, update, "k", ["s"]))


def test_buckets_of_many_writes_are_merged(spark, table, monkeypatch):
    monkeypatch.setattr(buckets, "MOST_PARTS", 3)
    df, now = table
    for i in range(5):
        now = now.insert_if_absent(spark.createDataFrame([(f"x{i}{j}", i, "x") for j in range(40)], df.schema), ["n"])
    most = max(sum(b == part for part, _ in now.parts) for b in range(16))
    assert most <= 4 and now.read().count() == 401
    assert rows(now.compact().read()) == rows(now.read()) and len(now.compact().parts) == 16
