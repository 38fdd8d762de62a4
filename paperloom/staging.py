"""Cutting lineage and guarding broadcasts.

Iterative jobs and jobs that depend on a physical row order write an intermediate table in the shared
folder named by ``spark.checkpoint.dir`` and read it back, so a lost executor never changes a result.
"""

import atexit
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Of a hinted side, as the planner sees it; compressed files may hold several times that.
BROADCAST_BYTES = 32 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_dir = None
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for a local session that names none."""
    global _local_dir
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="paperloom-")
        atexit.register(shutil.rmtree, _local_dir, ignore_errors=True)
    return _local_dir


@contextmanager
def _shuffles_cleaned(spark: SparkSession):
    """What is written inside leaves no shuffle files, which otherwise stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written table; the write's own shuffle files go."""
    path = f"{shared_dir(df.sparkSession)}/paperloom/{label}-{uuid.uuid4().hex}"
    with _shuffles_cleaned(df.sparkSession):
        df.write.parquet(path)
    if _open():
        _open()[-1].append(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged._staged_at = path
    return staged


def _delete(spark: SparkSession, path: str) -> None:
    old = spark._jvm.org.apache.hadoop.fs.Path(path)
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)


def _open() -> list[list]:
    """The lists of what the open ``discarding`` blocks of this thread have staged and shared, innermost last."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    return _scopes.open


def share(spark: SparkSession, value) -> Broadcast:
    """A broadcast that lives until the ``discarding`` block around it ends."""
    shared = spark.sparkContext.broadcast(value)
    if _open():
        _open()[-1].append(shared)
    return shared


@contextmanager
def discarding(spark: SparkSession):
    """Remove what is staged and shared inside, but for the tables that the yielded function was given to keep.

    What leaves the block must be staged and kept, or read none of it.
    """
    made, kept = [], set()

    def keep(staged: DataFrame) -> DataFrame:
        kept.add(staged._staged_at)
        return staged

    _open().append(made)
    try:
        yield keep
    finally:
        _open().pop()
    for item in made:
        if isinstance(item, Broadcast):
            item.destroy()
        elif item not in kept:
            _delete(spark, item)
        elif _open():
            _open()[-1].append(item)


def discard(staged: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    _delete(staged.sparkSession, staged._staged_at)


def restage(df: DataFrame, previous: DataFrame, label: str = "stage") -> DataFrame:
    """Stage ``df`` and remove the earlier staged table that it replaces."""
    staged = stage(df, label)
    discard(previous)
    return staged


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan with fewer splits than cores to all cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the planner's size of the side, taken from files and schemas, is small.

    The planner takes the size of files, and sorted ids compress to a small part of what they take in memory. So a staged table
    counts with its rows, which are read from the footers of its files; nothing else runs to find out.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size <= max_bytes and hasattr(df, "_staged_at"):
        size = max(size, df.count() * (8 + df._jdf.schema().defaultSize()))
    return F.broadcast(df) if size <= max_bytes else df
