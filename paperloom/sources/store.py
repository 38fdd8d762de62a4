"""The papers table: create, append, insert-if-absent, update, delete.

Updates and deletes return the new content; the caller writes it as a new version, since files are
immutable.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from paperloom import schema
from paperloom.operators.windows import dedup_first


def create_papers_table(spark: SparkSession, name: str, path: str | None = None) -> int:
    """Drop the table if present, create it empty, return its row count."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = spark.createDataFrame([], schema.PAPERS).write.mode("overwrite")
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return spark.table(name).count()


def append_papers(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def absent_rows(new: DataFrame, existing: DataFrame, key: str, order: Sequence[str | Column]) -> DataFrame:
    """First row per key of ``new`` whose key is not stored. Rows without a key are not taken: they would be
    absent, and be inserted, each time."""
    return dedup_first(new.where(F.col(key).isNotNull()), [key], order).join(existing.select(key), key, "left_anti")


def insert_if_absent(
    new: DataFrame, existing: DataFrame, key: str, order: Sequence[str | Column]
) -> DataFrame:
    """Stored rows plus the absent ones; the stored row and the first new row win."""
    return existing.unionByName(absent_rows(new, existing, key, order).select(*existing.columns))


def update_by_key(
    existing: DataFrame, updates: DataFrame, key: str, columns: Sequence[str],
    order: Sequence[str | Column] | None = None,
) -> DataFrame:
    """Overwrite ``columns`` where the key matches. Of several updates the last by ``order`` wins."""
    if order is None:
        order = list(columns)
    ranking = Window.partitionBy(key).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    latest = (
        updates.withColumn("_rank", F.row_number().over(ranking)).filter("_rank = 1")
        .select(F.col(key), F.struct(*columns).alias("_new"))
    )
    joined = existing.join(latest, key, "left")
    out = [
        F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c)
        if c in columns else F.col(c)
        for c in existing.columns
    ]
    return joined.select(*out)


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is not true."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))
