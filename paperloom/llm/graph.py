"""Connected components of a link table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperloom.staging import stage

MAX_ROUNDS = 60


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)``; ``component`` is the smallest id that it reaches.

    Alternating large-star and small-star rounds: each hangs neighbours under the smallest known id and
    keeps the number of edges from growing. Every round is written to the shared folder, so a lost executor
    repeats at most one round. Self links and repeated links are harmless; null ends are dropped; an empty
    table gives an empty result. Groups meet through ``min`` aggregations, which combine before the shuffle.
    """
    spark = edges.sparkSession
    tidy = lambda df: df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = stage(tidy(edges.select("a", "b").dropna()), "links")
    seen = _checksum(now)
    for _ in range(MAX_ROUNDS):
        if not seen[0]:
            break
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stage(tidy(large), "links")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(tidy(small.unionByName(low.select("a", F.col("m").alias("b")))), "links")
        last, seen = seen, _checksum(now)
        if seen == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    stars = now.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    roots = stars.select(F.col("component").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return stars.unionByName(roots) if seen[0] else spark.createDataFrame([], stars.schema)
