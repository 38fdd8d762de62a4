"""Orders and positions: dense ids, first row per key, token blocks, top-k per query."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from paperloom.functions.vectors import cosine
from paperloom.staging import stage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the lower bits


def dedup_first(df: DataFrame, key: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key. The rank filter is applied before the shuffle too, so a hot key is thin."""
    first = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def _partition_starts(staged: DataFrame, part: Column, amount: Column) -> DataFrame:
    """Running total before each range partition; one row per partition."""
    totals = staged.groupBy(part.alias("_part")).agg(amount.alias("_amount"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum("_amount").over(before), F.lit(0)).alias("_start"))


def assign_dense_ids(df: DataFrame, order: Sequence[str], id_col: str = "id") -> DataFrame:
    """Ids 0..n-1 in the given order, which must be total.

    Rows are range-partitioned and sorted; the number within the partition plus the count of the
    earlier partitions is the id. No partition ever holds more than its range.
    """
    numbered = df.drop(id_col) if id_col in df.columns else df
    numbered = numbered.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = stage(numbered.withColumn("_pos", F.monotonically_increasing_id()), "ids")
    part = F.shiftright("_pos", _ROW_BITS)
    starts = _partition_starts(numbered, part, F.count("*"))
    offset = F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        numbered.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(id_col, F.col("_start") + offset)
        .drop("_part", "_pos", "_start")
    )


def pack_token_blocks(
    df: DataFrame, order: Sequence[str], tokens: str = "tokens", block_size: int = 128
) -> DataFrame:
    """The corpus as one token sequence, cut in blocks; the short last block is dropped.

    Only pieces of token arrays are shuffled, and a block gathers at most ``block_size`` tokens.
    """
    ranged = (
        df.filter(F.size(tokens) > 0)
        .select(*order, tokens, F.size(tokens).cast("long").alias("_n"))
        .repartitionByRange(*order).sortWithinPartitions(*order)
    )
    out_schema = T.StructType(
        ranged.schema.fields
        + [T.StructField("_part", T.LongType()), T.StructField("_before", T.LongType())]
    )

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        total = 0
        for batch in batches:
            sizes = batch.column("_n").to_numpy()
            before = total + np.cumsum(sizes) - sizes
            total += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(sizes), part, "int64")), pa.array(before)],
                names=[*batch.schema.names, "_part", "_before"],
            )

    placed = stage(ranged.mapInArrow(running, out_schema), "tokens")
    starts = _partition_starts(placed, F.col("_part"), F.sum("_n"))
    begin = F.col("_start") + F.col("_before")
    first, last = F.floor(begin / block_size), F.floor((begin + F.col("_n") - 1) / block_size)
    pieces = (
        placed.join(F.broadcast(starts), "_part")
        .select(tokens, begin.alias("_begin"), F.explode(F.sequence(first, last)).alias("block_id"))
    )
    skip = F.greatest(F.col("block_id") * block_size - F.col("_begin"), F.lit(0))
    room = (F.col("block_id") + 1) * block_size - (F.col("_begin") + skip)
    pieces = pieces.select(
        "block_id", (F.col("_begin") + skip).alias("_at"),
        F.slice(tokens, (skip + 1).cast("int"), room.cast("int")).alias("_piece"),
    )
    blocks = pieces.groupBy("block_id").agg(
        F.flatten(F.transform(
            F.array_sort(F.collect_list(F.struct("_at", "_piece"))), lambda p: p["_piece"]
        )).alias("tokens")
    )
    return blocks.filter(F.size("tokens") == block_size)


def topk_per_query(
    scores: DataFrame, k: int, query: str = "query_id", item: str = "id", dist: str = "dist"
) -> DataFrame:
    """Nearest ``k`` items per query with their rank; ties go to the smaller id."""
    nearest = Window.partitionBy(query).orderBy(F.round(dist, 6), item)
    return scores.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def first_last_similarity(tokens: DataFrame, text: str, pos: str, vec: str) -> DataFrame:
    """Cosine of the first and the last token vector of every text."""
    ends = tokens.groupBy(text).agg(
        F.min_by(vec, pos).alias("_first"), F.max_by(vec, pos).alias("_last")
    )
    return ends.select(text, cosine(F.col("_first"), F.col("_last")).alias("similarity"))
