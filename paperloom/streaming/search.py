"""Search as a stream: query files in, ranked papers out."""

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.plans.search import SearchFunction, semantic_search
from paperloom.staging import discarding, stage

QUERIES = "query_id long, query string"
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def stream_search(spark: SparkSession, path: str, papers: DataFrame, search: SearchFunction, sink: str,
                  checkpoint: str, k: int = 10) -> StreamingQuery:
    """Answer every new JSON-lines query file; a batch writes its own folder, so a replay overwrites it."""
    lines = spark.readStream.schema(QUERIES).json(path)
    return _answered(lines, papers, search, sink, checkpoint, k)


def _answered(lines: DataFrame, papers: DataFrame, search: SearchFunction, sink: str, checkpoint: str, k: int) -> StreamingQuery:
    def answer(batch: DataFrame, number: int) -> None:
        with discarding(batch.sparkSession):  # a batch's own tables go when it is answered
            asked = stage(batch, "asked")  # a batch is read more than once, and a state must be met only once
            found = semantic_search(asked, papers, search, k)
            # The papers of a batch come many times, which snappy's short window hardly sees.
            found.write.mode("overwrite").parquet(f"{sink}/batch={number}", compression="zstd")

    return lines.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def changed_queries(lines: DataFrame, expire_minutes: int = 24 * 60) -> DataFrame:
    """Queries whose text differs from the last one under the same id.

    The state of an id is a checksum of its text; it is forgotten when the id hasn't come for ``expire_minutes`` of processing time.
    Of several texts in one batch the greatest counts, so that a batch that is run again picks the same one.
    """
    def pick(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        text = None
        for frame in frames:
            own = frame["query"].dropna()
            if len(own):
                text = max(own.max(), text) if text is not None else own.max()
        mark = sha256((text or "").encode()).hexdigest()
        known = state.get[0] if state.exists else None
        state.update((mark,))
        state.setTimeoutDuration(expire_minutes * 60_000)
        if mark != known:
            yield pd.DataFrame({"query_id": [key[0]], "query": [text]})

    return lines.where("query_id is not null").groupBy("query_id").applyInPandasWithState(
        pick, QUERIES, "mark string", "append", GroupStateTimeout.ProcessingTimeTimeout)


def stream_search_changed(spark: SparkSession, path: str, papers: DataFrame, search: SearchFunction, sink: str,
                          checkpoint: str, k: int = 10, expire_minutes: int = 24 * 60) -> StreamingQuery:
    """As :func:`stream_search`, but a query that comes again with the same text isn't answered again.

    Ids expire when files come: batches without data, which would follow each other without end, are off.
    """
    lines = spark.readStream.schema(QUERIES).json(path)
    before = spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set(_EMPTY_BATCHES, "false")
    try:  # a started stream keeps the settings it began with
        return _answered(changed_queries(lines, expire_minutes), papers, search, sink, checkpoint, k)
    finally:
        spark.conf.set(_EMPTY_BATCHES, before)
