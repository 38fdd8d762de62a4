"""Ingest as a stream: new dump files are appended as they arrive."""

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperloom import schema
from paperloom.functions import fixed
from paperloom.plans.ingest import new_papers
from paperloom.sources.store import append_papers


def stream_ingest(spark: SparkSession, path: str, store_path: str, checkpoint: str,
                  mapping: Mapping[str, str] = fixed.CATEGORY_NAMES) -> StreamingQuery:
    """Insert the papers of every new file under ``path`` that the table lacks, then stop.

    A batch that is replayed after a failure finds its keys stored and adds nothing.
    """
    def insert(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        stored = session.read.schema(schema.PAPERS).parquet(store_path)
        append_papers(new_papers(batch, stored, mapping), store_path)

    lines = spark.readStream.schema(schema.METADATA_JSON).option("mode", "FAILFAST").json(path)
    return (
        lines.select("*", "_metadata").writeStream.foreachBatch(insert)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
