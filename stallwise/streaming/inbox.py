"""An incoming directory of batches, ingested as they arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stallwise.operators.ingest import ingest
from stallwise.sources.panels import RAW_SCHEMA


def watch(spark: SparkSession, inbox: str, layer: str, checkpoint: str, compared: Sequence[str], on_conflict: str = "replace") -> StreamingQuery:
    """Reads new Parquet files of an inbox and upserts each micro-batch; stops when the inbox is drained.

    A late day is an upsert like any other. A micro-batch that runs again after a failure changes nothing more, as its
    rows are duplicates by then."""

    def take(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            ingest(spark, batch, layer, compared, on_conflict)

    stream = spark.readStream.schema(RAW_SCHEMA).parquet(inbox)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
