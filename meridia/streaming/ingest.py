"""Incremental ingest: a stream of new documents is parsed and upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meridia.plans.cases import add_records


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of (record_id string, raw_text string) as they arrive."""
    return spark.readStream.schema("record_id string, raw_text string").parquet(path)


def start(stream: DataFrame, store: str, checkpoint: str):
    """Upsert each micro-batch's built records into the stored table. A batch that runs twice gives the same table."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            add_records(batch, store)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
