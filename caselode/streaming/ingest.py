"""Streaming ingest: files arriving in a folder become table rows once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def append_batches(stream: DataFrame, target: str, checkpoint: str, transform=None) -> StreamingQuery:
    """Writes each micro-batch under its own number, so that a repeated batch replaces itself; runs until nothing is left."""

    def write(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window start, key, n, total of ``value``; rows later than the watermark are left out of finished windows."""
    return (
        events.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), key, "n", "total")
    )


def first_seen(stream: DataFrame, keys: list[str], ts: str, late: str = "2 hours") -> DataFrame:
    """Rows whose keys were not seen within the watermark; the state is bounded by it."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
