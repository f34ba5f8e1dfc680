"""Request histograms per tumbling window from a stream of request events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.operators.metrics import windowed_histogram
from tessera.operators.ranking import newest_per_key
from tessera.session import shared_folder
from tessera.sources.tables import table, table_glob

KEYS = ["window_start", "event_type"]


def windowed_stream(events: DataFrame, window: str, watermark: str) -> DataFrame:
    """Windowed histograms of ``events`` (ts TIMESTAMP, event_type, value)."""
    return windowed_histogram(
        events, "ts", F.col("value"), config.GENERATION_BUCKETS, window, "event_type",
        watermark=watermark,
    )


def write_updates(rolled: DataFrame, path: str, checkpoint: str) -> None:
    """Write each batch's changed windows to a folder of its own.

    A replayed batch overwrites its own folder, so the updates stay exact.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")

    (
        rolled.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """Latest state of every window and label."""
    updates = spark.read.option("basePath", path).parquet(path)
    return newest_per_key(updates, KEYS, "batch_id").drop("batch_id")


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a file stream; its zone-less times are read as UTC."""
    schema = table(spark, d, "events").schema
    events = spark.readStream.schema(schema).parquet(table_glob(d, "events"))
    epoch = F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'")
    micros = F.timestamp_diff("MICROSECOND", epoch, F.col("ts"))
    return events.withColumn("ts", F.timestamp_micros(micros))


def run_available(spark: SparkSession, d: str) -> DataFrame:
    """Daily histograms of all events, computed by the stream."""
    root = f"{shared_folder(spark).rstrip('/')}/metrics-{uuid.uuid4().hex}"
    rolled = windowed_stream(event_stream(spark, d), "1 day", "1 hour")
    write_updates(rolled, f"{root}/updates", f"{root}/checkpoint")
    return read_latest(spark, f"{root}/updates")
