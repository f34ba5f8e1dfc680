"""Incremental bronze to silver: a file stream upserted batch by batch.

Replaying a batch changes nothing: the newest row per document is taken and only
unknown documents or changed content are written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import ids
from tessera.plans import jobs
from tessera.session import shared_folder
from tessera.sources import bronze, store
from tessera.sources.tables import table, table_glob


def upsert_stream(stream: DataFrame, silver_path: str, checkpoint: str) -> None:
    """Run ``stream`` (flat silver rows) to its end, upserting each micro-batch."""
    spark = stream.sparkSession
    store.create_table(spark, silver_path, "silver")

    def apply(batch: DataFrame, batch_id: int) -> None:
        # The stream's own session plans without adaptive execution, which the
        # rebalanced writes rely on; a micro-batch is an ordinary batch here.
        batch.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")
        # A micro-batch is bounded by its number of files and used several times.
        newest = jobs.newest_documents(batch).persist()
        try:
            jobs.apply_silver(batch.sparkSession, newest, silver_path)
        finally:
            newest.unpersist()

    (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def bronze_stream(spark: SparkSession, bronze_root: str, max_files: int = 10_000) -> DataFrame:
    """Landed JSON documents as a stream of flat rows."""
    raw = (
        spark.readStream.schema(bronze.BRONZE)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .option("maxFilesPerTrigger", max_files)
        .json(f"{bronze_root.rstrip('/')}/text")
    )
    return store.with_ingest_date(bronze.flatten(raw))


def document_stream(spark: SparkSession, d: str) -> DataFrame:
    """The documents table read as a file stream of silver rows."""
    schema = table(spark, d, "documents").schema
    docs = spark.readStream.schema(schema).parquet(table_glob(d, "documents"))
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        "source",
        F.lit("web").alias("source_type"),
        F.lit(None).cast("string").alias("source_url"),
        F.col("lang").alias("title"),
        F.lit(None).cast("string").alias("section"),
        F.timestamp_seconds(F.lit(1_704_067_200)).alias("ingested_at"),
        ids.content_hash(text).alias("content_hash"),
        F.lit(None).cast("string").alias("raw_object_key"),
        F.lit(None).cast("string").alias("text_object_key"),
        ids.byte_size(text).alias("byte_size"),
        ids.char_count(text).alias("char_count"),
        F.lit(None).cast("map<string,string>").alias("extra"),
        "text",
    )
    return store.with_ingest_date(rows)


def upsert_available(spark: SparkSession, d: str) -> DataFrame:
    """Stream all documents into a new silver table, then replay the same input.

    The replay starts from an empty checkpoint and must leave the table as it is.
    """
    root = f"{shared_folder(spark).rstrip('/')}/incremental-{uuid.uuid4().hex}"
    silver_path = f"{root}/silver"
    for run in ("first", "replay"):
        upsert_stream(document_stream(spark, d), silver_path, f"{root}/checkpoint-{run}")
    silver = store.read_table(spark, silver_path, "silver")
    return silver.select("doc_id", "source", "content_hash", "char_count")
