"""Bronze zone: JSON documents and raw blobs under ``source=S/date=D``."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.html import decode_utf8
from tessera.operators.stats import with_counters
from tessera.sources.store import clustered

# --- fixed values: the fields of a landed record and their types -----------------
METADATA = T.StructType(
    [
        T.StructField("doc_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("source_url", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("ingested_at", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("raw_object_key", T.StringType()),
        T.StructField("text_object_key", T.StringType()),
        T.StructField("byte_size", T.LongType()),
        T.StructField("char_count", T.LongType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)
BRONZE = T.StructType([T.StructField("metadata", METADATA), T.StructField("text", T.StringType())])
METADATA_FIELDS = METADATA.fieldNames()


def read_bronze(spark: SparkSession, root: str, multi_line: bool = True) -> DataFrame:
    """All landed documents with the declared schema; broken JSON gives NULL fields.

    ``multi_line`` reads one indented object per file; compacted bronze written by
    :func:`write_bronze` is one object per line and splits over tasks.
    """
    reader = spark.read.schema(BRONZE).option("multiLine", multi_line)
    return reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(root)


#: Where a record that is no JSON of the declared types is kept as it was read.
BROKEN = "_broken"


def read_checked(spark: SparkSession, root: str, multi_line: bool = True, names: str = "*.json") -> DataFrame:
    """All landed records with their file; what cannot be parsed stands whole in ``_broken``.

    A record is a line, or with ``multi_line`` a file (an array there gives a row for each
    element).  A field of another type than declared breaks its record, too; blank lines
    are no records.
    """
    reader = spark.read.schema(T.StructType([*BRONZE.fields, T.StructField(BROKEN, T.StringType())]))
    reader = reader.option("multiLine", multi_line).option("columnNameOfCorruptRecord", BROKEN).option("mode", "PERMISSIVE")
    rows = reader.option("recursiveFileLookup", True).option("pathGlobFilter", names).json(root)
    return rows.withColumn("file", F.col("_metadata.file_path"))


def with_state(checked: DataFrame) -> DataFrame:
    """Adds ``state``: ``broken``, ``incomplete`` (without id or text) or ``good``."""
    whole = F.col("metadata.doc_id").isNotNull() & F.col("text").isNotNull()
    state = F.when(F.col(BROKEN).isNotNull(), "broken").when(whole, "good").otherwise("incomplete")
    return checked.withColumn("state", state)


QUARANTINE = "state string, file string, record string, found_at timestamp"


def quarantine(
    spark: SparkSession, root: str, path: str, found_at: Column, multi_line: bool = True, names: str = "*.json"
) -> DataFrame:
    """Store the records of ``root`` that cannot become documents below ``path``, return the good ones flattened.

    A broken record is kept as it was read, an incomplete one as JSON of the declared
    fields.  A second run over the same files adds nothing: records known by file and
    content are left out.
    """
    rows = with_state(read_checked(spark, root, multi_line, names))
    bad = rows.where("state <> 'good'").select(
        "state", "file", F.coalesce(BROKEN, F.to_json(F.struct("metadata", "text"))).alias("record"), found_at.alias("found_at")
    )
    spark.createDataFrame([], QUARANTINE).write.mode("ignore").parquet(path)
    known = spark.read.schema(QUARANTINE).parquet(path).select("file", F.xxhash64("record").alias("_record"))
    fresh = bad.withColumn("_record", F.xxhash64("record")).join(known, ["file", "_record"], "left_anti")
    fresh.select("state", "file", "record", "found_at").write.mode("append").option("compression", "zstd").parquet(path)
    return flatten(rows.where("state = 'good'").drop("state", BROKEN))


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUARANTINE).parquet(path)


def flatten(bronze: DataFrame) -> DataFrame:
    """Metadata fields as columns, the time parsed, rows without id or text dropped."""
    flat = bronze.select("metadata.*", "text")
    typed = flat.withColumn("ingested_at", F.try_to_timestamp("ingested_at"))
    return typed.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


def to_documents(rows: DataFrame) -> DataFrame:
    """Bronze rows as ``(source, date, metadata, text)`` ready for JSON."""
    stamped = rows.withColumn(
        "ingested_at", F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    )
    return stamped.select("source", "date", F.struct(*METADATA_FIELDS).alias("metadata"), "text")


def write_bronze(rows: DataFrame, root: str, mode: str = "append") -> dict[str, int]:
    """JSON documents partitioned by source and date; a hot source becomes several files.

    Returns the counters of the written documents, taken by the write itself.
    """
    docs = clustered(to_documents(rows), ["source", "date"])
    docs, seen = with_counters(docs, f"bronze-{uuid.uuid4().hex}", chars=F.col("metadata.char_count"))
    docs.write.mode(mode).partitionBy("source", "date").json(f"{root.rstrip('/')}/text")
    return seen.get


def write_raw(rows: DataFrame, root: str, mode: str = "append") -> None:
    """Raw page bodies as binary, one row per object, with their object key."""
    blobs = rows.select("source", "date", "raw_object_key", F.col("raw").cast("binary").alias("raw"))
    blobs = clustered(blobs, ["source", "date"])
    blobs.write.mode(mode).partitionBy("source", "date").parquet(f"{root.rstrip('/')}/raw")


RAW = "raw_object_key string, raw binary, source string, date string"


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """Landed bodies with their key, source and date; the folders prune the scan."""
    return spark.read.schema(RAW).parquet(f"{root.rstrip('/')}/raw")


def raw_texts(spark: SparkSession, root: str) -> DataFrame:
    """Landed bodies as text; bytes that are no UTF-8 become replacement characters."""
    bodies = read_raw(spark, root)
    text = decode_utf8(F.col("raw"))
    return bodies.select("raw_object_key", "source", "date", F.octet_length("raw").alias("byte_size"), text.alias("text"))


def landed_ids(spark: SparkSession, root: str) -> DataFrame:
    """``(source, doc_id)`` of everything landed, reading two metadata fields only."""
    ids = spark.read.schema(BRONZE).json(f"{root.rstrip('/')}/text")
    return ids.select("metadata.source", "metadata.doc_id").where(F.col("doc_id").isNotNull())


def bronze_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Objects, files and bytes of text per source and date.

    Files are counted per (source, date, file) first, so a hot source is
    pre-aggregated on the map side.
    """
    docs = spark.read.schema(
        T.StructType([*BRONZE.fields, T.StructField("source", T.StringType()), T.StructField("date", T.StringType())])
    ).json(f"{root.rstrip('/')}/text")
    per_file = docs.groupBy("source", "date", F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("n"), F.first("_metadata.file_size").alias("bytes")
    )
    return per_file.groupBy("source", "date").agg(
        F.sum("n").alias("n_objects"), F.count("*").alias("n_files"), F.sum("bytes").alias("file_bytes")
    )
