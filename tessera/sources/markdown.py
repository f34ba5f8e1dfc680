"""Markdown corpus: folder = source, file name = part of the document id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import chunking, ids
from tessera.functions.text import first_line_title
from tessera.operators.documents import explode_strings


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    """``(source, file_name, text)``, one row per file below ``root``."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    parts = F.split(F.col("_metadata.file_path"), "/")
    return files.select(
        F.element_at(parts, -2).alias("source"),
        F.element_at(parts, -1).alias("file_name"),
        F.col("value").alias("text"),
    )


def file_stem(file_name: Column) -> Column:
    return F.regexp_replace(file_name, r"\.[^.]*$", "")


def corpus_chunks(
    files: DataFrame,
    size: int = config.CORPUS_CHUNK_SIZE,
    overlap: int = config.CORPUS_CHUNK_OVERLAP,
    min_chars: int = config.CORPUS_MIN_CHUNK,
) -> DataFrame:
    """``(source, file_name, text)`` to chunk rows; map-only."""
    docs = files.select(
        ids.file_document_id(F.col("source"), F.col("file_name")).alias("doc_id"),
        "source",
        first_line_title(F.col("text"), file_stem(F.col("file_name"))).alias("title"),
        F.lit(None).cast("string").alias("source_url"),
        "text",
    )
    cut = chunking.sliding_chunks(F.col("text"), size, overlap, min_chars)
    rows = explode_strings(docs, cut, "doc_id", "source", "title", "source_url")
    return rows.select(
        ids.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"),
        "*",
        F.char_length("text").alias("char_count"),
    )
