"""Silver and gold row shaping: filters, assembly, chunk explosion, versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import chunking, ids
from tessera.functions.text import strip
from tessera.operators.ranking import newest_per_key


def require_fields(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with all of ``columns`` present, as predicates a Parquet scan understands."""
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def min_length(df: DataFrame, chars: int, length: Column) -> DataFrame:
    """Keep documents of at least ``chars`` characters.

    Pass the stored count column where there is one: the filter then reaches the
    Parquet scan.
    """
    return df.where(length >= chars)


def lower_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def explode_strings(df: DataFrame, chunks: Column, *keep: str) -> DataFrame:
    """One row per chunk of an ``array<string>``; empty arrays vanish."""
    return df.select(*keep, F.posexplode(chunks).alias("chunk_index", "text"))


def explode_pieces(df: DataFrame, pieces: Column, *keep: str) -> DataFrame:
    """One row per piece of :func:`tessera.functions.chunking.packed_chunks`."""
    rows = df.select(*keep, F.posexplode(pieces).alias("chunk_index", "piece"))
    return rows.select(*keep, "chunk_index", "piece.*")


def gold_chunks(
    silver: DataFrame,
    chunked_at: Column,
    size: int = config.GOLD_CHUNK_SIZE,
    overlap: int = config.GOLD_CHUNK_OVERLAP,
    separator: str = "\n\n",
    min_chars: int = config.MIN_CHUNK_DOC_CHARS,
) -> DataFrame:
    """Silver documents to gold chunk rows; map-only."""
    docs = silver.where(F.col("text").isNotNull() & (F.col("char_count") >= min_chars))
    pieces = chunking.packed_chunks(F.col("text"), size, overlap, separator)
    rows = explode_pieces(
        docs.select("doc_id", "source", "source_url", "title", "text"),
        pieces,
        "doc_id",
        "source",
        "source_url",
        "title",
    )
    return rows.select(
        ids.chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"),
        "doc_id",
        ids.id_prefix(F.col("doc_id")).alias("doc_id_prefix"),
        "source",
        "source_url",
        "title",
        "chunk_index",
        "text",
        F.char_length("text").alias("char_count"),
        "start_char",
        "end_char",
        "src_start",
        "src_end",
        chunked_at.alias("chunked_at"),
    )


def assemble_pages(
    pages: DataFrame, doc_col: str, page_col: str, text_col: str, pages_per_block: int = 256
) -> DataFrame:
    """Non-blank pages in order, stripped and joined by a blank line.

    ``page_count`` counts blank pages too.  Blocks of pages are joined first, so the
    pages of a very long document are sorted and joined by many tasks; one task
    only strings its blocks together.  The output row holds the whole document: to
    cut long ones into chunks without that row, see ``operators.packing``.
    """
    text = strip(F.col(text_col))
    shaped = pages.select(
        F.col(doc_col),
        F.floor(F.col(page_col) / pages_per_block).alias("_block"),
        F.when(text != "", F.struct(F.col(page_col).alias("p"), text.alias("t"))).alias("_page"),
    )
    blocks = shaped.groupBy(doc_col, "_block").agg(
        F.sort_array(F.collect_list("_page")).alias("_pages"), F.count("*").alias("_n")
    )
    joined = blocks.withColumn(
        "_part",
        F.when(
            F.size("_pages") > 0,
            F.struct("_block", F.array_join(F.col("_pages.t"), "\n\n").alias("t")),
        ),
    )
    docs = joined.groupBy(doc_col).agg(
        F.sort_array(F.collect_list("_part")).alias("_parts"), F.sum("_n").alias("page_count")
    )
    return docs.select(doc_col, F.array_join(F.col("_parts.t"), "\n\n").alias("text"), "page_count")


def current_version_per_url(
    silver: DataFrame, url_col: str = "source_url", time_col: str = "ingested_at"
) -> DataFrame:
    """Newest document of each canonical URL."""
    keyed = silver.withColumn("_url", ids.canonical_url(F.col(url_col)))
    return newest_per_key(keyed, ["_url"], time_col, [F.col("doc_id")]).drop("_url")


def merge_attributes(*maps: Column) -> Column:
    """One map of all attributes; later maps win on equal keys."""
    return reduce(_overlay, maps)


def _overlay(first: Column, later: Column) -> Column:
    later = F.coalesce(later, F.expr("cast(map() as map<string,string>)"))
    kept = F.map_filter(first, lambda k, v: ~F.array_contains(F.map_keys(later), k))
    return F.map_concat(kept, later)
