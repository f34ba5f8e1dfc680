"""Raw pages to bronze rows: clean, gate, identify, key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import html, ids
from tessera.operators.ranking import top_k_per_key
from tessera.operators.upsert import skip_landed

Extract = Callable[[Column, Column], dict[str, Column]]


def web_extract(url: Column, raw: Column) -> dict[str, Column]:
    """Default extractor: text, title, section and extra attributes."""
    how = F.when(html.needs_render(raw), F.lit("browser")).otherwise(F.lit("http"))
    return {
        "text": html.main_text(raw),
        "title": html.page_title(raw),
        "section": F.lit(None).cast("string"),
        "extra": F.create_map(F.lit("fetch_method"), how),
    }


def bronze_rows(
    pages: DataFrame,
    ingested_at: Column,
    landed: DataFrame | None = None,
    extract: Extract = web_extract,
    source_type: str = "web",
    raw_ext: str = "html",
    min_chars: int = config.MIN_INGEST_CHARS,
) -> DataFrame:
    """``pages`` (source, url, raw) to bronze rows.

    Pages with too little text are skipped; so are documents already landed for
    the source, under whatever date, and repeats within the batch.  The text key is
    computed before writing, so each object is written once.
    """
    parts = extract(F.col("url"), F.col("raw"))
    # Filtering inside the array keeps the extraction from being run once for the
    # filter and once more for the projection.
    extracted = F.array(F.struct(*[col.alias(n) for n, col in parts.items()]))
    long_enough = F.filter(extracted, lambda p: F.char_length(p["text"]) >= min_chars)
    clean = pages.select("source", "url", "raw", F.inline(long_enough))
    named = clean.withColumn("doc_id", ids.document_id(F.col("url"), F.col("text")))
    named = top_k_per_key(named, ["source", "doc_id"], [F.col("url"), F.col("raw")], 1, "_n").drop("_n")
    if landed is not None:
        named = skip_landed(named, landed)
    date = ids.date_stamp(ingested_at)
    source, doc_id = F.col("source"), F.col("doc_id")
    return named.select(
        "doc_id",
        "source",
        F.lit(source_type).alias("source_type"),
        F.col("url").alias("source_url"),
        "title",
        "section",
        ingested_at.alias("ingested_at"),
        ids.content_hash(F.col("text")).alias("content_hash"),
        ids.object_key(source, date, "raw", doc_id, raw_ext).alias("raw_object_key"),
        ids.object_key(source, date, "text", doc_id, "json").alias("text_object_key"),
        ids.byte_size(F.col("raw")).alias("byte_size"),
        ids.char_count(F.col("text")).alias("char_count"),
        "extra",
        date.alias("date"),
        "text",
        "raw",
    )
