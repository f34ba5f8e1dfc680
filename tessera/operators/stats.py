"""Counts and averages over documents, chunks and model versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def row_count(df: DataFrame, name: str = "n") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def with_counters(df: DataFrame, name: str, **sums: Column) -> tuple[DataFrame, Observation]:
    """``df`` with job counters filled by whatever action consumes it.

    Replaces a counting job of its own.  The counters are for the log: a retried
    task may be counted twice, so nothing is computed from them.
    """
    seen = Observation(name)
    totals = [F.sum(col.cast("bigint")).alias(key) for key, col in sums.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *totals), seen


def chunk_stats(chunks: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Documents, chunks and mean chunks per document."""
    per_doc = chunks.groupBy(doc_col).agg(F.count("*").alias("c"))
    return per_doc.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("n_chunks"),
        F.coalesce(F.round(F.avg("c"), 6), F.lit(0.0)).alias("avg_chunks_per_doc"),
    )


def source_stats(chunks: DataFrame, source_col: str = "source", doc_col: str = "doc_id") -> DataFrame:
    """Documents and chunks per source.

    Counting per document first keeps a hot source spread over its documents.
    """
    per_doc = chunks.groupBy(source_col, doc_col).agg(F.count("*").alias("c"))
    return per_doc.groupBy(source_col).agg(
        F.count("*").alias("n_docs"), F.sum("c").alias("n_chunks")
    )


def version_counts(table: DataFrame, version_col: str = "embedding_model_ver") -> DataFrame:
    """Rows per model version and their total under ``_total`` (0 for an empty table)."""
    per_version = table.groupBy(version_col).agg(F.count("*").alias("n"))
    total = table.agg(F.lit("_total").alias(version_col), F.count("*").alias("n"))
    return per_version.unionByName(total)


def version_rollup(table: DataFrame, version_col: str = "embedding_model_ver") -> DataFrame:
    """The same in one pass: the total is that of the counts, 0 if there are none."""
    per_version = table.groupBy(version_col).agg(F.count("*").alias("n"))
    total = per_version.agg(F.lit("_total").alias(version_col), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return per_version.unionByName(total)


def count_deltas(before: DataFrame, after: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Signed differences of ``counts`` per key between two states of the touched rows.

    Both sides are counted where they lie; keys whose counts stay the same drop out.
    """
    minus = before.select(*keys, *[(-F.col(c)).alias(c) for c in counts])
    both = minus.unionByName(after.select(*keys, *counts))
    summed = both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts])
    moved = F.lit(False)
    for c in counts:
        moved = moved | (F.col(c) != 0)
    return summed.where(moved)


def merge_counts(stored: DataFrame, deltas: DataFrame, keys: Sequence[str], counts: Sequence[str]) -> DataFrame:
    """Stored counts after ``deltas``; keys whose first count falls to 0 go.

    Reads counts only, never what they were counted from.
    """
    both = stored.select(*keys, *counts).unionByName(deltas.select(*keys, *counts))
    return both.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counts]).where(F.col(counts[0]) > 0)


def inventory(files: DataFrame, keys: Sequence[str] = ("source", "date")) -> DataFrame:
    """Objects and bytes per partition of a landed data set."""
    return files.groupBy(*keys).agg(
        F.count("*").alias("n_objects"), F.sum("byte_size").alias("total_bytes")
    )
