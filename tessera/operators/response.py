"""Shape ranked rows into search responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import head, text_or_empty


def response_score(mode: str, rrf_score: Column | None = None, distance: Column | None = None) -> Column:
    """Fused score, or one minus the distance; a missing value counts as 0."""
    if mode == "hybrid":
        value = F.coalesce(rrf_score, F.lit(0.0))
    elif mode == "dense":
        value = 1.0 - F.coalesce(distance, F.lit(0.0))
    else:
        raise ValueError("mode must be dense or hybrid")
    return F.round(value, 4)


def response_rows(ranked: DataFrame, mode: str, rank_col: str) -> DataFrame:
    """One row per result with the response's fields."""
    score = response_score(mode, F.col("rrf_score")) if mode == "hybrid" else response_score(
        mode, distance=F.col("distance")
    )
    return ranked.select(
        "query_id",
        F.col(rank_col).alias("position"),
        text_or_empty(F.col("chunk_id").cast("string")).alias("chunk_id"),
        text_or_empty(F.col("doc_id").cast("string")).alias("doc_id"),
        text_or_empty(F.col("source")).alias("source"),
        F.coalesce(F.col("chunk_index"), F.lit(0)).alias("chunk_index"),
        "title",
        "source_url",
        score.alias("score"),
        head(F.col("chunk_text_head"), config.RESPONSE_HEAD_CHARS).alias("text_head"),
    )


def search_response(ranked: DataFrame, queries: DataFrame, mode: str, rank_col: str) -> DataFrame:
    """``(query_id, query, mode, results)``: one row per query, results in order.

    A query has at most k results, so its list is bounded; one without results
    gets an empty list.
    """
    rows = response_rows(ranked, mode, rank_col)
    fields = [c for c in rows.columns if c not in ("query_id", "position")]
    lists = rows.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("position", *fields))).alias("results")
    )
    answered = queries.select("query_id", F.col("query_text").alias("query")).join(
        lists, "query_id", "left"
    )
    ordered = F.transform("results", lambda r: F.struct(*[r[f].alias(f) for f in fields]))
    nothing = F.expr(f"cast(array() as {_list_type(rows, fields)})")
    return answered.select(
        "query_id",
        "query",
        F.lit(mode).alias("mode"),
        F.coalesce(ordered, nothing).alias("results"),
    )


def _list_type(rows: DataFrame, fields: list[str]) -> str:
    types = ",".join(f"{f}:{rows.schema[f].dataType.simpleString()}" for f in fields)
    return f"array<struct<{types}>>"


def to_json_lines(df: DataFrame, column: str = "value") -> DataFrame:
    """Each row as one JSON object."""
    return df.select(F.to_json(F.struct("*")).alias(column))
