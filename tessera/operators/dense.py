"""Cosine search: exact top-k of many queries over a table of vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.vectors import is_valid_vector
from tessera.operators.blockjoin import nearest_rows


def dense_search(
    corpus: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    dim: int,
    id_col: str = "chunk_id",
    query_col: str = "query_id",
    vector_col: str = "embedding",
    model_ver: str | None = None,
    where: Column | None = None,
    salts: int = 1,
    max_queries: int = config.QUERY_BLOCK_ROWS,
) -> DataFrame:
    """``(query, id, distance, rank)``, nearest first, ties by id.

    Rows without a valid vector are no results.  ``model_ver`` and ``where``
    filter before ranking, so they reach the scan.
    """
    if model_ver is not None:
        corpus = corpus.where(F.col("embedding_model_ver") == model_ver)
    if where is not None:
        corpus = corpus.where(where)
    return nearest_rows(
        corpus.select(id_col, vector_col), queries.select(query_col, vector_col), k, dim=dim, id_col=id_col,
        query_col=query_col, vector_col=vector_col, max_queries=max_queries, salts=salts,
    )


def split_invalid(df: DataFrame, vector_col: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable vector, and the quarantined rest."""
    valid = is_valid_vector(F.col(vector_col), dim)
    return df.where(valid), df.where(~valid)
