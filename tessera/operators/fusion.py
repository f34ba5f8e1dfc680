"""Reciprocal rank fusion of ranked lists, and hybrid search on top of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.operators.ranking import top_k_per_key


def reciprocal_rank_fusion(
    dense: DataFrame,
    text: DataFrame,
    k: int = config.TOP_K,
    rrf_k: int = config.RRF_K,
    query_col: str = "query_id",
    id_col: str = "chunk_id",
) -> DataFrame:
    """Fuse two ranked lists by id.

    Each list carries a 1-based ``rank``; being absent from a list adds nothing.
    Other columns come from the dense row where there is one, else from the text
    row.  Ties keep the dense order, then the text order.
    """
    keys = [query_col, id_col]
    d = dense.withColumnRenamed("rank", "dense_rank")
    t = text.withColumnRenamed("rank", "text_rank")
    shared = [c for c in d.columns if c in t.columns and c not in keys]
    for c in shared:
        t = t.withColumnRenamed(c, f"_text_{c}")
    fused = d.join(t, keys, "full_outer")
    for c in shared:
        fused = fused.withColumn(c, F.coalesce(c, f"_text_{c}")).drop(f"_text_{c}")
    term = lambda r: F.coalesce(1.0 / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    fused = fused.withColumn("_score", term("dense_rank") + term("text_rank"))
    order = [
        F.col("_score").desc(),
        F.col("dense_rank").asc_nulls_last(),
        F.col("text_rank").asc_nulls_last(),
    ]
    return (
        top_k_per_key(fused, [query_col], order, k, "rrf_rank")
        .withColumn("rrf_score", F.round("_score", 6))
        .drop("_score")
    )


def fuse_lists(
    lists: Sequence[DataFrame],
    k: int = config.TOP_K,
    rrf_k: int = config.RRF_K,
    query_col: str = "query_id",
    id_col: str = "chunk_id",
) -> DataFrame:
    """Any number of ranked lists: union, sum of reciprocal ranks, top k."""
    union = None
    for i, ranked in enumerate(lists):
        part = ranked.select(query_col, id_col, "rank", F.lit(i).alias("_list"))
        union = part if union is None else union.unionByName(part)
    fused = union.groupBy(query_col, id_col).agg(
        F.sum(1.0 / (F.lit(rrf_k) + F.col("rank"))).alias("_score"),
        F.min(F.struct("_list", "rank")).alias("_first"),
    )
    order = [F.round("_score", 12).desc(), F.col("_first").asc(), F.col(id_col)]
    return (
        top_k_per_key(fused, [query_col], order, k, "rrf_rank")
        .withColumn("rrf_score", F.round("_score", 6))
        .drop("_score", "_first")
    )
