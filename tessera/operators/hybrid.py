"""Hybrid search: dense and text top lists of the same chunks, fused by rank."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import head
from tessera.operators.dense import dense_search
from tessera.operators.fusion import reciprocal_rank_fusion
from tessera.operators.textindex import TextStats, text_search
from tessera.session import written


def hybrid_search(
    vectors: DataFrame,
    index: DataFrame,
    queries: DataFrame,
    k: int = config.TOP_K,
    *,
    dim: int,
    fetch: int = config.FETCH,
    rrf_k: int = config.RRF_K,
    mode: str = "any",
    stop_words: Sequence[str] | None = None,
    model_ver: str | None = None,
    where: Column | None = None,
    id_col: str = "chunk_id",
    stats: TextStats | None = None,
    posted: DataFrame | None = None,
    salts: int = 1,
) -> DataFrame:
    """Top ``k`` per query of the fused lists.

    ``queries`` has query_id, query_text and embedding; ``vectors`` holds the
    embeddings, ``index`` the terms of the same chunks.  ``fetch`` rows come from
    each list; keep it at 2k or more.  ``model_ver`` and ``where`` hold for both lists;
    ``stats`` are stored counts of the index, ``posted`` its stored postings.
    """
    dense = dense_search(
        vectors, queries, fetch, dim=dim, id_col=id_col, model_ver=model_ver, where=where, salts=salts
    )
    text = text_search(
        index, queries, fetch, mode=mode, id_col=id_col, stop_words=stop_words, model_ver=model_ver,
        where=where, stats=stats, posted=posted, salts=salts,
    )
    return reciprocal_rank_fusion(dense, text, k, rrf_k, id_col=id_col)


def attach_chunks(
    ranked: DataFrame,
    chunks: DataFrame,
    id_col: str = "chunk_id",
    head_chars: int = config.STORE_HEAD_CHARS,
    text_col: str = "text",
) -> DataFrame:
    """Fetch the chunk columns of ranked rows, the text cut to its head.

    ``ranked`` has at most k rows per query; they are stored and counted, and few go to the
    chunks by broadcast, so the chunks are not shuffled.
    """
    ranked = written(ranked, "ranked")
    if ranked.count() <= config.BROADCAST_ROWS:
        ranked = F.broadcast(ranked)
    body = [F.col(c) for c in chunks.columns if c != text_col]
    found = chunks.select(*body, head(F.col(text_col), head_chars).alias("chunk_text_head"))
    return found.join(ranked, id_col)
