"""The registered queries: name -> (spark, folder) -> DataFrame.

Every query reads whole tables.  Counters are BIGINT and times are epoch numbers,
so that the SQL checks compare values and not type conventions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions import chunking, html, ids, text, vectors
from tessera.operators import (
    ann,
    context,
    dense,
    documents,
    evaluation,
    frontier,
    fusion,
    history,
    hybrid,
    landing,
    metrics,
    ordering,
    packing,
    ranking,
    response,
    routing,
    stats,
    textindex,
    upsert,
)
from tessera.plans import inputs, jobs
from tessera.plans.inputs import at, big, md5_of
from tessera.sources import bronze, markdown, store
from tessera.sources.tables import table, wide_table
from tessera.streaming import incremental, request_metrics

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- identities, filters, newest rows, upserts ---------------------------------


@query
def doc_identity(spark, d):
    pages = table(spark, d, "pages")
    link, body = F.col("url"), F.col("html")
    return pages.select(
        "page_id",
        ids.canonical_url(link).alias("canonical_url"),
        ids.document_id(link, body).alias("doc_id"),
        ids.content_hash(body).alias("content_hash"),
        ids.byte_size(body).alias("byte_size"),
        ids.char_count(body).alias("char_count"),
    )


@query
def newest_per_key(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    newest = ranking.newest_per_key(events, ["user_id"], "ts", [F.col("event_id").desc()])
    return newest.drop("ts")


@query
def filter_documents(spark, d):
    docs = documents.require_fields(table(spark, d, "documents"), "doc_id", "text")
    long_enough = documents.min_length(docs, config.MIN_CHUNK_DOC_CHARS, F.col("n_chars"))
    return long_enough.select("doc_id", "source", "lang", "n_chars")


@query
def conditional_upsert(spark, d):
    return upsert.upsert(
        inputs.base_documents(spark, d), inputs.recrawled_documents(spark, d), ["doc_id"], "content_hash"
    )


@query
def full_upsert(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    priced = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.lit("R").alias("o_orderstatus"), F.round(F.sum(net), 4).alias("o_totalprice")
    )
    # One row per key by construction: the aggregation is the check.
    return upsert.upsert(orders, priced, ["o_orderkey"], check_duplicates=False)


@query
def upsert_versions(spark, d):
    docs = table(spark, d, "documents").select("doc_id", ids.char_count(F.col("text")).alias("char_count"))

    def rows(df, version):
        return df.select(
            ids.chunk_id(F.col("doc_id"), F.lit(0)).alias("chunk_id"),
            F.lit(version).alias("embedding_model_ver"),
            "char_count",
        )

    target = rows(docs, "v1").withColumn("created_at", at(inputs.BASE_TIME)).withColumn(
        "updated_at", at(inputs.BASE_TIME)
    )
    again = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id").withColumn(
        "char_count", F.col("char_count") + 1
    )
    batch = rows(again, "v1").unionByName(rows(again, "v2"))
    merged = upsert.upsert_with_audit(
        target, batch, ["chunk_id", "embedding_model_ver"], at(inputs.NOW_TIME)
    )
    return merged.select(
        "chunk_id",
        "embedding_model_ver",
        "char_count",
        F.unix_seconds("created_at").alias("created_epoch"),
        F.unix_seconds("updated_at").alias("updated_epoch"),
    )


@query
def skip_landed(spark, d):
    incoming = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    landed = incoming.join(table(spark, d, "labels").select("doc_id"), "doc_id")
    return upsert.skip_landed(incoming, landed)


@query
def current_versions(spark, d):
    pages = table(spark, d, "pages").select(
        F.col("url").alias("source_url"), F.col("page_id").alias("doc_id")
    )
    newest = documents.current_version_per_url(pages, time_col="doc_id")
    return newest.select(ids.canonical_url(F.col("source_url")).alias("canonical_url"), "doc_id")


@query
def prune_orphans(spark, d):
    docs = wide_table(spark, d, "documents").select("doc_id", "text")
    stored = documents.explode_strings(docs, chunking.sliding_chunks(F.col("text")), "doc_id")
    labelled = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id")
    again = documents.explode_strings(labelled, chunking.run_to_end_windows(F.col("text")), "doc_id")
    kept = upsert.prune_orphans(
        stored.select("doc_id", "chunk_index"), again, ["doc_id", "chunk_index"], "doc_id"
    )
    return kept.select("doc_id", big("chunk_index").alias("chunk_index"))


# --- chunks and counts ----------------------------------------------------------


@query
def window_chunks(spark, d):
    docs = wide_table(spark, d, "documents").select("doc_id", "text")
    rows = documents.explode_strings(docs, chunking.run_to_end_windows(F.col("text")), "doc_id")
    step = config.GOLD_CHUNK_SIZE - config.GOLD_CHUNK_OVERLAP
    return rows.select(
        "doc_id",
        big("chunk_index").alias("chunk_index"),
        big(F.col("chunk_index") * step).alias("start_char"),
        ids.char_count(F.col("text")).alias("char_count"),
        md5_of(F.col("text")).alias("text_md5"),
    )


@query
def sliding_chunks(spark, d):
    chunks = inputs.document_chunks(spark, d)
    return chunks.select(
        "chunk_id",
        "doc_id",
        "source",
        "chunk_index",
        ids.char_count(F.col("text")).alias("char_count"),
        md5_of(F.col("text")).alias("text_md5"),
    )


@query
def assemble_documents(spark, d):
    return inputs.assembled_conversations(spark, d).select(
        "conv_id",
        "page_count",
        ids.char_count(F.col("text")).alias("char_count"),
        md5_of(F.col("text")).alias("text_md5"),
    )


@query
def paragraph_chunks(spark, d):
    chunks = packing.pack_pages(table(spark, d, "conversations"), "conv_id", "turn", "text")
    doc_id = F.col("conv_id").cast("string")
    return chunks.select(
        ids.chunk_id(doc_id, F.col("chunk_index")).alias("chunk_id"),
        ids.id_prefix(doc_id).alias("doc_id_prefix"),
        "chunk_index",
        ids.char_count(F.col("text")).alias("char_count"),
        "start_char",
        "end_char",
        md5_of(F.col("text")).alias("text_md5"),
    )


@query
def chunk_positions(spark, d):
    """Place of every chunk in the order of documents and their chunks."""
    chunks = inputs.document_chunks(spark, d).select("chunk_id", "doc_id", "chunk_index")
    return ordering.with_positions(chunks, [F.asc("doc_id"), F.asc("chunk_index")])


@query
def corpus_load(spark, d):
    files = wide_table(spark, d, "documents").select(
        "source", F.concat(F.col("doc_id").cast("string"), F.lit(".md")).alias("file_name"), "text"
    )
    chunks = markdown.corpus_chunks(files)
    return chunks.select(
        "chunk_id", "source", "title", big("char_count").alias("char_count"),
        md5_of(F.col("text")).alias("text_md5"),
    )


@query
def chunk_stats(spark, d):
    return stats.chunk_stats(inputs.document_chunks(spark, d))


@query
def source_stats(spark, d):
    return stats.source_stats(inputs.document_chunks(spark, d))


@query
def version_counts(spark, d):
    docs = table(spark, d, "documents").select(F.lit("v1").alias("embedding_model_ver"))
    labelled = table(spark, d, "labels").select(F.lit("v2").alias("embedding_model_ver"))
    return stats.version_rollup(docs.unionByName(labelled))


# --- text index and search ------------------------------------------------------


def _document_index(spark, d):
    return textindex.forward_index(wide_table(spark, d, "documents"), "doc_id")


@query
def term_stats(spark, d):
    return textindex.term_stats(_document_index(spark, d))


@query
def term_upkeep(spark, d):
    """Stored counts of terms after a batch, from the texts it touches only."""
    stored = inputs.document_tables(spark, d).stats.terms.select("term", "df", "cf")
    sides = [textindex.term_stats(textindex.forward_index(rows, "doc_id")) for rows in inputs.recrawled_texts(spark, d)]
    counts = ["df", "cf"]
    return stats.merge_counts(stored, stats.count_deltas(*sides, ["term"], counts), ["term"], counts)


@query
def source_upkeep(spark, d):
    """Stored counts of sources after the same batch."""

    def counted(rows):
        return rows.groupBy("source").agg(
            F.count("*").alias("n_docs"), F.sum(ids.char_count(F.col("text"))).alias("n_chars")
        )

    def write(path):
        counted(table(spark, d, "documents").where("text is not null")).write.parquet(path)

    stored = spark.read.parquet(inputs.written_once(spark, d, "source-counts", write))
    sides = [counted(rows) for rows in inputs.recrawled_texts(spark, d)]
    counts = ["n_docs", "n_chars"]
    return stats.merge_counts(stored, stats.count_deltas(*sides, ["source"], counts), ["source"], counts)


@query
def empty_rollup(spark, d):
    """Counts per version of embeddings without a vector: no version, and a total of 0."""
    rows = table(spark, d, "embeddings").where(F.size("embedding") == 0)
    return stats.version_rollup(rows.select(F.lit("v1").alias("embedding_model_ver")))


@query
def text_corpus_stats(spark, d):
    totals = textindex.corpus_stats(_document_index(spark, d))
    return totals.withColumn("avg_terms", F.round("avg_terms", 6))


@query
def query_forms(spark, d):
    raw = F.col("text")
    return table(spark, d, "benchmark").select(
        "item_id",
        text.sanitize_query(raw).alias("sanitized"),
        text.all_terms_query(raw).alias("and_query"),
    )


@query
def bm25_topk(spark, d):
    stored = inputs.document_tables(spark, d)
    hits = textindex.text_search(
        stored.index, inputs.benchmark_queries(spark, d), config.FETCH, id_col="doc_id", stats=stored.stats, posted=stored.postings
    )
    return hits.select(
        "query_id", "doc_id", F.round("fts_score", 6).alias("fts_score"), big("rank").alias("rank")
    )


@query
def text_match_modes(spark, d):
    stored = inputs.document_tables(spark, d)
    return textindex.match_counts(
        stored.index,
        inputs.benchmark_queries(spark, d),
        id_col="doc_id",
        stop_words=config.STOP_WORDS,
        stats=stored.stats,
        posted=stored.postings,
    )


@query
def phrase_topk(spark, d):
    stored = inputs.document_tables(spark, d)
    hits = textindex.text_search(
        stored.index,
        inputs.benchmark_queries(spark, d),
        config.TOP_K,
        mode="phrase",
        id_col="doc_id",
        stats=stored.stats,
        posted=stored.postings,
    )
    return hits.select(
        "query_id", "doc_id", F.round("fts_score", 6).alias("fts_score"), big("rank").alias("rank")
    )


# --- vectors ---------------------------------------------------------------------


@query
def hash_embedding(spark, d):
    docs = inputs.embedded(wide_table(spark, d, "documents").select("doc_id", "text"), "text")
    v = F.transform("embedding", lambda x: x.cast("int"))
    return docs.select(
        "doc_id",
        big(F.size(F.filter(v, lambda x: x != 0))).alias("n_nonzero"),
        big(vectors.dot(F.col("embedding"), F.col("embedding"))).alias("norm_squared"),
        F.md5(F.array_join(F.transform(v, lambda x: x.cast("string")), ",")).alias("vector_md5"),
    )


@query
def vector_validation(spark, d):
    rows = table(spark, d, "embeddings").select(
        "label", vectors.is_valid_vector(F.col("embedding"), 64).alias("ok")
    )
    return rows.groupBy(big("label").alias("label")).agg(
        F.count("*").alias("n"),
        F.sum(F.col("ok").cast("bigint")).alias("n_valid"),
    )


@query
def dense_topk(spark, d):
    hits = dense.dense_search(
        table(spark, d, "embeddings"),
        inputs.label_centroids(spark, d),
        config.FETCH,
        dim=64,
        id_col="vec_id",
    )
    return hits.select(
        "query_id", "vec_id", F.round("distance", 6).alias("distance"), big("rank").alias("rank")
    )


def _centers(df):
    rows = df.orderBy("query_id").collect()  # one row per label
    if len(rows) > config.MAX_CELLS:
        raise ValueError(f"{len(rows)} labels are more than {config.MAX_CELLS} cells")
    return ann.unit_rows(np.array([r["embedding"] for r in rows]))


def _cells(spark, d):
    """The label centroids as given cells, and the stored index of all vectors by cell."""
    centers = _centers(inputs.label_centroids(spark, d))

    def write(path):
        ann.write_index(ann.assign_cells(table(spark, d, "embeddings"), "embedding", 64, centers), path)

    return centers, spark.read.parquet(inputs.written_once(spark, d, "cells", write))


@query
def cell_topk(spark, d):
    """Approximate search with the label centroids as given cells, three probes."""
    centers, indexed = _cells(spark, d)
    hits = ann.ann_search(
        indexed, inputs.label_midpoints(spark, d), 10, centers=centers, n_probe=3, dim=64, id_col="vec_id"
    )
    return hits.select(
        "query_id", "vec_id", F.round("distance", 6).alias("distance"), big("rank").alias("rank")
    )


@query
def ann_topk_recall(spark, d):
    """Probes tuned to the target on one query set, the recall of another against exact search."""
    centers, indexed = _cells(spark, d)
    corpus = table(spark, d, "embeddings").select("vec_id", "embedding")
    asked = corpus.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    tuned_on = inputs.label_midpoints(spark, d)
    n_probe = ann.tune_probes(spark, indexed, tuned_on, 10, centers=centers, dim=64, id_col="vec_id")
    found = ann.ann_search(indexed, asked, 10, centers=centers, n_probe=n_probe, dim=64, id_col="vec_id")
    exact = dense.dense_search(corpus, asked, 10, dim=64, id_col="vec_id")
    report = ann.recall_report(found, exact, "query_id", "vec_id")
    return report.withColumn("n_probe", big(F.lit(n_probe)))


# --- fusion, hybrid search, responses, contexts -----------------------------------


@query
def rrf_fuse(spark, d):
    lists = inputs.language_rankings(spark, d)
    fused = fusion.reciprocal_rank_fusion(lists["longest"], lists["hashed"], 10)
    return fused.select(
        F.col("query_id").alias("lang"),
        F.col("chunk_id").alias("doc_id"),
        big("dense_rank").alias("first_rank"),
        big("text_rank").alias("second_rank"),
        "rrf_score",
        big("rrf_rank").alias("rrf_rank"),
    )


@query
def hybrid_search_topk(spark, d):
    return _fused(inputs.hybrid_hits(inputs.chunk_tables(spark, d), inputs.benchmark_queries(spark, d)))


def _fused(fused):
    return fused.select(
        "query_id",
        "chunk_id",
        big("dense_rank").alias("dense_rank"),
        big("text_rank").alias("text_rank"),
        "rrf_score",
        big("rrf_rank").alias("rrf_rank"),
    )


@query
def hybrid_search_versions(spark, d):
    """Chunks under two model versions (one for English): a search knows its own version only."""
    tables = inputs.versioned_tables(spark, d)
    asked = inputs.embedded(inputs.benchmark_queries(spark, d), "query_text")
    found = [
        hybrid.hybrid_search(
            tables.vectors, tables.index, asked, dim=config.EMBED_DIM, model_ver=v, stats=tables.stats, posted=tables.postings
        )
        for v in ("v1", "v2")
    ]
    versions = [_fused(f).withColumn("model_ver", F.lit(v)) for f, v in zip(found, ("v1", "v2"), strict=True)]
    return reduce(DataFrame.unionByName, versions)


@query
def search_response(spark, d):
    rows = response.response_rows(inputs.hybrid_rows(spark, d), "hybrid", "rrf_rank")
    return rows.withColumn("position", big("position")).drop("title", "source_url")


@query
def search_response_dense(spark, d):
    rows = response.response_rows(inputs.dense_rows(spark, d), "dense", "rank")
    return rows.withColumn("position", big("position")).drop("title", "source_url")


@query
def search_response_json(spark, d):
    answered = response.search_response(
        inputs.hybrid_rows(spark, d), inputs.benchmark_queries(spark, d), "hybrid", "rrf_rank"
    )
    # Doubles are printed by each engine in its own way: digits only.
    brief = F.transform(
        "results",
        lambda r: F.struct(
            r["chunk_id"].alias("chunk_id"),
            r["source"].alias("source"),
            r["chunk_index"].alias("chunk_index"),
            F.round(r["score"] * 10000).cast("bigint").alias("score_e4"),
            r["text_head"].alias("text_head"),
        ),
    )
    return answered.select(
        "query_id", "mode", big(F.size("results")).alias("n_results"), F.to_json(brief).alias("results")
    )


@query
def context_pack(spark, d):
    rows = inputs.hybrid_rows(spark, d)
    packed = context.pack_context(rows, "rrf_rank", 2000)
    asked = inputs.benchmark_queries(spark, d)
    prompt = context.render_prompt(F.col("context"), F.col("query_text"))
    return packed.join(asked, "query_id").select(
        "query_id",
        big("n_used").alias("n_used"),
        big("used_chars").alias("used_chars"),
        md5_of(F.col("context")).alias("context_md5"),
        md5_of(prompt).alias("prompt_md5"),
    )


@query
def citations(spark, d):
    return context.citations(inputs.hybrid_rows(spark, d), "rrf_rank", 2000).withColumn(
        "number", big("number")
    )


# --- routing and evaluation --------------------------------------------------------


@query
def route_questions(spark, d):
    routed = routing.route(inputs.user_sentences(spark, d))
    return routed.select(
        "conv_id", "turn", big("sentence").alias("sentence"), "intent", "augmented_question"
    )


@query
def retry_pass(spark, d):
    planned = routing.plan_retry(routing.route(inputs.question_answer_turns(spark, d)))
    return planned.select(
        "conv_id", "turn", "intent", "is_poor", big("retry_count").alias("retry_count"), "retry_question"
    )


def _evaluation(spark, d):
    tables = inputs.chunk_tables(spark, d)
    asked = inputs.benchmark_questions(spark, d)
    hits = inputs.hybrid_hits(tables, asked.select("query_id", "query_text"))
    rows = inputs.attach_chunks(hits, inputs.chunk_rows(tables), head_chars=config.EVAL_HEAD_CHARS)
    retrieved = inputs.embedded(
        rows.select("query_id", "chunk_text_head"), "chunk_text_head", "chunk_vec"
    )
    questions = inputs.embedded(
        inputs.embedded(asked, "query_text", "question_vec"), "answer", "answer_vec"
    ).drop("query_text")
    return evaluation.score_retrieval(questions, retrieved)


@query
def retrieval_eval(spark, d):
    return _evaluation(spark, d)


@query
def eval_means(spark, d):
    return evaluation.mean_scores(_evaluation(spark, d))


@query
def ranker_comparison(spark, d):
    lists = inputs.language_rankings(spark, d)
    fused = fusion.reciprocal_rank_fusion(lists["longest"], lists["hashed"], config.FETCH)
    lists["fused"] = fused.select("query_id", "chunk_id", F.col("rrf_rank").alias("rank"))
    ranked = reduce(
        DataFrame.unionByName,
        [
            df.select(
                F.lit(name).alias("ranker"), "query_id", F.col("chunk_id").alias("item_id"), "rank"
            )
            for name, df in lists.items()
        ],
    )
    good = table(spark, d, "labels").where(F.col("quality") == 1).select("doc_id")
    relevant = table(spark, d, "documents").select("doc_id", "lang").join(good, "doc_id").select(
        F.col("lang").alias("query_id"), F.col("doc_id").alias("item_id")
    )
    return evaluation.compare_rankers(ranked, relevant)


# --- pages -------------------------------------------------------------------------


@query
def page_clean(spark, d):
    body = F.col("html")
    clean = wide_table(spark, d, "pages").select(
        "page_id", html.page_title(body).alias("title"), html.main_text(body).alias("text"),
        html.needs_render(body).alias("needs_render"),
    )
    return clean.select(
        "page_id", "title", "needs_render", ids.char_count(F.col("text")).alias("char_count"),
        md5_of(F.col("text")).alias("text_md5"),
    )


@query
def page_markup(spark, d):
    """Text and link targets of pages with nested blocks, signs in attributes and named references."""
    body = F.col("html")
    parts = inputs.reworked_pages(spark, d).select("page_id", html.main_text(body).alias("text"), html.hrefs(body).alias("links"))
    return parts.select(
        "page_id", ids.char_count(F.col("text")).alias("char_count"), md5_of(F.col("text")).alias("text_md5"),
        big(F.size("links")).alias("n_links"), md5_of(F.array_join("links", "\n")).alias("links_md5"),
    )


@query
def page_links(spark, d):
    return frontier.page_links(wide_table(spark, d, "pages"))


@query
def link_frontier(spark, d):
    pages = inputs.source_pages(spark, d)
    sources = pages.select(
        "source",
        F.col("source").alias("host"),
        F.array(
            F.concat(F.lit("http://"), "source", F.lit("/")),
            F.concat(F.lit("https://"), "source", F.lit("/")),
        ).alias("allow_prefixes"),
        F.array(F.lit("?"), F.lit("#")).alias("deny_substrings"),
    ).distinct()
    edges = frontier.admitted_links(frontier.page_links(wide_table(spark, d, "pages")), sources)
    visited = frontier.walk(pages.select("source", "url"), edges)
    return visited.withColumn("depth", big("depth"))


def _landing(spark, d):
    return landing.bronze_rows(inputs.source_pages(spark, d), at(inputs.NOW_TIME))


@query
def bronze_landing(spark, d):
    rows = _landing(spark, d)
    extra = documents.merge_attributes(
        F.create_map(F.lit("fetch_method"), F.lit("unknown"), F.lit("extractor"), F.lit("blocks")),
        F.col("extra"),
    )
    return rows.select(
        "doc_id",
        "source",
        "source_url",
        "title",
        "content_hash",
        "raw_object_key",
        "text_object_key",
        "byte_size",
        "char_count",
        extra["fetch_method"].alias("fetch_method"),
        extra["extractor"].alias("extractor"),
    )


@query
def bronze_inventory(spark, d):
    return stats.inventory(_landing(spark, d))


@query
def raw_bodies(spark, d):
    """Landed page bodies read back as text, bytes that are no UTF-8 among them."""
    texts = bronze.raw_texts(spark, inputs.garbled_bodies(spark, d))
    return texts.select(
        "raw_object_key", "source", "date", big("byte_size").alias("byte_size"), ids.char_count(F.col("text")).alias("char_count"),
        md5_of(F.col("text")).alias("text_md5"),
    )


@query
def broken_records(spark, d):
    """Landed lines and indented objects: good ones, and those in quarantine after two runs."""
    root = inputs.mixed_records(spark, d)
    counted = []
    for form, indented in (("line", False), ("object", True)):
        landed, path = f"{root}/{form}s-text", f"{root}/{form}s-quarantine-{uuid.uuid4().hex}"
        for epoch in (inputs.BASE_TIME, inputs.NOW_TIME):
            good = bronze.quarantine(spark, landed, path, at(epoch), indented, "*.txt")
        kept = good.select(F.lit("good").alias("state"), ids.char_count(F.col("text")).alias("n"))
        bad = bronze.read_quarantine(spark, path).select("state", F.char_length("record").cast("bigint").alias("n"))
        counted.append(kept.unionByName(bad).withColumn("form", F.lit(form)))
    every = counted[0].unionByName(counted[1])
    # lengths of records depend on how JSON is written, so they are counted for good ones only
    return every.groupBy("form", "state").agg(
        F.count("*").alias("n_records"), F.sum(F.when(F.col("state") == "good", F.col("n"))).alias("text_chars")
    )


# --- jobs: stored tables after whole runs ---------------------------------------------


@query
def committed_table(spark, d):
    """The silver table after both commits, as stored."""
    silver = store.read_table(spark, inputs.committed_documents(spark, d), "silver")
    return silver.select("doc_id", "source", "content_hash", "char_count", "ingest_date")


@query
def silver_job(spark, d):
    """Pages landed as bronze objects and documents, then upserted into silver."""
    silver = store.read_table(spark, f"{inputs.landed_silver(spark, d)}/silver", "silver")
    return silver.select("doc_id", "source", "source_url", "title", "content_hash", "byte_size", "char_count")


@query
def gold_job(spark, d):
    """Silver documents cut into gold chunks."""
    gold = store.read_table(spark, f"{inputs.landed_silver(spark, d)}/gold", "gold")
    return gold.select(
        "chunk_id", "doc_id", "doc_id_prefix", "source", big("chunk_index").alias("chunk_index"),
        big("char_count").alias("char_count"), big("start_char").alias("start_char"), big("end_char").alias("end_char"),
        md5_of(F.col("text")).alias("text_md5"),
    )


@query
def embedding_job(spark, d):
    """Gold embedded under one model version, again later, and under a second one."""
    lake = inputs.landed_silver(spark, d)

    def write(path):
        for epoch, version in ((inputs.BASE_TIME, "v1"), (inputs.NOW_TIME, "v1"), (inputs.NOW_TIME, "v2")):
            jobs.embed_gold(spark, f"{lake}/gold", path, at(epoch), model_ver=version)

    stored = store.read_table(spark, inputs.written_once(spark, d, "embedded", write), "embeddings")
    return stored.select(
        "chunk_id", "embedding_model_ver", big("char_count").alias("char_count"),
        F.unix_seconds("created_at").alias("created_epoch"), F.unix_seconds("updated_at").alias("updated_epoch"),
    )


@query
def change_propagation(spark, d):
    """Chunks in gold or embedded after documents came, changed, shrank and vanished."""
    lake = inputs.changed_lake(spark, d)
    gold = store.read_table(spark, f"{lake}/gold", "gold").select(
        "chunk_id", big("char_count").alias("char_count"), md5_of(F.col("text")).alias("text_md5")
    )
    version, when = F.col("embedding_model_ver"), [F.unix_seconds(c).alias(c) for c in ("created_at", "updated_at")]
    stored = store.read_table(spark, f"{lake}/embeddings", "embeddings")
    of_version = [
        stored.where(version == v).select("chunk_id", *[c.alias(f"{v}_{n}") for c, n in zip(when, ("created", "updated"), strict=True)])
        for v in ("v1", "v2")
    ]
    return gold.join(of_version[0], "chunk_id", "full").join(of_version[1], "chunk_id", "full")


# --- request metrics -----------------------------------------------------------------


@query
def request_counts(spark, d):
    return metrics.request_counts(table(spark, d, "events"), "event_type")


@query
def request_histogram(spark, d):
    events = table(spark, d, "events")
    return metrics.histogram_long(
        events, F.col("value"), config.RESULT_COUNT_BUCKETS, "event_type"
    )


def _window_columns(df):
    return df.select(
        F.unix_seconds("window_start").alias("window_epoch"),
        *[c for c in df.columns if c not in ("window_start", "window_end")],
    )


@query
def windowed_metrics(spark, d):
    events = table(spark, d, "events").withColumn("ts", inputs.utc_timestamp(F.col("ts")))
    rolled = metrics.windowed_histogram(
        events, "ts", F.col("value"), config.GENERATION_BUCKETS, "1 day", "event_type"
    )
    return _window_columns(rolled)


@query
def streaming_metrics(spark, d):
    return _window_columns(request_metrics.run_available(spark, d))


# --- history ---------------------------------------------------------------------------


def _history(spark, d):
    base, batch = inputs.base_documents(spark, d), inputs.recrawled_documents(spark, d)
    written = upsert.rows_to_write(base, batch, ["doc_id"], "content_hash")
    return history.record_changes(history.start_history(base, 1), written, ["doc_id"], 2)


@query
def version_as_of(spark, d):
    states = _history(spark, d)
    both = [history.as_of(states, v).withColumn("version", big(F.lit(v))) for v in (1, 2)]
    return reduce(DataFrame.unionByName, both).select("version", "doc_id", "content_hash", "batch")


def _versions(spark, d):
    return store.committed_versions(spark, inputs.committed_documents(spark, d))


@query
def version_list(spark, d):
    return history.recent_versions(_versions(spark, d), 5).select(
        big("version").alias("version"),
        F.unix_seconds("committed_at").alias("committed_epoch"),
        "operation",
        "n_rows",
        "tag",
    )


@query
def rows_then_and_now(spark, d):
    report = history.oldest_and_newest(_versions(spark, d))
    return report.select(
        big("oldest").alias("oldest"), big("newest").alias("newest"), "rows_then", "rows_now"
    )


@query
def schema_union(spark, d):
    docs = table(spark, d, "documents")
    old = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "source")
    new = table(spark, d, "benchmark").select(
        F.concat(F.lit("bench-"), F.col("item_id").cast("string")).alias("doc_id"),
        F.lit("benchmark").alias("source"),
        F.lit("xx").alias("language"),
    )
    return history.union_versions(old, new)


@query
def incremental_upsert(spark, d):
    return incremental.upsert_available(spark, d)
