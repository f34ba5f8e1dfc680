"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    bitplanes,
    chat,
    decontam,
    fingerprints,
    langid,
    merkle,
    neardup,
    packing,
    pii,
    prefixtrie,
    quality,
    secretscan,
    vafile,
)
from tessera.llm.textops import default_vocabulary, scratch_path
from tessera.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def registered(query: Callable[[SparkSession, str], DataFrame]):
    QUERIES[query.__name__] = query
    return query


@registered
def op1_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents written as byte planes and read back."""
    folder = scratch_path(spark, "planes")
    bitplanes.write_ids(table(spark, sf_dir, "documents"), folder, default_vocabulary(), end_id=1)
    return bitplanes.read_ids(spark, folder, keep_ids=False)


@registered
def op2_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), default_vocabulary(), size=2048, end_id=0)


@registered
def op10_rank_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the two thirds that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    own = docs.withColumn("held_out", langid.held_out(F.col("doc_id")))
    profiles = langid.learn(own.where("not held_out"))
    return langid.identify(own.select("doc_id", "held_out", "text"), profiles).drop("text")


@registered
def op8_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~quality.held_out(F.col("doc_id")))
    scored = quality.score(docs, quality.learn(docs, labels))
    return scored.select(
        "doc_id",
        quality.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


@registered
def op4_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingles overlap by 80 % or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=4, threshold=0.8)


@registered
def op6_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and how alike they are."""
    return fingerprints.compared(table(spark, sf_dir, "documents"))


@registered
def op9_latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain an item of the benchmark, with the item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered
def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side."""
    return chat.render(table(spark, sf_dir, "conversations"))


@registered
def op7_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, counted by the sources that have them."""
    return secretscan.digest(secretscan.scan(table(spark, sf_dir, "documents")))


@registered
def op3_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: base spans and scored candidates."""
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


@registered
def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and folded proof of every document, some of them tampered with."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


@registered
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all rebuilt conversations."""
    return prefixtrie.trie(table(spark, sf_dir, "conversations"))


@registered
def op13_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products with every 20th vector."""
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
