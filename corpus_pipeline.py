"""The corpus pipeline: whole documents in, packed training sequences out.

Each stage reads what its predecessor kept and returns documents with the columns they
came with; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import decontam, langid, neardup, packing, secretscan
from tessera.llm.textops import default_vocabulary, scratch_path
from tessera.sources.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those too far from the profile of every language."""
    labelled = docs.select("doc_id", "text", "lang").where(~langid.held_out(F.col("doc_id")))
    profiles = langid.learn(labelled)
    return langid.recognised(docs, profiles, langid.least_scores(labelled, profiles))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group, and one row of repeated ids."""
    kept = neardup.near_duplicates(docs, size=5, threshold=0.8).where("kept")
    unnamed = docs.where("doc_id is null")
    named = docs.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    one = named.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("_nth = 1")
    return unnamed.unionByName(one.select(*docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain an item of the benchmark."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces owner-specific credentials in the texts; no document goes."""
    return secretscan.redacted(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences of at most 2048 tokens."""
    return packing.pack(docs, default_vocabulary(), size=2048, end_id=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
