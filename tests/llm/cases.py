"""Small tables with every awkward row: nulls, empty and very long texts, ties, repeats, clashing columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} of line {i}" for i in range(30_000))

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
    (2, "the QUICK brown fox jumps over the lazy dog near the river bank today.", "en"),
    (3, None, None),
    (4, "", "en"),
    (5, " \n\t ", None),
    (6, "one two", "en"),
    (7, "Ünïcödé straße 😀 é ﬁ İstanbul don't we'll 'S 12 3.4 ***!!! <|endoftext|> x y z\x1c!", "de"),
    (8, LONG, "en"),
    (9, LONG + " and one more line", "en"),
    (10, "one two", "en"),
    (10, "one two", "en"),
    (11, "12345 --- !!! ///", None),
    (None, "a text without an id", "en"),
    (None, None, None),
    (14, "<|startoftext|>word and word<|startoftext|> x<|endoftext|>y", "en"),
    (12, "a" * 20_000, "en"),
    (13, "9" * 20_000 + " +" + "1 " * 5000, "en"),
]

CLASHING = ("score", "lang_pred", "node", "label", "part", "number", "row", "bucket", "base", "spans", "secrets", "doc", "shard", "ids", "words", "key", "n", "kept")


def documents(spark: SparkSession, rows: list | None = None) -> DataFrame:
    """The rows as documents, with further columns whose names operators use themselves."""
    docs = spark.createDataFrame(ROWS if rows is None else rows, "doc_id long, text string, lang string")
    docs = docs.withColumn("source", F.concat(F.lit("src"), (F.col("doc_id") % 3).cast("string")))
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select("*", *[F.lit(f"x-{n}").alias(n) for n in CLASHING])


def empty(spark: SparkSession) -> DataFrame:
    return documents(spark, [])
