"""Search tables: chunks with their vectors and postings, written once and read by every search.

One table holds everything about a chunk, another the postings in blocks of chunks, so a search
reads the columns it needs.  The counts of the terms stand beside.  Only those are shuffled.

Terms in order are not stored: they say what the text says, took more of the disk than it, and
no search needs those of more than a few chunks.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import tokens
from tessera.functions.vectors import hash_vector
from tessera.operators.textindex import FILTER_COLUMNS, TERMS_TEXT, TextStats, blocks_of, text_stats


#: Blocks of a row group of the postings at most: a task holds one group while it writes or reads.
GROUP_BLOCKS = 16


class SearchTables(NamedTuple):
    """``chunks``: the chunk columns with n_terms and embedding; ``postings`` and ``stats`` of them."""

    chunks: DataFrame
    postings: DataFrame
    stats: TextStats

    @property
    def index(self) -> DataFrame:
        """The terms are made of the texts by those who read them."""
        termed = self.chunks.withColumn("terms", _terms()).drop("embedding")
        return termed.withColumnRenamed("text", TERMS_TEXT)

    @property
    def vectors(self) -> DataFrame:
        return self.chunks.drop("n_terms", "text")


def _terms() -> Column:
    return tokens(F.coalesce("text", F.lit("")))


def write_search_tables(
    chunks: DataFrame, path: str, dim: int = config.EMBED_DIM, id_col: str = "chunk_id"
) -> None:
    """Embed ``chunks`` once and write them with their postings and the counts of their terms.

    Postings are inverted lists of the chunks that a task reads, so no posting is shuffled or
    sorted with those of others; a term with very many is in many blocks.
    """
    root, spark = path.rstrip("/"), chunks.sparkSession
    termed = chunks.withColumn("terms", _terms())
    whole = termed.withColumn("n_terms", F.size("terms")).withColumn("embedding", hash_vector(F.col("terms"), dim))
    whole.drop("terms").write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/chunks")
    kept = [c for c in FILTER_COLUMNS if c in chunks.columns]
    index = spark.read.parquet(f"{root}/chunks").select(id_col, *kept, _terms().alias("terms"), "n_terms")
    blocks = blocks_of(index, id_col).write.mode("overwrite").option("parquet.block.row.count.limit", GROUP_BLOCKS)
    blocks.option("compression", "zstd").parquet(f"{root}/postings")
    stats = text_stats(index, spark.read.parquet(f"{root}/postings"), id_col)
    stats.terms.write.mode("overwrite").parquet(f"{root}/terms")
    stats.totals.write.mode("overwrite").parquet(f"{root}/totals")


def read_search_tables(spark: SparkSession, path: str) -> SearchTables:
    root = path.rstrip("/")
    read = spark.read.parquet
    stats = TextStats(read(f"{root}/terms"), read(f"{root}/totals"))
    return SearchTables(read(f"{root}/chunks"), read(f"{root}/postings"), stats)
