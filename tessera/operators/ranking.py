"""Newest-per-key, top-k per query and rank columns.

All of them are ``row_number() <= k`` windows.  Spark turns these into a partial
group limit before the shuffle, so a hot key sends at most k rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    k: int,
    rank_col: str = "rank",
    salts: int = 1,
) -> DataFrame:
    """First ``k`` rows per key in ``order``, with their 1-based rank.

    ``salts`` > 1 adds a level that first keeps k rows per (key, salt), for inputs
    with so many map tasks that even k rows per task add up in one reducer.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if salts > 1:
        salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        w = Window.partitionBy(*keys, "_salt").orderBy(*order)
        df = salted.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn", "_salt")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= k)


def newest_per_key(
    df: DataFrame, keys: Sequence[str], newest: str, tie_break: Sequence[Column] = ()
) -> DataFrame:
    """The newest row of each key; NULL times are oldest, ties go by ``tie_break``."""
    order = [F.col(newest).desc_nulls_last(), *tie_break]
    return top_k_per_key(df, keys, order, 1, "_rn").drop("_rn")


def cap_per_source(df: DataFrame, source: str, order: Sequence[Column], cap: int) -> DataFrame:
    """Visit cap: the first ``cap`` rows of each source in ``order``."""
    return top_k_per_key(df, [source], order, cap, "_visit").drop("_visit")
