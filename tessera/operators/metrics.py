"""Request counters and cumulative histograms from a request log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def request_counts(log: DataFrame, *labels: str) -> DataFrame:
    return log.groupBy(*labels).agg(F.count("*").alias("n_requests"))


def bucket_counts(value: Column, buckets: Sequence[float]) -> list[Column]:
    """One cumulative counter per upper bound."""
    return [
        F.sum((value <= bound).cast("bigint")).alias(f"le_{i}") for i, bound in enumerate(buckets)
    ]


def histogram(log: DataFrame, value: Column, buckets: Sequence[float], *groups: Column | str) -> DataFrame:
    """Wide form: cumulative buckets ``le_0`` .., ``le_inf``, count and sum per group."""
    return log.groupBy(*groups).agg(
        *bucket_counts(value, buckets),
        F.count(value).alias("le_inf"),
        F.round(F.sum(value), 4).alias("value_sum"),
    )


def histogram_long(
    log: DataFrame, value: Column, buckets: Sequence[float], *labels: str
) -> DataFrame:
    """Long form: one row per group and upper bound, ``+Inf`` last."""
    wide = histogram(log, value, buckets, *labels)
    rows = [
        F.struct(F.lit(str(float(bound))).alias("le"), F.col(f"le_{i}").alias("n"))
        for i, bound in enumerate(buckets)
    ]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("n")))
    return wide.select(*labels, "value_sum", F.inline(F.array(*rows)))


def windowed_histogram(
    log: DataFrame,
    ts_col: str,
    value: Column,
    buckets: Sequence[float],
    window: str,
    *labels: str,
    watermark: str | None = None,
) -> DataFrame:
    """Histogram per tumbling window and label set; works on a stream as well.

    ``ts_col`` must be a TIMESTAMP; a stream needs a ``watermark``.
    """
    if watermark is not None:
        log = log.withWatermark(ts_col, watermark)
    grouped = histogram(log, value, buckets, F.window(ts_col, window).alias("w"), *labels)
    rest = [c for c in grouped.columns if c != "w"]
    return grouped.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *rest)
