"""A total order with gapless numbers, without bringing all rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import written

#: Bits of a row's number within its partition.
_ROW_BITS = 33


def with_positions(df: DataFrame, order: Sequence[Column], name: str = "position") -> DataFrame:
    """``df`` with its place (from 0) in ``order``.

    Rows are sorted into ranges of the order, so equal rows stand in one range; a row knows
    its range and its number in it.  The sizes of the ranges before are added up in one row
    with an entry for each range, which is all that is broadcast.  Rows that are equal in
    ``order`` may change places.  The sorted rows are written once: numbers that are told
    by two runs of a plan need not agree.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_id", F.monotonically_increasing_id()), "positions")
    part, nth = F.shiftright("_id", _ROW_BITS), F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    listed = sizes.agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("sizes"))  # one row
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<part:bigint,start:bigint>>").alias("starts"))
    added = F.aggregate(
        "sizes",
        start,
        lambda held, size: F.struct(
            (held["sum"] + size["n"]).alias("sum"),
            F.concat(held["starts"], F.array(F.struct(size["part"].alias("part"), held["sum"].alias("start")))).alias("starts"),
        ),
    )
    starts = listed.select(F.explode(added["starts"]).alias("s")).select("s.part", "s.start")
    found = placed.withColumn("part", part).join(F.broadcast(starts), "part")
    return found.withColumn(name, F.col("start") + nth).select(*df.columns, name)
