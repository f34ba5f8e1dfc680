"""Rows in a total order: gapless numbers within groups of any size, and runs of a sorted stream.

A group is never gathered: rows are sorted into ranges of the whole order, each task
numbers its own range, and the one group that goes on from earlier ranges is told how
many of its rows stand there.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.textops import stored


def _run_starts(column: pa.Array) -> np.ndarray:
    """Whether each row has another value than the row before it; the first row has."""
    codes = column.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return np.concatenate(([True], codes[1:] != codes[:-1]))


def numbered(rows: DataFrame, group: str, order: Sequence[Column], name: str = "at") -> DataFrame:
    """``rows`` with their place (from 0) within ``group``, which has no nulls, in ``order``.

    ``rows`` should be narrow and stored, as the range shuffle reads them twice (for its
    bounds, then for good).  Rows that are equal in ``order`` may change places.  What is
    broadcast is one row for each task at most.
    """
    at = rows.columns.index(group)
    whole = T.StructType([*rows.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_nth", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = _run_starts(batch.column(at))
            goes_on = batch.column(at)[0].as_py() == last
            index = np.arange(n)
            first = np.maximum.accumulate(np.where(fresh, index, 0))
            nth = index - first + np.where(first == 0, held if goes_on else 0, 0)
            last, held = batch.column(at)[n - 1].as_py(), int(nth[-1]) + 1
            extra = [pa.array(np.full(n, part, np.int32)), pa.array(nth.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=whole.fieldNames())

    ranged = rows.repartitionByRange(F.col(group).asc(), *order).sortWithinPartitions(F.col(group).asc(), *order)
    placed = stored(ranged.mapInArrow(count, whole), "numbered")
    runs = placed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.withColumn("_before", F.sum("_n").over(earlier)).where("_before > 0").drop("_n")
    found = placed.join(F.broadcast(before), [group, "_part"], "left")  # at most one row for each task
    place = F.col("_nth") + F.coalesce("_before", F.lit(0))
    return found.select(*[F.col(c) for c in rows.columns], place.alias(name))


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of a stream sorted by its first ``keys`` columns: the key and the whole rows."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row)
    if held:
        yield key, held


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield batch_of(held, schema)
            held = []
    if held:
        yield batch_of(held, schema)
