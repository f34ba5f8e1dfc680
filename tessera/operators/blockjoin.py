"""Score many rows against many queries: both sides in blocks, joined by block.

Rows are packed into blocks of bounded size where they are read, and queries likewise.
An equi-join on a key brings the blocks of both sides together, so neither passes through
the driver: Spark broadcasts the queries' blocks if they are small enough and shuffles both
sides if they are not.  Few queries meet all rows of a task where these are read.  A pair of blocks is one matrix product; a task keeps the k best of
a query over all its pairs, and group-limited windows keep k of those of all tasks.

For an exhaustive search the key is one of a number of groups: a block of the corpus is in
one of them, the queries are in all.  For cells it is the cell and its part.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import config
from tessera.operators.ranking import top_k_per_key

RANK_DIGITS = config.RANK_DIGITS
#: Bytes of the vectors of a block, and query blocks whose best rows a task holds at once.
BLOCK_BYTES, HELD = 1 << 20, 64
#: Bytes of queries' vectors that are broadcast at most.
BROADCAST_BYTES = 1 << 25


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """``rows x dim`` doubles of a list column whose rows all have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def valid_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are vectors of that dimension without NULL or NaN, and the matrix of those."""
    ok = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim
    m = as_matrix(column if ok.all() else column.filter(pa.array(ok))).reshape(-1, dim)
    sound = ~np.isnan(m).any(axis=1)
    rows = np.flatnonzero(ok)
    return (rows, m) if sound.all() else (rows[sound], m[sound])


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; a zero row stays zero, so its similarity to any other is 0."""
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1.0, norm)


def _take(ids: pa.Array, rows: np.ndarray) -> pa.Array:
    return ids.take(pa.array(rows))


def packed(df: DataFrame, id_col: str, vector_col: str, dim: int, keys: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """Blocks (keys, number, ids, vectors) of at most ``most`` rows of one key; no shuffle.

    Keys are whole numbers.  Vectors travel as they are, floats as floats and others as doubles, and are scaled to
    length 1 where they are compared (:func:`_directions`); rows without a valid vector are left out.  ``df`` should be sorted by ``keys`` within its partitions.  ``number`` tells
    blocks apart, whatever task packed them.
    """
    most = min(most or 1 << 20, max(1, BLOCK_BYTES // (8 * dim)))
    kinds = [T.StructField(c, T.LongType()) for c in keys]
    kind = np.float32 if isinstance(df.schema[vector_col].dataType.elementType, T.FloatType) else np.float64
    ids = T.StructField("ids", T.ArrayType(df.schema[id_col].dataType))
    whole = T.StructType([*kinds, T.StructField("number", T.LongType()), ids, T.StructField("vectors", T.BinaryType())])

    def block(key: tuple, number: int, own: list, parts: list) -> pa.RecordBatch:
        flat = pa.concat_arrays(own)
        listed = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
        columns = [pa.array([k]) for k in key]
        columns += [pa.array([number]), listed, pa.array([np.concatenate(parts).tobytes()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=whole.fieldNames())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own, parts, held = None, [], [], 0
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows, m = valid_rows(batch.column(len(keys) + 1), dim)
            if not len(rows):
                continue
            m, found = m.astype(kind), _take(batch.column(len(keys)), rows)
            if keys:
                marks = np.stack([batch.column(i).to_numpy(zero_copy_only=False)[rows] for i in range(len(keys))])
                edges = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1
            else:
                marks, edges = np.empty((0, len(rows))), np.empty(0, np.int64)
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True):
                now = tuple(marks[:, a].tolist())
                while a < b:
                    if held and (now != key or held == most):
                        yield block(key, number, own, parts)
                        own, parts, held, number = [], [], 0, number + 1
                    key, some = now, min(b - a, most - held)
                    own.append(found.slice(a, some))
                    parts.append(m[a : a + some])
                    held, a = held + some, a + some
        if held:
            yield block(key, number, own, parts)

    return df.select(*[F.col(c).cast("long").alias(c) for c in keys], id_col, vector_col).mapInArrow(pack, whole)


def _directions(value: pa.Scalar, n: int, dim: int) -> np.ndarray:
    """The ``n`` vectors of a block, scaled to length 1."""
    data = value.as_buffer()
    kind = np.float32 if data.size == 4 * n * dim else np.float64
    return unit_rows(np.frombuffer(data, kind).reshape(n, dim).astype(np.float64))


def _order(ids: pa.Array) -> np.ndarray:
    rank = np.empty(len(ids), np.int64)
    rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return rank


class BestRows:
    """The k rows of least (key, id) for each query of a block so far; rows with an infinite key are none."""

    def __init__(self, queries: pa.Array, k: int) -> None:
        self.queries, self.k = queries, k
        self.key, self.query, self.ids = np.zeros(0), np.zeros(0, np.int64), None

    def add(self, keys: np.ndarray, ids: pa.Array) -> None:
        """``keys``: queries x rows."""
        rounded = np.round(keys, RANK_DIGITS)
        if len(ids) > self.k:
            kth = np.partition(rounded, self.k - 1, axis=1)[:, self.k - 1]
            query, row = np.nonzero((rounded <= kth[:, None]) & (rounded < np.inf))
        else:
            query, row = np.nonzero(rounded < np.inf)
        taken = _take(ids, row)
        key, query = np.r_[self.key, keys[query, row]], np.r_[self.query, query]
        merged = taken if self.ids is None else pa.concat_arrays([self.ids, taken])
        order = np.lexsort((_order(merged), np.round(key, RANK_DIGITS), query))
        q = query[order]
        first = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], np.arange(len(q)), 0))
        keep = order[np.arange(len(q)) - first < self.k]
        self.key, self.query, self.ids = key[keep], query[keep], _take(merged, keep)

    def result(self, names: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_take(self.queries, self.query), self.ids, pa.array(self.key)], names=names)


def best_of_pairs(
    pairs: DataFrame, id_field: T.StructField, query_field: T.StructField, dim: int, k: int, key_col: str, salts: int = 1
) -> DataFrame:
    """``(query, id, key, rank)`` of the k nearest rows for each query, by cosine distance.

    ``pairs`` has asked (number, ids, vectors of a block of queries) and ids and vectors of
    a block of rows.
    """
    names = [query_field.name, id_field.name, key_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, BestRows] = OrderedDict()
        for batch in batches:
            for i in range(batch.num_rows):
                number, asked, q, ids, v = (batch.column(j)[i] for j in range(5))
                if number.as_py() not in held:
                    if len(held) == HELD:
                        yield held.popitem(last=False)[1].result(names)
                    held[number.as_py()] = BestRows(asked.values, k)
                held.move_to_end(number.as_py())
                left, right = _directions(q, len(asked.values), dim), _directions(v, len(ids.values), dim)
                held[number.as_py()].add(1.0 - left @ right.T, ids.values)
        for best in held.values():
            yield best.result(names)

    schema = T.StructType([query_field, id_field, T.StructField(key_col, T.DoubleType())])
    partial = pairs.select("asked_number", "asked_ids", "asked_vectors", "ids", "vectors").mapInArrow(score, schema)
    return _ranked(partial, names, k, salts)


def _ranked(partial: DataFrame, names: list[str], k: int, salts: int) -> DataFrame:
    query_col, id_col, key_col = names
    return top_k_per_key(partial, [query_col], [F.round(key_col, RANK_DIGITS), F.col(id_col)], k, "rank", salts)


def best_where_read(corpus: DataFrame, asked: DataFrame, query_field: T.StructField, dim: int, k: int, key_col: str, salts: int = 1) -> DataFrame:
    """What :func:`best_of_pairs` gives, for few queries: each task gets their blocks with its first row, once.

    ``corpus`` has id and vector, ``asked`` the blocks of queries, which are broadcast.
    """
    id_field, vector_field = corpus.schema.fields
    names, most = [query_field.name, id_field.name, key_col], max(1, BLOCK_BYTES // (8 * dim))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within its task
    rows = corpus.withColumn("_first", place == 0)
    met = rows.join(F.broadcast(asked.select("asked_ids", "asked_vectors")), F.col("_first"), "left")  # the first row comes with each block

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple[pa.Array, np.ndarray]] = []
        held: OrderedDict[int, BestRows] = OrderedDict()
        for batch in batches:
            copies = pc.sum(batch.column(2)).as_py() or 0  # of the first row, all before the second
            for i in range(copies):
                queries = batch.column(3)[i]
                if queries.is_valid:
                    blocks.append((queries.values, _directions(batch.column(4)[i], len(queries.values), dim)))
                    yield from meet(held, blocks, len(blocks) - 1, batch.slice(i, 1))
            yield from meet(held, blocks, 0, batch.slice(copies))
        for best in held.values():
            if best.ids is not None:
                yield best.result(names)

    def meet(held: OrderedDict, blocks: list, start: int, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found, m = valid_rows(rows.column(1), dim)
        if not len(found):
            return
        m, ids = unit_rows(m), _take(rows.column(0), found)
        for number in range(start, len(blocks)):
            queries, left = blocks[number]
            if number not in held:
                if len(held) == HELD:
                    yield held.popitem(last=False)[1].result(names)
                held[number] = BestRows(queries, k)
            held.move_to_end(number)
            for a in range(0, len(m), most):
                held[number].add(1.0 - left @ m[a : a + most].T, ids.slice(a, most))

    schema = T.StructType([query_field, id_field, T.StructField(key_col, T.DoubleType())])
    partial = met.select(id_field.name, vector_field.name, "_first", "asked_ids", "asked_vectors").mapInArrow(search, schema)
    return _ranked(partial, names, k, salts)


def _asked(blocks: DataFrame, *keys: str) -> DataFrame:
    return blocks.select(*keys, *[F.col(c).alias(f"asked_{c}") for c in ("number", "ids", "vectors")])


def nearest_rows(
    corpus: DataFrame, queries: DataFrame, k: int, *, dim: int, id_col: str, query_col: str, vector_col: str,
    key_col: str = "distance", max_queries: int = config.QUERY_BLOCK_ROWS, salts: int = 1, groups: int | None = None,
) -> DataFrame:
    """Exact search: every block of queries meets every block of the corpus once.

    Queries whose vectors have :data:`BROADCAST_BYTES` together at most (counted) go to where the corpus is read, once
    for each task.  Otherwise ``groups`` is the number of keys, by default that of the shuffle's partitions.
    """
    if groups is None and queries.count() * dim * 8 <= BROADCAST_BYTES:
        asked = _asked(packed(queries, query_col, vector_col, dim, most=max_queries))
        return best_where_read(corpus.select(id_col, vector_col), asked, queries.schema[query_col], dim, k, key_col, salts)
    groups = groups or int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = packed(corpus, id_col, vector_col, dim).withColumn("group", F.pmod(F.xxhash64("number"), F.lit(groups)))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    asked = _asked(packed(queries, query_col, vector_col, dim, most=max_queries)).withColumn("group", every)
    pairs = rows.join(asked, "group")
    return best_of_pairs(pairs, corpus.schema[id_col], queries.schema[query_col], dim, k, key_col, salts)


def nearest_in_cells(
    corpus: DataFrame, queries: DataFrame, k: int, *, dim: int, id_col: str, query_col: str, vector_col: str,
    keys: Sequence[str], key_col: str = "distance", max_queries: int = config.QUERY_BLOCK_ROWS,
) -> DataFrame:
    """Search where rows and queries have common ``keys`` (numbers) only; a query may have many rows.

    Queries are brought together by key, so a key's blocks meet the blocks of that key.
    """
    rows = packed(corpus.sortWithinPartitions(*keys), id_col, vector_col, dim, keys)  # a block has one key
    dealt = queries.repartition(*keys).sortWithinPartitions(*keys)
    asked = _asked(packed(dealt, query_col, vector_col, dim, keys, max_queries), *keys)
    pairs = rows.join(asked, list(keys))
    return best_of_pairs(pairs, corpus.schema[id_col], queries.schema[query_col], dim, k, key_col)
