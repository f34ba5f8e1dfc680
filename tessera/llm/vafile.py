"""Exact top-k search by inner product with vector-approximation files.

Vectors become integers (floor of 64 times each component) and are dealt by id to groups
of about bounded size.  Each group is a vector-approximation file (or a few): every dimension is cut into at
most :data:`CELLS` cells, a vector's approximation is its cell in each dimension, and the
exact vectors lie beside.  A query scans the cells of a group for a lower and an upper
bound of every score (an upper bound of the score is a lower bound of the distance), drops
what cannot reach the k-th best lower bound, and reads exact vectors in the order of their
bounds until the next bound is below the k-th exact score found.  So every result is exact.

Queries travel in blocks of bounded size, one copy to each group; a task holds one group and
one block of queries.  Each group sends its k best for a query, and a window keeps k of those.

Defined results: vectors that are null or empty, or hold a null or a component that is not
finite, and rows without an id take no part, neither as query nor as candidate; rows of one
id are one vector (the least one, compared by component); vectors of another length than
the query's are no candidates; ties go to the smaller id; with fewer candidates than k all
are returned, without any the query has no rows; an empty table gives no rows; a score that
does not fit in 64 bits is an error; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textops import stored
from tessera.operators.ranking import top_k_per_key

SCALE = 64
#: Cells of a dimension, vectors of a group and queries of a block at most.
CELLS, GROUP_ROWS, BLOCK_QUERIES = 32, 1 << 16, 512
#: Vectors of a group at least, and exact vectors read at once.
LEAST_ROWS, READ = 1024, 64

_INDEX = "dim int, part int, ids binary, marks binary, cells binary, vectors binary"


def whole_numbers(vector: Column) -> Column:
    """floor(64 x) of each component x taken as a double; null for vectors that take no part."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    sound = (F.size(wide) > 0) & F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(sound, F.transform(wide, lambda x: F.floor(x * SCALE).cast("long")))


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and its whole numbers, one row for each id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole_numbers(F.col(vector_col)).alias("v"))
    return rows.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"))


# --------------------------------------------------------------------------- one file


def approximation(v: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Marks (dimension x 2 x cells: least and greatest value) and each vector's cells.

    Cells hold about as many vectors each; equal values share a cell.
    """
    n, dim = v.shape
    marks = np.zeros((dim, 2, cells), np.int64)
    code = np.empty((n, dim), np.uint8)
    for j in range(dim):
        values, count = np.unique(v[:, j], return_counts=True)
        cell = (np.cumsum(count) - count) * cells // n  # of each distinct value, by those before it
        own = cell[np.searchsorted(values, v[:, j])]
        code[:, j] = own
        present, first = np.unique(cell, return_index=True)
        marks[j, 0, present] = values[first]
        marks[j, 1, present] = values[np.append(first[1:], len(values)) - 1]
    return marks, code


def bounds(queries: np.ndarray, marks: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score each approximated vector can have, queries x vectors.

    Sums of halves of whole numbers below 2**52 are exact as doubles.
    """
    dim = np.arange(marks.shape[0])
    low, high = marks[dim, 0, code].astype(np.float64), marks[dim, 1, code].astype(np.float64)
    middle = queries.astype(np.float64) @ ((low + high) / 2).T
    spread = np.abs(queries).astype(np.float64) @ ((high - low) / 2).T
    return middle - spread, middle + spread


def fits(queries: np.ndarray, v: np.ndarray) -> bool:
    """Whether all scores and bounds are below 2**52, by the largest components."""
    most = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (queries, v)]
    return most[0] * most[1] * queries.shape[1] < 2**52


def exact_scores(query: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products without rounding: doubles hold whole numbers that :func:`fits` found small."""
    if v.dtype == np.float64:
        return (v @ query).astype(np.int64)
    own = [sum(a * b for a, b in zip(query.tolist(), row, strict=True)) for row in v.tolist()]
    return np.array(own, dtype=np.int64)  # raises if one does not fit


def nearest(query: np.ndarray, lower: np.ndarray, upper: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best (id, score), ties by id, and how many exact vectors were read.

    Vectors with bounds of minus infinity are none of the candidates, which are k at least.
    """
    n = len(ids)
    floor = np.partition(lower, n - k)[n - k] if n > k else -np.inf
    near = np.flatnonzero(upper >= floor)
    near = near[np.argsort(-upper[near], kind="stable")]
    best_ids, best = np.empty(0, np.int64), np.empty(0, np.int64)
    at = 0
    while at < len(near) and (len(best) < k or upper[near[at]] >= best[-1]):
        some = near[at : at + max(k, READ)]
        best_ids, best = np.append(best_ids, ids[some]), np.append(best, exact_scores(query, v[some]))
        order = np.lexsort((best_ids, -best))[:k]
        best_ids, best = best_ids[order], best[order]
        at += len(some)
    return best_ids, best, at


# --------------------------------------------------------------------------- files of all vectors


def _pack(batches: Iterator[pa.RecordBatch], most: int, approximate: bool) -> Iterator[pa.RecordBatch]:
    """Rows (dim, part, vec_id, v), sorted, as blocks of at most ``most`` vectors of one dim and part."""

    def block(key: tuple[int, int], ids: list, flat: list):
        own, v = np.concatenate(ids), np.concatenate(flat)
        marks, code = approximation(v) if approximate else (np.empty(0, np.int64), np.empty(0, np.uint8))
        values = [[key[0]], [key[1]], *([x.tobytes()] for x in (own, marks, code, v))]
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
        names = [c.split()[0] for c in _INDEX.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, kinds, strict=True)], names=names)

    key, ids, flat, held = None, [], [], 0
    for batch in batches:
        dims, parts, own = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        values = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate(([0], np.cumsum(dims)))
        edge = np.flatnonzero(np.concatenate(([True], (dims[1:] != dims[:-1]) | (parts[1:] != parts[:-1]))))
        for a, b in zip(edge, np.append(edge[1:], len(dims)), strict=True) if len(dims) else ():
            now = (int(dims[a]), int(parts[a]))
            while a < b:
                if held and (now != key or held == most):
                    yield block(key, ids, flat)
                    ids, flat, held = [], [], 0
                key, some = now, min(b - a, most - held)
                ids.append(own[a : a + some])
                flat.append(values[starts[a] : starts[a + some]].reshape(some, -1))
                held, a = held + some, a + some
    if held:
        yield block(key, ids, flat)


def parts_of(rows: int, cores: int) -> int:
    """Groups of a table: twice the cores, but of about bounded size, and no tiny ones.

    Ids are dealt by hash, so a group may have more than :data:`GROUP_ROWS` vectors: it is several files then.
    """
    size = min(GROUP_ROWS, max(LEAST_ROWS, -(-rows // (2 * max(1, cores)))))
    return max(1, -(-rows // size))


def build(vectors: DataFrame, parts: int) -> DataFrame:
    """The approximation files of :func:`usable` vectors: dim, part, ids, marks, cells, vectors."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int")
    rows = vectors.select(F.size("v").alias("dim"), part.alias("part"), "vec_id", "v")
    dealt = rows.repartition("dim", "part").sortWithinPartitions("dim", "part", "vec_id")
    return dealt.mapInArrow(lambda batches: _pack(batches, GROUP_ROWS, True), _INDEX)


def query_blocks(queries: DataFrame) -> DataFrame:
    """The same form for queries, without cells; ``part`` is no more than where they came from."""
    rows = queries.select(F.size("v").alias("dim"), F.lit(0).alias("part"), "vec_id", "v")
    return rows.mapInArrow(lambda batches: _pack(batches, BLOCK_QUERIES, False), _INDEX)


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The files of a group (several, if it has more vectors than one), followed by the blocks of queries sent to it."""
    file, held = None, []
    for batch in batches:
        for dim, part, number, ids, marks, code, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own, v = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int64).reshape(-1, dim)
            if number >= 0:
                held = held if file == (dim, part) else []
                held.append((own, np.frombuffer(marks, np.int64).reshape(dim, 2, CELLS), np.frombuffer(code, np.uint8).reshape(-1, dim), v))
                file = (dim, part)
                continue
            if file != (dim, part):
                continue  # no vector has the length of these queries here
            for one in held:
                yield from _search_block(own, v, one, k)


def _search_block(query_ids: np.ndarray, queries: np.ndarray, file: tuple, k: int) -> Iterator[pa.RecordBatch]:
    ids, marks, code, v = file
    step = max(1, (1 << 22) // max(1, len(ids)))
    for at in range(0, len(queries), step):
        some = queries[at : at + step]
        if fits(some, v):
            lower, upper = bounds(some, marks, code)
            some, read = some.astype(np.float64), v.astype(np.float64)
        else:  # bounds would be rounded: none, so all exact vectors are read
            lower, upper = np.full((2, len(some), len(ids)), np.inf) * np.array([-1, 1])[:, None, None]
            read = v
        out = []
        for i, query_id in enumerate(query_ids[at : at + step]):
            mine = np.flatnonzero(ids == query_id)
            lower[i, mine], upper[i, mine] = -np.inf, -np.inf
            others = min(k, len(ids) - len(mine))
            if not others:
                continue
            found, score, _ = nearest(some[i], lower[i], upper[i], ids, read, others)
            out.append((np.full(len(found), query_id), found, score))
        if not out:
            continue
        columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema=_FOUND)


def search(index: DataFrame, queries: DataFrame, k: int, parts: int) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` highest scores of each query.

    ``index`` is that of :func:`build` with as many ``parts``; a row of it is searched by
    every block of queries of its dimension, but not for the query's own id.
    """
    files = index.withColumn("number", F.lit(0))
    asked = query_blocks(queries).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("number", F.lit(-1))
    order = ["dim", "part", F.col("number").desc()]
    both = files.unionByName(asked).select("dim", "part", "number", "ids", "marks", "cells", "vectors")
    met = both.repartition("dim", "part").sortWithinPartitions(*order)
    found = met.mapInArrow(lambda batches: _search(batches, k), "query_id long, vec_id long, score long")
    ranked = top_k_per_key(found, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def top_k(vectors: DataFrame, asked: Column, k: int) -> DataFrame:
    """The ``k`` best of all vectors for each one whose id meets ``asked``."""
    spark = vectors.sparkSession
    own = stored(usable(vectors), "vectors")
    parts = parts_of(own.count(), spark.sparkContext.defaultParallelism)
    index = stored(build(own, parts), "approximations")
    return search(index, own.where(asked), k, parts)
