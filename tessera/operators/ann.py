"""Approximate nearest neighbours: k-means cells with a tuned number of probes.

Vectors are assigned to the nearest of a bounded set of cell centres (map-only,
the centres travel with the task) and can be stored partitioned by cell.  A query
becomes one row for each of the ``n_probe`` cells nearest to it, and an equi-join on
the cell brings it to their vectors; cells no query asks for find no partner, and in a
stored index their folders are not read.  A cell of more than ``cell_rows`` vectors is
split again into parts by id, which queries meet one by one, so no task has all of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import config
from tessera.functions.vectors import is_valid_vector
from tessera.operators.blockjoin import RANK_DIGITS, as_matrix, nearest_in_cells, unit_rows, valid_rows
from tessera.operators.dense import dense_search


def unit_vectors(df: DataFrame, vector_col: str, dim: int) -> DataFrame:
    """Valid rows with their vector scaled to length 1 (a zero vector stays zero)."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def normalise(vectors: pa.Array) -> pa.Array:
        m = as_matrix(vectors)
        norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
        m = m / np.where(norm == 0, 1.0, norm)
        offsets = pa.array(np.arange(len(vectors) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(m.reshape(-1)))

    valid = df.where(is_valid_vector(F.col(vector_col), dim))
    return valid.withColumn(vector_col, normalise(F.col(vector_col)))


def train_cells(
    corpus: DataFrame,
    vector_col: str,
    dim: int,
    n_cells: int,
    seed: int = 42,
    max_iter: int = 10,
    train_fraction: float = 1.0,
) -> np.ndarray:
    """Cell centres (``n_cells x dim``) from distributed k-means on unit vectors.

    The fraction only thins out the rows the centres are fitted to; every row is
    assigned to a cell afterwards.
    """
    if n_cells > config.MAX_CELLS:
        raise ValueError(f"at most {config.MAX_CELLS} cells")
    unit = unit_vectors(corpus, vector_col, dim).select(array_to_vector(vector_col).alias("features"))
    if train_fraction < 1.0:
        unit = unit.sample(train_fraction, seed=seed)
    model = KMeans(k=n_cells, seed=seed, maxIter=max_iter, initSteps=2).fit(unit)
    return unit_rows(np.array(model.clusterCenters()))


def cell_similarity(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return np.round(unit_rows(vectors) @ centers.T, RANK_DIGITS)


def cell_order(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Cells of each vector, most similar first, ties by cell number."""
    return np.argsort(-cell_similarity(vectors, centers), axis=1, kind="stable")


def assign_cells(corpus: DataFrame, vector_col: str, dim: int, centers: np.ndarray) -> DataFrame:
    """Valid rows with the number of their nearest cell; map-only."""

    @F.arrow_udf(T.IntegerType())
    def nearest(vectors: pa.Array) -> pa.Array:
        if not len(vectors):
            return pa.array([], pa.int32())
        return pa.array(cell_similarity(as_matrix(vectors), centers).argmax(axis=1).astype(np.int32))

    valid = corpus.where(is_valid_vector(F.col(vector_col), dim))
    return valid.withColumn("cell", nearest(F.col(vector_col)))


def write_index(indexed: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store vectors partitioned by cell.

    The rebalance brings a cell together and splits a hot one over several files.
    """
    indexed.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").option("compression", "zstd").parquet(path)


def probed_cells(queries: DataFrame, query_col: str, vector_col: str, centers: np.ndarray, n_probe: int) -> DataFrame:
    """Each valid query once for each cell it looks into: query, vector, cell; map-only."""
    kind = queries.schema[vector_col].dataType.simpleString()
    query = queries.schema[query_col].dataType.simpleString()
    n = min(n_probe, len(centers))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, m = valid_rows(batch.column(1), centers.shape[1])
            cells = cell_order(m, centers)[:, :n].reshape(-1).astype(np.int32)
            own = batch.take(pa.array(np.repeat(rows, n)))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cells)], names=[query_col, vector_col, "cell"])

    return queries.select(query_col, vector_col).mapInArrow(probe, f"{query_col} {query}, {vector_col} {kind}, cell int")


def ann_search(
    indexed: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    centers: np.ndarray,
    n_probe: int,
    dim: int,
    id_col: str = "chunk_id",
    query_col: str = "query_id",
    vector_col: str = "embedding",
    stored: bool = True,
    max_queries: int = config.QUERY_BLOCK_ROWS,
    cell_rows: int = config.CELL_ROWS,
) -> DataFrame:
    """``(query, id, distance, rank)`` among the rows of the probed cells.

    Of a ``stored`` index only the folders of cells that some query probes are read; for
    cells computed in the same plan the counts of cells would have them computed twice,
    so no cell is split.
    """
    if centers.shape[1] != dim:
        raise ValueError(f"the cells have {centers.shape[1]} dimensions, not {dim}")
    asked = probed_cells(queries, query_col, vector_col, centers, n_probe)
    rows = indexed.select(id_col, F.col("cell").cast("int").alias("cell"), vector_col)
    part = F.lit(0)
    if stored:
        used = [r["cell"] for r in asked.select("cell").distinct().collect()]  # bounded by the cells
        rows = rows.where(F.col("cell").isin(used))
        parts = rows.groupBy("cell").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts"))
        parts = F.broadcast(parts)  # bounded by the cells
        rows, asked = rows.join(parts, "cell"), asked.join(parts, "cell")
        part = F.pmod(F.xxhash64(id_col), F.col("parts")).cast("int")
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    else:
        asked = asked.withColumn("part", part)
    return nearest_in_cells(
        rows.withColumn("part", part).select(id_col, "cell", "part", vector_col), asked, k, dim=dim, id_col=id_col,
        query_col=query_col, vector_col=vector_col, keys=["cell", "part"], max_queries=max_queries,
    )


def tune_probes(
    spark: SparkSession,
    indexed: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    centers: np.ndarray,
    dim: int,
    target: float = config.TARGET_RECALL,
    id_col: str = "chunk_id",
    query_col: str = "query_id",
    vector_col: str = "embedding",
) -> int:
    """Smallest number of probes whose recall@k over ``queries`` reaches ``target``.

    Needs one exact search: a true neighbour is found with n probes exactly if its
    cell is among the n cells nearest to the query.
    """
    exact = dense_search(
        indexed, queries, k, dim=dim, id_col=id_col, query_col=query_col, vector_col=vector_col
    )
    truth = exact.join(indexed.select(id_col, "cell"), id_col).select(query_col, "cell")

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = cell_order(as_matrix(batch.column(vector_col)), centers)
            position = np.empty_like(order)
            np.put_along_axis(position, order, np.arange(order.shape[1])[None, :], axis=1)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(query_col).take(pa.array(np.repeat(np.arange(n), len(centers)))),
                    pa.array(np.tile(np.arange(len(centers), dtype=np.int32), n)),
                    pa.array((position + 1).reshape(-1).astype(np.int32)),
                ],
                names=[query_col, "cell", "cell_rank"],
            )

    kind = queries.schema[query_col].dataType.simpleString()
    positions = queries.select(query_col, vector_col).mapInArrow(
        ranks, f"{query_col} {kind}, cell int, cell_rank int"
    )
    found = truth.join(positions, [query_col, "cell"]).groupBy("cell_rank").count()
    by_rank = {r["cell_rank"]: r["count"] for r in found.collect()}  # at most n_cells rows
    total = sum(by_rank.values())
    seen = 0
    for rank in range(1, len(centers) + 1):
        seen += by_rank.get(rank, 0)
        if total and seen / total >= target:
            return rank
    return len(centers)


def recall_report(approximate: DataFrame, exact: DataFrame, query_col: str, id_col: str) -> DataFrame:
    """``(n_queries, n_expected, n_found, recall)`` of an approximate result."""
    hits = exact.select(query_col, id_col).join(
        approximate.select(query_col, id_col, F.lit(1).alias("hit")), [query_col, id_col], "left"
    )
    per_query = hits.groupBy(query_col).agg(
        F.count("*").alias("expected"), F.count("hit").alias("found")
    )
    return per_query.agg(
        F.count("*").alias("n_queries"),
        F.sum("expected").alias("n_expected"),
        F.sum("found").alias("n_found"),
        F.round(F.sum("found") / F.sum("expected"), 4).alias("recall"),
    )

