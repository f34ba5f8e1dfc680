"""Inverted lists in blocks of texts: made where the texts are read, scored where they lie.

A block holds up to :data:`BLOCK_TEXTS` texts: its terms in order, and for each the places of
the texts that have it with their frequencies.  All postings of a text are in one block, so
nothing is shuffled to make blocks, and a text's score is whole within its block.  The asked
terms of many queries travel to the blocks by broadcast; a task keeps the k best rows of a
query over all its blocks.

The lists of a block are one compressed value, opened in Python for one block at a time: a file
reader or an Arrow batch holds many blocks at once, and would hold many times their size in
arrays.

Rows with one id are one text: their frequencies add up, and its other columns are those of one of them.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import config
from tessera.operators.blockjoin import HELD, BestRows
from tessera.session import written

#: Texts and terms of a block at most (a longer text is a block of its own).
BLOCK_TEXTS, BLOCK_TERMS = 2048, 1 << 20

_LISTS = ("terms", "starts", "slots", "tfs")
#: The column of a block's lists.
LISTS = "lists"


def is_blocks(posted: DataFrame) -> bool:
    return LISTS in posted.columns


def _narrow(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))))


def _closed(words: pa.Array, starts: np.ndarray, slots: np.ndarray, tfs: np.ndarray, n: int) -> bytes:
    """The lists of a block of ``n`` texts as one compressed value: lengths for starts, steps for slots."""
    steps = np.diff(slots, prepend=0).astype(np.uint16 if n <= 1 << 16 else np.uint32)  # back to a lower slot: modulo
    lists = (words, _narrow(np.diff(starts)), pa.array(steps), _narrow(tfs))
    rows = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists]
    batch = pa.RecordBatch.from_arrays(rows, names=_LISTS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _opened(value: pa.Scalar) -> tuple[pa.Array, ...]:
    """The terms, starts, slots and tfs of a block."""
    with pa.ipc.open_stream(value.as_buffer()) as stream:
        batch = stream.read_next_batch()
    words, lengths, steps, tfs = (batch.column(c)[0].values for c in _LISTS)
    starts = np.r_[0, np.cumsum(lengths.to_numpy(), dtype=np.int32)]
    steps = steps.to_numpy()
    return words, *(pa.array(x.astype(np.int32)) for x in (starts, np.cumsum(steps, dtype=steps.dtype), tfs.to_numpy()))


def _texts(index: DataFrame, id_col: str, kept: Sequence[str], by_row: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, kept, n_terms, terms, tfs), one row for each id; tfs is null where terms still repeat."""
    plain = index.select(id_col, *kept, "n_terms", "terms", F.lit(None).cast("array<int>").alias("tfs"))
    ids = index.groupBy(F.col(id_col).alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again")
    ids = written(ids, "repeated-ids")  # narrow, and mostly empty
    n = ids.count()
    if not n:
        return plain
    ids = F.broadcast(ids) if n <= config.BROADCAST_ROWS else ids
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    rows = by_row(index.join(ids, same, "left_semi"))
    lists = F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf")))
    firsts = [F.first(c).alias(c) for c in (*kept, "n_terms")]
    merged = rows.groupBy(id_col).agg(*firsts, lists.alias("_lists"))
    # ids whose texts have no term at all have no postings, and are no one's result
    merged = merged.select(id_col, *kept, "n_terms", F.col("_lists.term").alias("terms"), F.col("_lists.tf").alias("tfs"))
    return plain.join(ids, same, "left_anti").unionByName(merged)


def _inverted(terms: pa.Array, tfs: pa.Array) -> bytes:
    """The lists of a block, from the terms of each of its texts."""
    n, flat = len(terms), terms.flatten().dictionary_encode()
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    words = flat.dictionary
    order = pc.sort_indices(words).to_numpy()
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    lengths = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(n, dtype=np.int64), lengths)
    key = place[flat.indices.to_numpy(zero_copy_only=False)] * n + rows
    each = np.ones(len(key), np.int64)
    told = tfs.is_valid().to_numpy(zero_copy_only=False)
    if told.any():
        each[told[rows]] = tfs.flatten().to_numpy(zero_copy_only=False)
    by_key = np.argsort(key, kind="stable")
    key, each = key[by_key], each[by_key]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    tf = np.add.reduceat(each, first) if len(first) else each
    starts = np.searchsorted(key[first] // max(1, n), np.arange(len(words) + 1))
    return _closed(words.take(pa.array(order)), starts, key[first] % max(1, n), tf, n)


def term_blocks(
    index: DataFrame, id_col: str, kept: Sequence[str], version: str | None, by_row: Callable[[DataFrame], DataFrame],
    texts: int = BLOCK_TEXTS,
) -> DataFrame:
    """The blocks of an index: arrays of id, n_terms and ``kept`` columns, and the inverted lists in one value.

    A block has one ``version``, a column beside.  ``by_row`` gives the postings of rows with repeated ids.
    """
    rows = _texts(index, id_col, kept, by_row)
    arrays = [id_col, "n_terms", *[c for c in kept if c != version]]
    of = [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in arrays]
    of.append(T.StructField(LISTS, T.BinaryType()))
    whole = T.StructType([*([rows.schema[version]] if version else []), *of])

    def block(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in arrays]
        own.append(pa.array([_inverted(batch.column("terms"), batch.column("tfs"))], pa.binary()))
        return pa.RecordBatch.from_arrays([*([batch.column(version).slice(0, 1)] if version else []), *own], names=whole.fieldNames())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch]
            if version:
                values = batch.column(version)
                parts = [batch.filter(values.is_null() if v.as_py() is None else pc.fill_null(pc.equal(values, v), False)) for v in values.unique()]
            for part in parts:
                size = pc.fill_null(pc.list_value_length(part.column("terms")), 0).to_numpy(zero_copy_only=False)
                at = 0
                while at < part.num_rows:
                    some = int(np.searchsorted(np.cumsum(size[at : at + texts]), BLOCK_TERMS, side="right"))
                    yield block(part.slice(at, max(1, some)))
                    at += max(1, some)

    return rows.mapInArrow(pack, whole)


def block_rows(blocks: DataFrame, id_col: str, kept: Sequence[str], version: str | None) -> DataFrame:
    """The postings of blocks as rows: term, id, tf, n_terms and the ``kept`` columns."""
    arrays = [id_col, "n_terms", *[c for c in kept if c != version]]
    of = [blocks.schema[c] if c == version else T.StructField(c, blocks.schema[c].dataType.elementType) for c in kept]
    schema = T.StructType([
        T.StructField("term", T.StringType()), T.StructField(id_col, blocks.schema[id_col].dataType.elementType), T.StructField("tf", T.LongType()),
        T.StructField("n_terms", blocks.schema["n_terms"].dataType.elementType), *of,
    ])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, starts, slots, tfs = _opened(batch.column(LISTS)[i])
                own = {c: batch.column(c)[i].values.take(slots) for c in arrays}
                times = np.diff(starts.to_numpy(zero_copy_only=False))
                if version:
                    own[version] = pa.concat_arrays([batch.column(version).slice(i, 1)]).take(pa.array(np.zeros(len(slots), np.int64)))
                found = {"term": terms.take(pa.array(np.repeat(np.arange(len(terms)), times))), "tf": tfs.cast(pa.int64()), **own}
                yield pa.RecordBatch.from_arrays([found[c] for c in schema.fieldNames()], names=schema.fieldNames())

    return blocks.mapInArrow(rows, schema)


def block_terms(blocks: DataFrame, version: str | None) -> DataFrame:
    """df, cf, max_tf and min_terms of every term: a row a term and block, then one sum of those."""
    by = ["term", *([version] if version else [])]
    counts = [T.StructField(c, T.LongType()) for c in ("df", "cf", "max_tf")]
    of = [T.StructField("term", T.StringType()), *([blocks.schema[version]] if version else [])]
    schema = T.StructType([*of, *counts, T.StructField("min_terms", T.IntegerType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                terms, starts, slots, tfs = _opened(batch.column(LISTS)[i])
                if not len(terms):
                    continue
                at, tf = starts.to_numpy(zero_copy_only=False), tfs.to_numpy(zero_copy_only=False).astype(np.int64)
                n_terms = batch.column("n_terms")[i].values.to_numpy(zero_copy_only=False)[slots.to_numpy(zero_copy_only=False)]
                sums = [np.diff(at).astype(np.int64), np.add.reduceat(tf, at[:-1]), np.maximum.reduceat(tf, at[:-1])]
                columns = [terms, *([batch.column(version).slice(i, 1).take(pa.array(np.zeros(len(terms), np.int64)))] if version else [])]
                columns += [*map(pa.array, sums), pa.array(np.minimum.reduceat(n_terms, at[:-1]).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    counted = blocks.select(*by[1:], "n_terms", LISTS).mapInArrow(count, schema)
    return counted.groupBy(*by).agg(
        F.sum("df").alias("df"), F.sum("cf").alias("cf"), F.max("max_tf").alias("max_tf"), F.min("min_terms").alias("min_terms")
    )


# --------------------------------------------------------------------------- search


class _Asked(NamedTuple):
    """The asked terms of some queries: distinct terms in order, and the rows of each."""

    queries: pa.Array
    n_asked: np.ndarray
    terms: pa.Array
    idf: np.ndarray
    starts: np.ndarray
    query: np.ndarray
    avg_terms: float


def _asked(rows: pa.StructArray, query_col: str) -> _Asked:
    query = rows.field(query_col).dictionary_encode(null_encoding="encode")
    term = rows.field("term").dictionary_encode()
    of, code = (x.indices.to_numpy(zero_copy_only=False) for x in (query, term))
    n_asked = np.zeros(len(query.dictionary), np.int64)
    n_asked[of] = rows.field("n_asked").to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    starts = np.searchsorted(code[order], np.arange(len(term.dictionary) + 1))
    idf = rows.field("idf").to_numpy(zero_copy_only=False)[order][starts[:-1]]
    return _Asked(query.dictionary, n_asked, term.dictionary, idf, starts, of[order], float(rows.field("avg_terms")[0].as_py()))


def _scores(asked: _Asked, n_terms: np.ndarray, lists: tuple, k1: float, b: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and numbers of matched terms, queries x texts."""
    words, starts, slots, tfs = lists
    starts, slots, tfs = (x.to_numpy(zero_copy_only=False) for x in (starts, slots, tfs))
    score = np.zeros((len(asked.queries), len(n_terms)))
    matched = np.zeros(score.shape, np.int32)
    damp = k1 * (1 - b + b * n_terms / max(asked.avg_terms, 1e-9))
    at = pc.index_in(asked.terms, value_set=words)
    present = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    for t, p in zip(present.tolist(), at.drop_null().to_numpy(zero_copy_only=False).tolist(), strict=True):
        texts, tf = slots[starts[p] : starts[p + 1]], tfs[starts[p] : starts[p + 1]]
        weight = asked.idf[t] * (tf * (k1 + 1) / (tf + damp[texts]))
        for q in asked.query[asked.starts[t] : asked.starts[t + 1]].tolist():  # a text is in a list once
            score[q, texts] += weight
            matched[q, texts] += 1
    return score, matched


def asked_groups(told: DataFrame, query_col: str, max_queries: int, n_queries: int) -> DataFrame:
    """The asked terms of about ``max_queries`` queries in a row."""
    group = F.pmod(F.xxhash64(query_col), F.lit(max(1, -(-n_queries // max_queries))))
    row = F.struct(query_col, "term", "idf", "avg_terms", "n_asked")
    return told.groupBy(group.alias("asked_number")).agg(F.collect_list(row).alias("asked"))


def _pairs(blocks: DataFrame, groups: DataFrame, id_col: str) -> DataFrame:
    return blocks.select(id_col, "n_terms", LISTS).crossJoin(F.broadcast(groups))


def _decoded(batches: Iterator[pa.RecordBatch], query_col: str) -> Iterator[tuple]:
    """(number of the queries, their asked terms, ids, n_terms, lists) of each pair."""
    held: OrderedDict[int, _Asked] = OrderedDict()
    closed = lists = None  # a block meets all groups one after another
    for batch in batches:
        for i in range(batch.num_rows):
            number = batch.column("asked_number")[i].as_py()
            if number not in held:
                if len(held) == HELD:
                    held.popitem(last=False)
                held[number] = _asked(batch.column("asked")[i].values, query_col)
            held.move_to_end(number)
            ids, n_terms = (batch.column(j)[i].values for j in range(2))
            value = batch.column(2)[i]
            if closed is None or not value.as_buffer().equals(closed):
                closed, lists = value.as_buffer(), _opened(value)
            yield number, held[number], ids, n_terms.to_numpy(zero_copy_only=False), lists


def best_texts(
    blocks: DataFrame, groups: DataFrame, id_col: str, query_field: T.StructField, k: int, k1: float, b: float, every: bool
) -> DataFrame:
    """``(query, id, score, matched)`` of the k best texts of each query in each task, ties by id.

    With ``every`` a text has to have all asked terms.
    """
    query_col = query_field.name
    id_field = T.StructField(id_col, blocks.schema[id_col].dataType.elementType)
    names = [query_col, id_col, "key"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[int, BestRows] = OrderedDict()
        for number, asked, ids, n_terms, lists in _decoded(batches, query_col):
            if number not in held:
                if len(held) == HELD:
                    yield held.popitem(last=False)[1].result(names)
                held[number] = BestRows(asked.queries, k)
            held.move_to_end(number)
            score, matched = _scores(asked, n_terms, lists, k1, b)
            found = matched == asked.n_asked[:, None] if every else matched > 0
            held[number].add(np.where(found, -score, np.inf), ids)
        for best in held.values():
            if best.ids is not None:
                yield best.result(names)

    schema = T.StructType([query_field, id_field, T.StructField("key", T.DoubleType())])
    return _pairs(blocks, groups, id_col).mapInArrow(search, schema).select(query_col, id_col, (-F.col("key")).alias("score"))


def whole_matches(blocks: DataFrame, groups: DataFrame, id_col: str, query_field: T.StructField, k1: float, b: float) -> DataFrame:
    """``(query, id, score)`` of every text that has all asked terms of a query."""
    query_col = query_field.name
    id_field = T.StructField(id_col, blocks.schema[id_col].dataType.elementType)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, asked, ids, n_terms, lists in _decoded(batches, query_col):
            score, matched = _scores(asked, n_terms, lists, k1, b)
            q, text = np.nonzero(matched == asked.n_asked[:, None])
            if len(q):
                columns = [asked.queries.take(pa.array(q)), ids.take(pa.array(text)), pa.array(score[q, text])]
                yield pa.RecordBatch.from_arrays(columns, names=[query_col, id_col, "score"])

    schema = T.StructType([query_field, id_field, T.StructField("score", T.DoubleType())])
    return _pairs(blocks, groups, id_col).mapInArrow(search, schema)


def counted_matches(blocks: DataFrame, groups: DataFrame, id_col: str, query_field: T.StructField) -> DataFrame:
    """``(query, any, all)``: how many texts have any, and all, of its asked terms."""
    query_col = query_field.name

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, asked, _, n_terms, lists in _decoded(batches, query_col):
            _, matched = _scores(asked, n_terms, lists, config.BM25_K1, config.BM25_B)
            sums = [(matched > 0).sum(axis=1), (matched == asked.n_asked[:, None]).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([asked.queries, *(pa.array(x.astype(np.int64)) for x in sums)], names=[query_col, "any", "all"])

    schema = T.StructType([query_field, T.StructField("any", T.LongType()), T.StructField("all", T.LongType())])
    found = _pairs(blocks, groups, id_col).mapInArrow(count, schema)
    return found.groupBy(query_col).agg(F.sum("any").alias("any"), F.sum("all").alias("all"))
