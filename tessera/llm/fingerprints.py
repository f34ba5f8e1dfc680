"""Bottom-k fingerprints of documents: the k smallest hashes of their word shingles.

Fingerprints of parts merge into that of the whole (the k smallest of both), and estimate
how alike two documents are, how much of one is in the other, and how many distinct
shingles there are.

Defined results: a null text is an empty one, whose fingerprint is empty; two empty
fingerprints are alike (1), an empty and another are not (0); rows without an id come
first in the order of documents, rows with one id follow each other by text; a single
document follows itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.textops import SLICE, joined_bytes, plain, shingles_many, slices, texts_of, word_hashes_many

#: Hashes of a fingerprint, and words of a shingle.
K, WORDS = 128, 5


def bottom_k(text: str | None) -> np.ndarray:
    """The fingerprint of a whole text: at most :data:`K` sorted hashes."""
    return many_bottom_k([text or ""])[0]


def many_bottom_k(texts: list[str]) -> list[np.ndarray]:
    """Fingerprints of many texts."""
    return [own[:K] for own in shingles_many(*word_hashes_many(*joined_bytes(texts)), WORDS)]


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The fingerprint of both parts together."""
    return np.union1d(left, right)[:K]


def resemblance(left: np.ndarray, right: np.ndarray) -> float:
    """Estimated Jaccard similarity: the share of the union's smallest hashes that both have."""
    if len(left) == 0 or len(right) == 0:
        return float(len(left) == len(right))
    both = np.concatenate((left, right))
    both.sort()
    again = both[1:] == both[:-1]
    last = min(K, len(both) - int(again.sum()))
    rank = np.cumsum(np.concatenate(([True], ~again)))[1:]
    return float((again & (rank <= last)).sum()) / last


def containment(left: np.ndarray, right: np.ndarray) -> float:
    """Estimated share of the left document's shingles that the right one has."""
    if len(left) == 0:
        return 1.0
    overlap = resemblance(left, right)
    return min(1.0, overlap / (1 + overlap) * (distinct(left) + distinct(right)) / distinct(left))


def distinct(fingerprint: np.ndarray) -> float:
    """Estimated number of distinct shingles; exact below :data:`K`."""
    if len(fingerprint) < K:
        return float(len(fingerprint))
    return (K - 1) / ((float(fingerprint[-1]) + 1) * 2.0**-64)


def to_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own for _, _, *raw in slices(batch.column(1)) for own in shingles_many(*word_hashes_many(*raw), WORDS)]
            found = [to_text(own[:K]) for own in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return plain(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string")


def merged(parts: DataFrame, key: str) -> DataFrame:
    """One fingerprint for each ``key`` from those of its parts.

    Hashes are dealt out one by one, and each task keeps the :data:`K` smallest of a key
    before the shuffle, so a key with any number of parts stays small.
    """
    one = parts.select(key, F.explode(F.regexp_extract_all("fingerprint", F.lit("(.{16})"), F.lit(1))).alias("hash")).distinct()
    least = Window.partitionBy(key).orderBy("hash")
    kept = one.withColumn("nth", F.row_number().over(least)).where(F.col("nth") <= K)
    return kept.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("hash")), "").alias("fingerprint"))


def _bucketed(docs: DataFrame, edges: list[int]) -> DataFrame:
    starts = np.array(edges, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            bucket = np.searchsorted(starts, ids.fill_null(-(2**63)).to_numpy(zero_copy_only=False), "right")
            last = pa.array(np.zeros(batch.num_rows, bool))
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), last, *batch.columns], ["bucket", "closing", "doc_id", "text"])

    return docs.mapInArrow(run, "bucket int, closing boolean, doc_id long, text string")


def in_order(docs: DataFrame) -> DataFrame:
    """Documents in ascending order of ids, a range for each partition, closed by its successor.

    The last row of a partition (``closing``) repeats the first document of the next
    range, or of all for the last, so a task meets the next document of each of its own.
    The edges are ids of the table, as many as there are shuffle partitions.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)]) if parts > 1 else F.array(F.lit(0.5))
    known = docs.agg(
        F.percentile_approx("doc_id", shares, 10 * parts).alias("edges"), F.min("doc_id").alias("least"), F.count("*").alias("n"), F.count("doc_id").alias("named")
    ).first()
    edges = sorted({e for e in known["edges"] or [] if e != known["least"]})
    head = docs.where("doc_id is null") if known["named"] < known["n"] else docs.where(F.col("doc_id") == F.lit(known["least"]))
    first = head.groupBy("doc_id").agg(F.min("text").alias("text")).select(F.lit(len(edges)).cast("int").alias("bucket"), "doc_id", "text")
    heads = docs.where(F.col("doc_id").isin(edges)).groupBy("doc_id").agg(F.min("text").alias("text"))
    place = F.array_position(F.array(*[F.lit(e).cast("long") for e in edges]).cast("array<bigint>"), F.col("doc_id")) - 1
    closing = heads.select(place.cast("int").alias("bucket"), "doc_id", "text").union(first).withColumn("closing", F.lit(True))
    rows = _bucketed(docs, edges).unionByName(closing)
    return rows.repartitionById(len(edges) + 1, F.col("bucket")).sortWithinPartitions("closing", "doc_id", "text")


_RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bool, int | None, str]]]:
    """Rows (closing, doc_id, text) in order, a few texts at a time."""
    held, size = [], 0
    for batch in batches:
        for row in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch), strict=True):
            held.append(row)
            size += len(row[2])
            if size > SLICE:
                yield held
                held, size = [], 0
    if held:
        yield held


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [c.split()[0] for c in _RESULT.split(", ")]
    last: list = []
    for rows in _runs(batches):
        rows = last + rows
        edited = []
        for (_, _, text), (_, _, following) in zip(rows[:-1], rows[1:], strict=True):
            cut = len(text) // 4
            edited.append(text[: len(text) - cut] + following[:cut])
        own = many_bottom_k([r[2] for r in rows])
        changed = many_bottom_k(edited)
        out = [
            (
                rows[i][1], len(rows[i][2]), hashlib.sha256(edited[i].encode("utf-8", "surrogatepass")).hexdigest(),
                to_text(own[i]), to_text(changed[i]), resemblance(own[i], changed[i]), resemblance(own[i], own[i + 1]),
            )
            for i in range(len(edited))
            if not rows[i][0]
        ]
        last = rows[-1:]
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def compared(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document.

    The edited text has the last quarter replaced by the start of the next document.  One
    shuffle by id ranges; a task holds a few texts.
    """
    return in_order(plain(docs, "doc_id", "text")).mapInArrow(_compare, _RESULT)
