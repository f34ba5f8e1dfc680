"""Token ids in bit- or byte-plane files with a chunk index.

Documents are dealt by ranges of their id, so the files together hold all ids in
ascending order.  A file is a Parquet container whose rows are chunks of a fixed
number of ids: every chunk is transposed into planes (4 of bytes or 32 of bits), each
plane compressed on its own with zstandard.  High planes of small ids are nearly
constant and cost next to nothing.  The small columns of the rows are the chunk index:
which document pieces a chunk holds, and where it stands in its file.

Defined results: a null text is an empty one and gives the end id alone; rows without an
id come first; repeated ids keep all their rows, ordered by text; an empty table gives
files without chunks; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.textops import encoded, plain, word_encoder

CHUNK_IDS = 65_536

CHUNK_SCHEMA = (
    "shard int, chunk int, first long, n_ids int, planes array<binary>, "
    "pieces array<struct<doc_id: long, ordinal: long, skip: long, length: long, n_tokens: long>>"
)


def to_planes(ids: np.ndarray, kind: str) -> list[np.ndarray]:
    """The bytes (or bits) of all ids, one plane per position, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return list(np.ascontiguousarray(raw.T))
    bits = np.unpackbits(raw, axis=1, bitorder="little")
    return list(np.packbits(np.ascontiguousarray(bits.T), axis=1))


def from_planes(planes: list[np.ndarray], n_ids: int) -> np.ndarray:
    """Inverse of :func:`to_planes`; 4 planes are bytes, 32 are bits."""
    if len(planes) == 4:
        return np.ascontiguousarray(np.stack(planes).T).view("<u4").ravel()
    bits = np.unpackbits(np.stack(planes), axis=1, count=n_ids)
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u4").ravel()


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


_PIECE = pa.struct([(n, pa.int64()) for n in ("doc_id", "ordinal", "skip", "length", "n_tokens")])
_CHUNK = pa.schema(
    [
        ("shard", pa.int32()),
        ("chunk", pa.int32()),
        ("first", pa.int64()),
        ("n_ids", pa.int32()),
        ("planes", pa.list_(pa.binary())),
        ("pieces", pa.list_(_PIECE)),
    ]
)


def _chunk_writer(vocabulary: str, end_id: int, chunk_ids: int, kind: str, level: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pack = word_encoder(vocabulary), zstandard.ZstdCompressor(level=level)
        shard, width = TaskContext.get().partitionId(), 4 * chunk_ids
        held, pieces, chunk, ordinal = bytearray(), [], 0, 0

        def flush(size: int) -> pa.RecordBatch:
            nonlocal chunk, pieces
            ids = np.frombuffer(bytes(held[:size]), "<u4")
            del held[:size]
            row = {
                "shard": shard, "chunk": chunk, "first": chunk * chunk_ids, "n_ids": len(ids),
                "planes": [pack.compress(p.tobytes()) for p in to_planes(ids, kind)], "pieces": pieces,
            }
            chunk, pieces = chunk + 1, []
            return _arrow([row], _CHUNK)

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), encoder, end), strict=True):
                done = 0
                while done < len(ids):
                    take = min(len(ids) - done, width - len(held))
                    pieces.append(
                        {"doc_id": doc_id, "ordinal": ordinal, "skip": done // 4, "length": take // 4, "n_tokens": len(ids) // 4}
                    )
                    held += ids[done : done + take]
                    done += take
                    if len(held) == width:
                        yield flush(width)
                ordinal += 1
        if held:
            yield flush(len(held))

    return run


def write_ids(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    end_id: int = 1,
    chunk_ids: int = CHUNK_IDS,
    planes: str = "byte",
    level: int = 3,
) -> None:
    """Encode ``doc_id, text`` and write plane files below ``folder``, in ascending id order.

    One shuffle by id ranges.  A file is written by one task, which holds one chunk.
    """
    if planes not in ("byte", "bit") or chunk_ids % 8:
        raise ValueError("planes is 'byte' or 'bit', chunk_ids a multiple of 8")
    (
        plain(docs, "doc_id", "text")
        .repartitionByRange(F.col("doc_id"), F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_chunk_writer(vocabulary, end_id, chunk_ids, planes, level), CHUNK_SCHEMA)
        .write.option("compression", "none")
        .parquet(folder)
    )


def chunk_index(spark: SparkSession, folder: str) -> DataFrame:
    """Place of every chunk; the planes themselves are not read."""
    return spark.read.schema(CHUNK_SCHEMA).parquet(folder).select("shard", "chunk", "first", "n_ids", "pieces")


_SEGMENT = pa.schema(
    [
        ("shard", pa.int32()), ("ordinal", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()), ("skip", pa.int64()),
        ("n_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()),
    ]
)
_SEGMENT_SCHEMA = (
    "shard int, ordinal long, doc_id long, at long, skip long, n_tokens long, ids binary, ids_crc32 long"
)


def _segment_reader(keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                shard, first, n_ids, packed, pieces = (batch.column(i)[row].as_py() for i in range(5))
                planes = [np.frombuffer(unpack.decompress(p), np.uint8) for p in packed]
                ids, at, out = from_planes(planes, n_ids).tobytes(), 0, []
                for p in pieces:
                    own = ids[4 * at : 4 * (at + p["length"])]
                    whole = p["length"] == p["n_tokens"]
                    out.append(
                        {
                            "shard": shard, "ordinal": p["ordinal"], "doc_id": p["doc_id"], "at": first + at - p["skip"],
                            "skip": p["skip"], "n_tokens": p["n_tokens"], "ids": own if keep_ids or not whole else None,
                            "ids_crc32": zlib.crc32(own) if whole else None,
                        }
                    )
                    at += p["length"]
                yield _arrow(out, _SEGMENT)

    return run


def read_ids(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (``keep_ids``) ids of every document of the files.

    Chunks are decoded independently; only documents that cross a chunk edge are
    gathered, by one shuffle of those pieces.  ``start`` counts the ids of all documents
    before it: the sums of the files before (one row a file) plus its place in its file.
    """
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(folder)
    segments = chunks.select("shard", "first", "n_ids", "planes", "pieces").mapInArrow(
        _segment_reader(keep_ids), _SEGMENT_SCHEMA
    )
    whole = segments.where("ids_crc32 is not null").select("shard", "at", "doc_id", "n_tokens", "ids", "ids_crc32")
    joined = F.aggregate(
        F.sort_array("parts"), F.lit(b""), lambda done, p: F.concat(done, p["ids"])
    )
    crossing = (
        segments.where("ids_crc32 is null")
        .groupBy("shard", "ordinal", "at", "doc_id", "n_tokens")
        .agg(F.collect_list(F.struct("skip", "ids")).alias("parts"))
        .select("shard", "at", "doc_id", "n_tokens", joined.alias("ids"))
        .withColumn("ids_crc32", F.crc32("ids"))
    )
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        chunks.groupBy("shard")
        .agg(F.sum("n_ids").alias("ids_of_shard"))
        .select("shard", F.coalesce(F.sum("ids_of_shard").over(before), F.lit(0)).alias("base"))
    )
    columns = ["doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"]
    return whole.unionByName(crossing).join(base, "shard").select(*columns, *(["ids"] if keep_ids else []))
