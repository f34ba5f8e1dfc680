"""Best-two-fit packing of token sequences into bins of a fixed size.

A bin is filled greedily with the longest pieces that still fit; then its smallest piece
is exchanged for two unpacked ones if they fill the gap that this opens more tightly.
Pieces of one length are alike, so the plan is made on the histogram of lengths: at most
``size`` counts, however large the corpus.  A bin's pattern is repeated as often as the
counts allow, which gives the bins of the plain algorithm in as many steps as there are
patterns.  Spark numbers the pieces of each length (task by task, then over tasks), and
every piece finds its bin by its number.

Defined results: a null text is an empty one, so every row has one piece with the end
id; rows without an id, repeated ids and repeated rows are packed row by row; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.textops import encoded, plain, stored, word_encoder

PIECE_SCHEMA = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, part int, number long"
)
_PIECE = pa.schema(
    [
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("ids", pa.binary()), ("part", pa.int32()), ("number", pa.int64()),
    ]
)


def _cutter(vocabulary: str, size: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = word_encoder(vocabulary), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(batch.column(1), encoder, end), strict=True):
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[at : at + 4 * size]
                    length = len(own) // 4
                    out.append((doc_id, piece, at // 4, length, zlib.crc32(own), own if keep_ids else None, part, seen[length]))
                    seen[length] += 1
            columns = list(zip(*out, strict=True)) or [[]] * len(_PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE, strict=True)], schema=_PIECE)

    return run


def plan_bins(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths, longest first) with the number of bins of each, for counts by length."""
    left = np.zeros(size + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lengths = np.arange(size + 1)
    plan = []
    while left.any():
        used: Counter = Counter()
        gap = size
        fits = np.maximum.accumulate(np.where(left > 0, lengths, 0))  # longest left, up to each length
        while gap and (take := int(fits[gap])):
            times = int(min(left[take] - used[take], gap // take))
            used[take] += times
            gap -= times * take
            if used[take] == left[take]:
                rest = left.copy()
                for length, n in used.items():
                    rest[length] -= n
                fits = np.maximum.accumulate(np.where(rest > 0, lengths, 0))
        if gap and len(used) + used[min(used)] > 1:
            smallest = min(used)
            rest = left.copy()
            for length, n in used.items():
                rest[length] -= n
            room = gap + smallest
            fits = np.maximum.accumulate(np.where(rest > 0, lengths, 0))
            first = np.flatnonzero(rest[: room + 1] > 0)
            second = fits[room - first]
            same = (second == first) & (rest[first] < 2)
            second[same] = np.where(first[same] > 0, fits[np.maximum(first[same] - 1, 0)], 0)
            both = np.where(second > 0, first + second, 0)
            if both.size and both.max() > smallest:
                best = int(both.argmax())
                used[smallest] -= 1
                used[int(first[best])] += 1
                used[int(second[best])] += 1
                used = +used
        times = min(int(left[length]) // n for length, n in used.items())
        for length, n in used.items():
            left[length] -= times * n
        plan.append((sorted(used.elements(), reverse=True), times))
    return plan


def _slots(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length and run of piece numbers: first bin, place in the bin, pieces a bin."""
    rows, sequence, given = [], 0, Counter()
    for lengths, times in plan:
        offset = 0
        for length, uses in sorted(Counter(lengths).items(), reverse=True):
            rows.append(((length << 48) + given[length], sequence, offset, uses))
            given[length] += uses * times
            offset += uses * length
        sequence += times
    rows.sort()
    names = ("key", "sequence", "offset", "uses")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def _placer(slots: dict[str, np.ndarray], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            length = get("length").to_numpy()
            key = (length << 48) + get("number").to_numpy()
            run_of = np.searchsorted(slots["key"], key, "right") - 1
            nth = key - slots["key"][run_of]
            uses = slots["uses"][run_of]
            sequence = slots["sequence"][run_of] + nth // uses
            offset = slots["offset"][run_of] + nth % uses * length
            yield pa.RecordBatch.from_arrays(
                [*(get(n) for n in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"]
            )

    return run


def pack(
    docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 0, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset.

    Only documents longer than ``size`` are cut.  Texts are read once and never shuffled;
    what is shuffled is a narrow row per piece.  The driver sees the counts of at most
    ``size`` lengths, and the tasks get a plan of at most 62 slots per pattern.
    """
    if size >= 1 << 15:
        raise ValueError("size is below 32768")
    pieces = stored(
        plain(docs, "doc_id", "text").mapInArrow(_cutter(vocabulary, size, end_id, keep_ids), PIECE_SCHEMA), "pieces"
    )
    if not keep_ids:
        pieces = pieces.drop("ids")
    by_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    kinds = dict(pieces.dtypes)
    schema = ", ".join(f"{n} {kinds[n]}" for n in names) + ", sequence_id long, offset long"
    numbered = pieces.join(base, ["length", "part"]).withColumn("number", F.col("number") + F.col("base"))
    return numbered.select(*names, "number").mapInArrow(_placer(_slots(plan_bins(counts, size)), names), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids (little-endian unsigned 32-bit), from ``pack(..., keep_ids=True)``.

    A group is one sequence, so it holds at most ``size`` ids.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
