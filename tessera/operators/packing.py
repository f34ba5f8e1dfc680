"""Paragraph packing of documents given as page rows, however long they are.

A document is never assembled: its pages form blocks of bounded size, and greedy
packing is carried across blocks by the only state it has, the number of characters
held in the open chunk.

1. Each block is summarised as a function of the characters held on entry: held
   on exit and chunks begun.  The function is stored as runs of equal effect.
2. Per document the blocks' functions are applied in order, which costs a few
   numbers per block and gives every block its entry state.
3. Each block is cut on its own; a chunk that crosses a block edge is joined from
   its pieces, which are no longer than one chunk.
4. Offsets are prefix sums and prefix minima over the chunks, taken within groups
   of chunks first and then over the groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import strip
from tessera.session import cut_lineage

SEPARATOR = "\n\n"
JOIN = len(SEPARATOR)
PAGES_PER_BLOCK = 256
CHUNKS_PER_GROUP = 4096


def pack_pages(
    pages: DataFrame,
    doc_col: str,
    page_col: str,
    text_col: str,
    size: int = config.GOLD_CHUNK_SIZE,
    overlap: int = config.GOLD_CHUNK_OVERLAP,
    min_chars: int = config.MIN_CHUNK_DOC_CHARS,
    pages_per_block: int = PAGES_PER_BLOCK,
    chunks_per_group: int = CHUNKS_PER_GROUP,
) -> DataFrame:
    """``(doc, chunk_index, text, start_char, end_char, src_start, src_end)``.

    The result is that of packing the assembled documents of at least
    ``min_chars`` characters.
    """
    kept = pages.select(
        F.col(doc_col).alias("doc"),
        F.col(page_col).cast("bigint").alias("page"),
        strip(F.col(text_col)).alias("text"),
    ).where(F.col("text") != "")
    kept = kept.withColumn("block", F.floor(F.col("page") / pages_per_block))
    extent = kept.groupBy("doc").agg((F.sum(F.char_length("text")) + JOIN * (F.count("*") - 1)).alias("chars"))
    wanted = kept.join(extent.where(F.col("chars") >= min_chars), "doc", "left_semi")
    return _pack_blocks(wanted, size, overlap, chunks_per_group).withColumnRenamed("doc", doc_col)


def _paragraphs(block: pa.Table) -> Iterator[tuple[int, str]]:
    """Paragraphs of a block in order, with their offset from the block's start."""
    at = 0
    for _, text in sorted(zip(block["page"].to_pylist(), block["text"].to_pylist(), strict=True)):
        cursor = at
        for raw in text.split(SEPARATOR):
            para = raw.strip()
            if para:
                yield cursor + len(raw) - len(raw.lstrip()), para
            cursor += len(raw) + JOIN
        at += len(text) + JOIN


def _n_windows(n: int, step: int) -> int:
    return -(-n // step)


def _pack_blocks(pages: DataFrame, size: int, overlap: int, chunks_per_group: int) -> DataFrame:
    step = size - overlap
    doc_type = pages.schema["doc"].dataType.simpleString()

    def summarise(block: pa.Table) -> pa.Table:
        held = np.arange(size + 1)  # for every number of characters held on entry
        begun = np.zeros(size + 1, dtype=np.int64)
        merged = False
        for _, para in _paragraphs(block):
            n = len(para)
            grown = np.where(held == 0, n, held + JOIN + n)
            fits = grown <= size
            if n > size:
                begun += _n_windows(n, step)
                held = np.zeros_like(held)
            else:
                begun += ~fits | (held == 0)
                held = np.where(fits, grown, n)
            if not merged and (held == held[0]).all():
                # All entries agree from here on: one number each is enough.
                merged, base, held = True, begun.copy(), held[:1]
                begun = np.zeros(1, dtype=np.int64)
        if merged:
            held, begun = np.repeat(held, size + 1), base + begun[0]
        first = np.r_[True, (held[1:] != held[:-1]) | (begun[1:] != begun[:-1])]
        starts = np.nonzero(first)[0]
        lengths = [len(t) + JOIN for t in block["text"].to_pylist()]
        return pa.table(
            {
                "doc": block["doc"].slice(0, 1),
                "block": block["block"].slice(0, 1),
                "chars": pa.array([sum(lengths)], pa.int64()),
                "entry": pa.array([starts.tolist()], pa.list_(pa.int32())),
                "held": pa.array([held[starts].tolist()], pa.list_(pa.int32())),
                "begun": pa.array([begun[starts].tolist()], pa.list_(pa.int64())),
            }
        )

    summaries = pages.groupBy("doc", "block").applyInArrow(
        summarise,
        f"doc {doc_type}, block bigint, chars bigint, entry array<int>, held array<int>, "
        "begun array<bigint>",
    )

    def enter(blocks: pa.Table) -> pa.Table:
        blocks = blocks.sort_by("block")
        held, at, chunks = 0, 0, 0
        out: dict[str, list[int]] = {"held": [], "at": [], "chunks": []}
        for row in blocks.drop_columns(["doc"]).to_pylist():
            out["held"].append(held)
            out["at"].append(at)
            out["chunks"].append(chunks)
            run = int(np.searchsorted(row["entry"], held, side="right")) - 1
            chunks += row["begun"][run]
            held = row["held"][run]
            at += row["chars"]
        columns = {name: pa.array(values, pa.int64()) for name, values in out.items()}
        return pa.table({"doc": blocks["doc"], "block": blocks["block"], **columns})

    entries = summaries.groupBy("doc").applyInArrow(
        enter, f"doc {doc_type}, block bigint, held bigint, at bigint, chunks bigint"
    )

    def cut(block: pa.Table) -> pa.Table:
        held, at, chunk = (block[c][0].as_py() for c in ("held", "at", "chunks"))
        chunk -= 1  # the chunk open on entry
        rows: list[dict] = []

        def piece(text: str, src: int, offset: int | None, add: int) -> dict:
            return {"chunk": chunk, "text": text, "src_start": src, "src_end": src + len(text),
                    "offset": offset, "add": add}

        open_piece: dict | None = None
        for relative, para in _paragraphs(block):
            n, src = len(para), at + relative
            grown = n if held == 0 else held + JOIN + n
            if grown <= size and held:
                if open_piece is None:  # goes on with a chunk of an earlier block
                    open_piece = piece(para, src, None, 0)
                else:
                    open_piece["text"] += SEPARATOR + para
                    open_piece["src_end"] = src + n
                held = grown
                continue
            if open_piece is not None:
                rows.append(open_piece)
                open_piece = None
            if n > size:
                count = _n_windows(n, step)
                for w in range(count):
                    chunk += 1
                    i = w * step
                    window = para[i : i + size]
                    rows.append(piece(window, src + i, i, n + JOIN if w == count - 1 else 0))
                held = 0
            else:
                chunk += 1
                open_piece = piece(para, src, None, n + JOIN if held else 0)
                held = n
        if open_piece is not None:
            rows.append(open_piece)
        fields = [
            ("chunk", pa.int64()), ("text", pa.string()), ("src_start", pa.int64()),
            ("src_end", pa.int64()), ("offset", pa.int64()), ("add", pa.int64()),
        ]
        columns = {name: pa.array([r[name] for r in rows], kind) for name, kind in fields}
        keys = {c: pa.array([block[c][0].as_py()] * len(rows), block.schema.field(c).type)
                for c in ("doc", "block")}
        return pa.table({**keys, **columns})

    pieces = (
        pages.join(entries, ["doc", "block"])
        .groupBy("doc", "block")
        .applyInArrow(
            cut,
            f"doc {doc_type}, block bigint, chunk bigint, text string, src_start bigint, "
            "src_end bigint, offset bigint, add bigint",
        )
    )
    # A chunk has at most one piece per block and no more than ``size`` characters.
    parts = F.sort_array(F.collect_list(F.struct("block", "text")))
    chunks = pieces.groupBy("doc", "chunk").agg(
        F.array_join(parts["text"], SEPARATOR).alias("text"),
        F.min("src_start").alias("src_start"),
        F.max("src_end").alias("src_end"),
        F.max("offset").alias("offset"),
        F.max("add").alias("add"),
    )
    return _with_offsets(cut_lineage(chunks), overlap, chunks_per_group)


def _with_offsets(chunks: DataFrame, overlap: int, chunks_per_group: int) -> DataFrame:
    """Start and end by the gold convention, from prefix sums over the chunks.

    A packed chunk moves the next start by its length minus the overlap, never
    below 0: the start is the prefix sum minus its lowest value so far.  A window
    starts at the sum of the paragraphs that did not extend a chunk before it.
    """
    length = F.char_length("text")
    rows = chunks.withColumn("group", F.floor(F.col("chunk") / chunks_per_group)).withColumn(
        "move", F.when(F.col("offset").isNull(), length - overlap).otherwise(F.lit(0))
    )
    inside = Window.partitionBy("doc", "group").orderBy("chunk")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("moved", F.coalesce(F.sum("move").over(before), F.lit(0)))
    rows = rows.withColumn("passed", F.coalesce(F.sum("add").over(before), F.lit(0)))
    rows = rows.withColumn("lowest", F.min("moved").over(inside))
    groups = rows.groupBy("doc", "group").agg(
        F.sum("move").alias("g_move"), F.sum("add").alias("g_add"), F.min("moved").alias("g_low")
    )
    earlier = (
        Window.partitionBy("doc").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    )
    groups = groups.withColumn("moved_to", F.coalesce(F.sum("g_move").over(earlier), F.lit(0)))
    groups = groups.withColumn("passed_to", F.coalesce(F.sum("g_add").over(earlier), F.lit(0)))
    groups = groups.withColumn(
        "low_to", F.coalesce(F.min(F.col("moved_to") + F.col("g_low")).over(earlier), F.lit(0))
    )
    joined = rows.join(groups.select("doc", "group", "moved_to", "passed_to", "low_to"), ["doc", "group"])
    total = F.col("moved_to") + F.col("moved")
    floor = F.least(F.lit(0), F.col("low_to"), F.col("moved_to") + F.col("lowest"))
    start = F.when(F.col("offset").isNull(), total - floor).otherwise(
        F.col("passed_to") + F.col("passed") + F.col("offset")
    )
    return joined.withColumn("start_char", start).select(
        "doc",
        F.col("chunk").alias("chunk_index"),
        "text",
        "start_char",
        (F.col("start_char") + length).alias("end_char"),
        "src_start",
        "src_end",
    )
