"""The two chunkers: plain sliding windows and greedy paragraph packing.

Both return ``array<struct<...>>`` columns that a caller explodes, so a document
never leaves its row and no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import bind, strip


def _check(size: int, overlap: int) -> int:
    if not 0 <= overlap < size:
        raise ValueError("need 0 <= overlap < size")
    return size - overlap


def run_to_end_windows(
    text: Column,
    size: int = config.GOLD_CHUNK_SIZE,
    overlap: int = config.GOLD_CHUNK_OVERLAP,
    drop_contained_tail: bool = False,
) -> Column:
    """Windows that start at every multiple of the step below the text length.

    The last one may lie wholly inside its predecessor; ``drop_contained_tail``
    leaves it out.

    One linear pass cuts the text into blocks of one step.  A window is its block
    and the first characters of the blocks after it; cutting windows by position
    would walk from the start of the text for each of them.
    """
    step = _check(size, overlap)
    pattern = F.lit("(?s).{1,%d}" % step)

    def from_blocks(blocks: Column) -> Column:
        def window(block: Column, i: Column) -> Column:
            tail = F.array_join(F.slice(blocks, i + 2, F.lit(-(-overlap // step))), "")
            return F.concat(block, F.substring(tail, 1, overlap))

        if not drop_contained_tail:
            return F.transform(blocks, window)
        last = F.char_length(F.element_at(blocks, -1))
        contained = (F.size(blocks) > 1) & (last <= overlap)
        # With an overlap above the step the last blocks are contained as a group.
        if overlap > step:
            length = (F.size(blocks) - 1) * step + last
            kept = F.floor(F.greatest(length - overlap - 1, F.lit(0)) / step).cast("int") + 1
        else:
            kept = F.size(blocks) - F.when(contained, 1).otherwise(0)
        return F.slice(F.transform(blocks, window), F.lit(1), kept)

    blocks = F.regexp_extract_all(text, pattern, F.lit(0))
    empty = F.expr("cast(array() as array<string>)")
    return bind(blocks, lambda b: F.when(F.size(b) > 0, from_blocks(b)).otherwise(empty))


def sliding_chunks(
    text: Column,
    size: int = config.CORPUS_CHUNK_SIZE,
    overlap: int = config.CORPUS_CHUNK_OVERLAP,
    min_chars: int = config.CORPUS_MIN_CHUNK,
) -> Column:
    """Windows that stop at the end of the text, stripped, longer than ``min_chars``."""
    windows = run_to_end_windows(text, size, overlap, drop_contained_tail=True)
    return F.filter(F.transform(windows, strip), lambda c: F.char_length(c) > min_chars)


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """Stripped, non-empty paragraphs."""
    return F.array_remove(F.transform(F.split(text, separator), strip), "")


_PIECE = "struct<text:string,start_char:int,end_char:int,src_start:int,src_end:int>"
_STATE = (
    f"struct<out:array<{_PIECE}>,buf:string,start:int,pos:int,"
    "cursor:int,from_char:int,to_char:int>"
)


#: Paragraphs of a block of the fold.
_PARAGRAPHS = 64


def _piece(text, start, end, src_start, src_end) -> Column:
    return F.struct(
        text.alias("text"),
        start.cast("int").alias("start_char"),
        end.cast("int").alias("end_char"),
        src_start.cast("int").alias("src_start"),
        src_end.cast("int").alias("src_end"),
    )


def packed_chunks(
    text: Column,
    size: int = config.GOLD_CHUNK_SIZE,
    overlap: int = config.GOLD_CHUNK_OVERLAP,
    separator: str = "\n\n",
    drop_contained_tail: bool = False,
) -> Column:
    """Pack paragraphs greedily into chunks of at most ``size`` characters.

    Paragraphs are joined by a blank line; one longer than ``size`` is cut into
    overlapping windows of its own.  ``start_char``/``end_char`` follow the
    established convention of the gold table (start moves back by the overlap at
    each flush); ``src_start``/``src_end`` are true offsets into the text.

    The fold runs once over the paragraphs of the row, as a higher-order function, in
    blocks of paragraphs: only a block's own chunks are copied at each step.
    """
    step = _check(size, overlap)
    join_len = 2

    def flush(acc: Column) -> Column:
        return _piece(
            acc["buf"],
            acc["start"],
            acc["start"] + F.char_length(acc["buf"]),
            acc["from_char"],
            acc["to_char"],
        )

    def windows(acc: Column, para: Column, src: Column) -> Column:
        return F.transform(
            run_to_end_windows(para, size, overlap, drop_contained_tail),
            lambda w, i: _piece(
                w,
                acc["pos"] + i * step,
                acc["pos"] + i * step + F.char_length(w),
                src + i * step,
                src + i * step + F.char_length(w),
            ),
        )

    def state(out, buf, start, pos, cursor, from_char, to_char) -> Column:
        return F.struct(
            out.alias("out"),
            buf.alias("buf"),
            start.cast("int").alias("start"),
            pos.cast("int").alias("pos"),
            cursor.cast("int").alias("cursor"),
            from_char.cast("int").alias("from_char"),
            to_char.cast("int").alias("to_char"),
        ).cast(_STATE)

    def step_over(acc: Column, raw: Column) -> Column:
        para = strip(raw)
        n = F.char_length(para)
        lead = F.char_length(raw) - F.char_length(F.ltrim(raw, F.lit(config.WHITESPACE)))
        src = acc["cursor"] + lead
        cursor = acc["cursor"] + F.char_length(raw) + len(separator)
        empty_buf = acc["buf"] == ""
        held = F.char_length(acc["buf"])
        fits = F.when(empty_buf, n <= size).otherwise(held + join_len + n <= size)

        skipped = state(
            acc["out"], acc["buf"], acc["start"], acc["pos"], cursor, acc["from_char"], acc["to_char"]
        )
        merged = state(
            acc["out"],
            F.when(empty_buf, para).otherwise(F.concat(acc["buf"], F.lit("\n\n"), para)),
            acc["start"],
            acc["pos"],
            cursor,
            F.when(empty_buf, src).otherwise(acc["from_char"]),
            src + n,
        )
        flushed = F.when(empty_buf, acc["out"]).otherwise(F.concat(acc["out"], F.array(flush(acc))))
        start = F.when(empty_buf, acc["start"]).otherwise(
            F.greatest(F.lit(0), acc["start"] + held - overlap)
        )
        oversize = state(
            F.concat(flushed, windows(acc, para, src)),
            F.lit(""),
            start,
            acc["pos"] + n + join_len,
            cursor,
            F.lit(0),
            F.lit(0),
        )
        restarted = state(flushed, para, start, acc["pos"] + n + join_len, cursor, src, src + n)
        return (
            F.when(n == 0, skipped).when(fits, merged).when(n > size, oversize).otherwise(restarted)
        )

    def with_out(out: Column, acc: Column) -> Column:
        return state(out, acc["buf"], acc["start"], acc["pos"], acc["cursor"], acc["from_char"], acc["to_char"])

    def over_block(acc: Column, block: Column) -> Column:
        own = F.aggregate(block, with_out(F.array(), acc), step_over)
        return bind(own, lambda done: with_out(F.concat(acc["out"], done["out"]), done))

    def folded(paragraphs: Column) -> Column:
        count = F.ceil(F.size(paragraphs) / _PARAGRAPHS).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), count - 1), lambda b: F.slice(paragraphs, b * _PARAGRAPHS + 1, F.lit(_PARAGRAPHS))
        )
        return F.aggregate(
            blocks,
            initial,
            over_block,
            lambda acc: F.when(acc["buf"] == "", acc["out"]).otherwise(
                F.concat(acc["out"], F.array(flush(acc)))
            ),
        )

    initial = F.expr(
        f"cast(named_struct('out', array(), 'buf', '', 'start', 0, 'pos', 0, "
        f"'cursor', 0, 'from_char', 0, 'to_char', 0) as {_STATE})"
    )
    return bind(F.split(text, separator), folded)
