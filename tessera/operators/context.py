"""Pack ranked chunks into a bounded context, number citations, render prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import strip, text_or_empty

PROMPT = (
    "Below are numbered passages from a document collection, the closest match on top. "
    "Base every statement on them and name the numbers you used. Should they leave the matter open, "
    "write that it is not in the context.\n\n%s\n\n== Asked ==\n%s\n\n== Reply =="
)


def context_block(number: Column, title: Column, source: Column, url: Column, text: Column) -> Column:
    """``[i] title (source) -- url`` over the text; the url part only if there is one."""
    link = F.when(text_or_empty(url) != "", F.concat(F.lit(" -- "), url)).otherwise(F.lit(""))
    return F.concat(
        F.lit("["), number.cast("string"), F.lit("] "), text_or_empty(title), F.lit(" ("),
        text_or_empty(source), F.lit(")"), link, F.lit("\n"), text_or_empty(text),
    )


def packed_blocks(
    ranked: DataFrame,
    rank_col: str,
    max_chars: int = config.MAX_CONTEXT_CHARS,
    query_col: str = "query_id",
) -> DataFrame:
    """The blocks that fit: the longest prefix of the ranking within the budget.

    Joining blank lines are not counted.  Lengths are positive, so the running sum
    passes the budget once and for all at the first block that does not fit.
    """
    w = Window.partitionBy(query_col).orderBy(rank_col)
    numbered = ranked.withColumn("number", F.row_number().over(w))
    block = context_block(
        F.col("number"), F.col("title"), F.col("source"), F.col("source_url"), F.col("chunk_text_head")
    )
    running = F.sum(F.char_length("block")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        numbered.withColumn("block", block)
        .withColumn("used_chars", running)
        .where(F.col("used_chars") <= max_chars)
    )


def pack_context(
    ranked: DataFrame,
    rank_col: str,
    max_chars: int = config.MAX_CONTEXT_CHARS,
    query_col: str = "query_id",
) -> DataFrame:
    """``(query, context, n_used, used_chars, citations)`` per query with any block."""
    used = packed_blocks(ranked, rank_col, max_chars, query_col)
    one = F.struct(
        F.col("number"),
        text_or_empty(F.col("title")).alias("title"),
        text_or_empty(F.col("source")).alias("source"),
        text_or_empty(F.col("source_url")).alias("source_url"),
        text_or_empty(F.col("doc_id").cast("string")).alias("doc_id"),
        F.col("chunk_index"),
    )
    packed = used.groupBy(query_col).agg(
        F.sort_array(F.collect_list(F.struct("number", "block"))).alias("blocks"),
        F.count("*").alias("n_used"),
        F.max("used_chars").alias("used_chars"),
        F.sort_array(F.collect_list(one)).alias("citations"),
    )
    return packed.select(
        query_col,
        F.array_join(F.col("blocks.block"), "\n\n").alias("context"),
        "n_used",
        "used_chars",
        "citations",
    )


def citations(
    ranked: DataFrame,
    rank_col: str,
    max_chars: int = config.MAX_CONTEXT_CHARS,
    query_col: str = "query_id",
) -> DataFrame:
    """One row per citation of the packed context."""
    return packed_blocks(ranked, rank_col, max_chars, query_col).select(
        query_col,
        "number",
        text_or_empty(F.col("title")).alias("title"),
        text_or_empty(F.col("source")).alias("source"),
        text_or_empty(F.col("source_url")).alias("source_url"),
        text_or_empty(F.col("doc_id").cast("string")).alias("doc_id"),
        "chunk_index",
    )


def render_prompt(context: Column, question: Column) -> Column:
    """Prompt text; NULL where there is no context."""
    filled = F.format_string(PROMPT, context, question)
    return F.when(strip(text_or_empty(context)) != "", filled)


def answer_or_notice(context: Column, answer: Column) -> Column:
    """The given answer, or a fixed notice where no context was found."""
    return F.when(strip(text_or_empty(context)) == "", F.lit(config.NO_CONTEXT_ANSWER)).otherwise(answer)
