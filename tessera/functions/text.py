"""Strings, words and search tokens."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import config


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used.

    Needed inside higher-order functions, where a repeated expression would be
    evaluated again for every element.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


# --- fixed values: characters that end a line ----------------------------------
LINE_END = r"[\n\r\x{0B}\x{0C}\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends (plain ``trim`` only knows the space)."""
    return F.btrim(col, F.lit(config.WHITESPACE))


def words(col: Column) -> Column:
    """Split on runs of white space; an empty or blank string has no words."""
    return F.array_remove(F.split(col, config.WHITESPACE_CLASS + "+"), "")


def tokens(col: Column) -> Column:
    """Search terms: lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), "")


def sanitize_query(col: Column) -> Column:
    """Replace text-query operator characters by spaces, then strip."""
    blanks = " " * len(config.QUERY_OPERATOR_CHARS)
    return strip(F.translate(col, config.QUERY_OPERATOR_CHARS, blanks))


def query_terms(col: Column, stop_words: Sequence[str] | None = None) -> Column:
    """Ordered terms of a text query, optionally without stop words."""
    terms = tokens(sanitize_query(col))
    if stop_words:
        stops = F.array(*[F.lit(w) for w in stop_words])
        terms = F.filter(terms, lambda t: ~F.array_contains(stops, t))
    return terms


def all_terms_query(col: Column, stop_words: Sequence[str] = tuple(config.STOP_WORDS)) -> Column:
    """The AND-joined text form of a query: distinct terms without stop words."""
    return F.array_join(F.array_distinct(query_terms(col, stop_words)), " AND ")


def head(col: Column, n: int) -> Column:
    """First ``n`` characters; NULL becomes the empty string."""
    return F.substring(F.coalesce(col, F.lit("")), 1, n)


def console_head(col: Column, n: int = config.CONSOLE_HEAD_CHARS) -> Column:
    """Single-line head for printing."""
    return F.translate(head(col, n), "\n", " ")


def first_line_title(text: Column, fallback: Column) -> Column:
    """Heading text of the first line; ``fallback`` only where there is no text."""
    line = F.element_at(F.split(text, LINE_END, 2), 1)
    title = strip(F.ltrim(line, F.lit("# ")))
    return F.when(F.length(text) > 0, title).otherwise(fallback)


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))
