"""Question routing and the retry rule, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import strip, words


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def intent(
    question: Column,
    multi_hop_words: Sequence[str] = tuple(config.MULTI_HOP_WORDS),
    ambiguous_words: Sequence[str] = tuple(config.AMBIGUOUS_WORDS),
) -> Column:
    """``multi_hop``, ``ambiguous`` or ``factual``; punctuation stays on the words."""
    ws = words(F.lower(question))
    short = F.size(ws) <= config.AMBIGUOUS_MAX_WORDS
    return (
        F.when(F.arrays_overlap(ws, _literals(multi_hop_words)), F.lit("multi_hop"))
        .when(short & F.arrays_overlap(ws, _literals(ambiguous_words)), F.lit("ambiguous"))
        .otherwise(F.lit("factual"))
    )


def augmented_question(question: Column, intent_col: Column) -> Column:
    q = strip(question)
    return F.when(intent_col == "ambiguous", F.concat(F.lit(config.REWRITE_PREFIX), q)).otherwise(q)


def is_poor_answer(answer: Column, phrases: Sequence[str] = tuple(config.REFUSAL_PHRASES)) -> Column:
    """Too short, or it contains a refusal phrase."""
    text = F.coalesce(answer, F.lit(""))
    refused = F.lit(False)
    for phrase in phrases:
        refused = refused | F.contains(F.lower(text), F.lit(phrase))
    return (F.char_length(strip(text)) < config.MIN_ANSWER_CHARS) | refused


def fallback_question(question: Column) -> Column:
    """First word longer than three characters, else the question itself."""
    long_words = F.filter(words(question), lambda w: F.char_length(w) > 3)
    return F.coalesce(F.get(long_words, F.lit(0)), question)
