"""Sentence and word-set arithmetic behind the faithfulness metric."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import head, strip, words


def answer_sentences(answer: Column) -> Column:
    """Pieces between full stops, stripped, longer than ten characters."""
    pieces = F.split(F.translate(answer, "\n", " "), r"\.")
    return F.filter(F.transform(pieces, strip), lambda s: F.char_length(s) > 10)


def sentence_keywords(sentence: Column) -> Column:
    """Distinct lower-cased words longer than four characters."""
    long_words = F.filter(words(sentence), lambda w: F.char_length(w) > 4)
    return F.array_distinct(F.transform(long_words, F.lower))


def head_words(text: Column, n: int = config.EVAL_HEAD_CHARS) -> Column:
    """Distinct lower-cased words of the first ``n`` characters."""
    return F.array_distinct(words(F.lower(head(text, n))))


def is_grounded(keywords: Column, context_words: Column, share: float = config.GROUNDED_SHARE) -> Column:
    """Share of keywords found in the context; a sentence without keywords never is."""
    overlap = F.size(F.array_intersect(keywords, context_words))
    return (F.size(keywords) > 0) & (overlap / F.greatest(F.size(keywords), F.lit(1)) >= share)


def faithfulness(answer: Column, context_words: Column, share: float = config.GROUNDED_SHARE) -> Column:
    """Grounded sentences over all sentences; 0 without sentences or context."""
    sentences = answer_sentences(F.coalesce(answer, F.lit("")))
    grounded = F.filter(sentences, lambda s: is_grounded(sentence_keywords(s), context_words, share))
    return F.when(
        (F.size(sentences) == 0) | context_words.isNull(), F.lit(0.0)
    ).otherwise(F.size(grounded) / F.greatest(F.size(sentences), F.lit(1)))
