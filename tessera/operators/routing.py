"""Question routing and the single bounded retry pass."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import questions as q


def route(questions: DataFrame, question_col: str = "question") -> DataFrame:
    """Adds ``intent`` and ``augmented_question``."""
    routed = questions.withColumn("intent", q.intent(F.col(question_col)))
    return routed.withColumn(
        "augmented_question", q.augmented_question(F.col(question_col), F.col("intent"))
    )


def plan_retry(answered: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Adds ``is_poor``, ``retry_count`` (0 or 1) and the question to retry with."""
    poor = q.is_poor_answer(F.col(answer_col))
    planned = answered.withColumn("is_poor", poor).withColumn("retry_count", poor.cast("int"))
    return planned.withColumn(
        "retry_question", F.when(F.col("is_poor"), q.fallback_question(F.col("augmented_question")))
    )


def retrieve_with_retry(
    questions: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    id_col: str = "query_id",
    question_col: str = "question",
    answer_col: str = "answer",
) -> DataFrame:
    """Final ranked rows after at most one second pass.

    ``retrieve`` maps ``(query_id, query_text)`` to ranked rows with query_id.
    Accepted questions keep the rows of the first pass; poor ones get the rows of
    a second retrieval with the fallback question.  A second pass only sees the
    flagged rows.
    """
    planned = plan_retry(route(questions, question_col), answer_col)
    accepted = planned.where(~F.col("is_poor"))
    poor = planned.where(F.col("is_poor"))
    first = retrieve(accepted.select(id_col, F.col("augmented_question").alias("query_text")))
    second = retrieve(poor.select(id_col, F.col("retry_question").alias("query_text")))
    return first.withColumn("retry_count", F.lit(0)).unionByName(
        second.withColumn("retry_count", F.lit(1))
    )
