"""Retrieval-quality metrics per question, their means, and ranker comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.grounding import faithfulness, head_words
from tessera.functions.text import strip
from tessera.functions.vectors import cosine_similarity

METRICS = ["answer_relevance", "context_precision", "context_recall", "faithfulness"]


def answer_relevance(question_vec: Column, answer_vec: Column, answer: Column) -> Column:
    """Cosine of question and answer, at least 0; 0 for a blank answer."""
    blank = strip(F.coalesce(answer, F.lit(""))) == ""
    return F.when(blank, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), cosine_similarity(question_vec, answer_vec))
    )


def context_recall(best: Column, threshold: float, clamp: bool = False) -> Column:
    """1 from the threshold on, else the share of it that was reached.

    A negative similarity gives a negative value unless ``clamp`` is set.
    """
    value = F.when(best < threshold, F.least(F.lit(1.0), best / threshold)).otherwise(F.lit(1.0))
    value = F.greatest(F.lit(0.0), value) if clamp else value
    return F.coalesce(value, F.lit(0.0))


def score_retrieval(
    questions: DataFrame,
    retrieved: DataFrame,
    precision_threshold: float = config.PRECISION_THRESHOLD,
    recall_threshold: float = config.RECALL_THRESHOLD,
    clamp: bool = False,
) -> DataFrame:
    """Four metrics per question, rounded to 4 digits.

    ``questions``: query_id, answer, question_vec, answer_vec, and optionally
    reference_vec (the answer's vector otherwise) and a group column such as
    source.  ``retrieved``: query_id, chunk_vec and chunk_text_head, at most k rows
    per question.  A question without chunks scores 0 on the context metrics.
    """
    reference = "reference_vec" if "reference_vec" in questions.columns else "answer_vec"
    asked = questions.select(
        "query_id", "question_vec", F.col(reference).alias("_reference"), "answer"
    )
    pairs = retrieved.join(asked, "query_id").select(
        "query_id",
        cosine_similarity(F.col("question_vec"), F.col("chunk_vec")).alias("to_question"),
        cosine_similarity(F.col("_reference"), F.col("chunk_vec")).alias("to_reference"),
        head_words(F.col("chunk_text_head")).alias("words"),
    )
    relevant = (F.round("to_question", 9) >= precision_threshold).cast("double")
    per_question = pairs.groupBy("query_id").agg(
        F.count("*").alias("chunks_retrieved"),
        F.avg(relevant).alias("context_precision"),
        F.max("to_reference").alias("_best"),
        F.array_distinct(F.flatten(F.collect_list("words"))).alias("_words"),
    )
    joined = questions.join(per_question, "query_id", "left")
    relevance = answer_relevance(F.col("question_vec"), F.col("answer_vec"), F.col("answer"))
    recall = context_recall(F.col("_best"), recall_threshold, clamp)
    kept = [c for c in questions.columns if not c.endswith("_vec") and c != "answer"]
    return joined.select(
        *kept,
        F.coalesce("chunks_retrieved", F.lit(0)).alias("chunks_retrieved"),
        F.round(relevance, 4).alias("answer_relevance"),
        F.round(F.coalesce("context_precision", F.lit(0.0)), 4).alias("context_precision"),
        F.round(recall, 4).alias("context_recall"),
        F.round(faithfulness(F.col("answer"), F.col("_words")), 4).alias("faithfulness"),
    )


def mean_scores(scores: DataFrame, *groups: str) -> DataFrame:
    """Means of the already rounded metrics, 4 digits, overall or per group."""
    # Decimals add up exactly, so the mean does not depend on the order of the rows.
    means = [
        F.round(F.avg(F.col(m).cast("decimal(12,4)")), 4).cast("double").alias(m) for m in METRICS
    ]
    return scores.groupBy(*groups).agg(F.count("*").alias("n_questions"), *means)


def compare_rankers(
    ranked: DataFrame, relevant: DataFrame, precision_at: int = 5, recall_at: int = 10
) -> DataFrame:
    """Mean precision@p and recall@r per ranker.

    ``ranked``: ranker, query_id, item_id, rank.  ``relevant``: query_id, item_id,
    one row per relevant pair.  Queries without a relevant item are left out.
    """
    wanted = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    hits = ranked.join(relevant.withColumn("hit", F.lit(1)), ["query_id", "item_id"], "left")
    near = lambda n: F.sum(
        F.when((F.col("rank") <= n) & F.col("hit").isNotNull(), 1).otherwise(0)
    )
    per_query = hits.groupBy("ranker", "query_id").agg(
        near(precision_at).alias("p_hits"), near(recall_at).alias("r_hits")
    )
    return (
        per_query.join(wanted, "query_id")
        .groupBy("ranker")
        .agg(
            F.count("*").alias("n_queries"),
            F.round(F.avg(F.col("p_hits") / precision_at), 4).alias("precision_at_k"),
            F.round(F.avg(F.col("r_hits") / F.col("n_relevant")), 4).alias("recall_at_k"),
        )
    )
