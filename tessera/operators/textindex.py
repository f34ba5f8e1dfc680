"""Full-text statistics, term matching and BM25 search on postings.

Asked terms that are few enough (counted, see ``BROADCAST_ROWS``) travel to postings in blocks
of texts (see ``termblocks``), so that a text's scores add up where it lies and a task keeps k
rows a query, however many texts match.  Beyond that postings are rows and both sides are
shuffled by term: a term in many texts, or asked by many queries, is salted on both sides, so
no key has more than a bounded number of postings or queries.

Where the terms of all queries have very many postings together, that join drops candidates by
upper bounds: the rarest terms of a query give a score its k-th best text reaches at least,
and a text that has only terms whose upper bounds together stay below that is no candidate.
The postings of frequent terms are then looked up for the remaining candidates only.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import config
from tessera.functions.text import query_terms, tokens
from tessera.operators import termblocks
from tessera.operators.ranking import top_k_per_key
from tessera.session import written

MATCH_MODES = ("any", "all", "phrase")


#: Columns that searches filter on, kept in an index where the corpus has them.
FILTER_COLUMNS = ("embedding_model_ver", "source")


#: The column of an index whose tokens the terms are, where its texts are kept.
TERMS_TEXT = "terms_text"


class TextStats(NamedTuple):
    """Counts of an index: ``terms`` has term and df, ``totals`` one row of n_docs and total_terms.

    Both may be counted for each embedding_model_ver.
    """

    terms: DataFrame
    totals: DataFrame


def forward_index(
    corpus: DataFrame,
    id_col: str = "chunk_id",
    text_col: str = "text",
    keep: Sequence[str] = FILTER_COLUMNS,
) -> DataFrame:
    """One row per text: its terms in order and their number.  No shuffle.

    Write this out once to search a corpus repeatedly without tokenising again; the
    columns of ``keep`` that there are stay, so that searches can filter on them.
    """
    kept = [c for c in keep if c in corpus.columns and c != id_col]
    return (
        corpus.where(F.col(text_col).isNotNull())
        .select(id_col, *kept, tokens(F.col(text_col)).alias("terms"))
        .withColumn("n_terms", F.size("terms"))
    )


VERSION = "embedding_model_ver"


def postings(index: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """``(term, id, tf, n_terms)``: the inverted form, with the columns searches filter on.

    Store :func:`blocks_of` an index (see ``searchstore``) to search a corpus repeatedly.
    """
    kept = [c for c in FILTER_COLUMNS if c in index.columns and c != id_col]
    return (
        index.select(id_col, "n_terms", *kept, F.explode("terms").alias("term"))
        .groupBy("term", id_col)
        .agg(F.count("*").alias("tf"), *[F.first(c).alias(c) for c in ("n_terms", *kept)])
    )


def _kept(columns: Sequence[str], id_col: str) -> list[str]:
    return [c for c in FILTER_COLUMNS if c in columns and c != id_col]


def _version(columns: Sequence[str], id_col: str) -> str | None:
    return VERSION if VERSION in _kept(columns, id_col) else None


def blocks_of(index: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """:func:`postings` in blocks of texts, each of one version."""
    return termblocks.term_blocks(
        index, id_col, _kept(index.columns, id_col), _version(index.columns, id_col), lambda rows: postings(rows, id_col)
    )


def _rows_of(blocks: DataFrame, id_col: str) -> DataFrame:
    return termblocks.block_rows(blocks, id_col, _kept(blocks.columns, id_col), _version(blocks.columns, id_col))


def text_stats(index: DataFrame, posted: DataFrame, id_col: str = "chunk_id") -> TextStats:
    """The counts a search needs, to be written out beside the postings; by version, if rows have one.

    ``max_tf`` and ``min_terms`` bound what a term can add to any score.
    """
    version = [VERSION] if VERSION in index.columns else []
    if termblocks.is_blocks(posted):
        terms = termblocks.block_terms(posted, _version(posted.columns, id_col))
    else:
        terms = posted.groupBy("term", *version).agg(
            F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"), F.min("n_terms").alias("min_terms")
        )
    totals = index.groupBy(*version).agg(F.count("*").alias("n_docs"), F.sum("n_terms").alias("total_terms"))
    return TextStats(terms, totals)


def of_version(stats: TextStats, model_ver: str | None) -> TextStats:
    """The counts of one version, or of all versions together."""
    terms, totals = stats
    if VERSION in terms.columns:
        if model_ver is not None:
            terms, totals = (df.where(F.col(VERSION) == model_ver) for df in stats)
        terms = terms.groupBy("term").agg(
            F.sum("df").alias("df"), F.max("max_tf").alias("max_tf"), F.min("min_terms").alias("min_terms")
        )
        totals = totals.agg(F.sum("n_docs").alias("n_docs"), F.sum("total_terms").alias("total_terms"))
    return TextStats(terms, totals)


def term_stats(index: DataFrame) -> DataFrame:
    """Document frequency and collection frequency of every term.

    One shuffle of map-side sums; a hot term costs one row per map task.
    """
    once = F.transform(
        F.array_distinct("terms"),
        lambda t: F.struct(t.alias("term"), F.lit(1).alias("df"), F.lit(0).alias("cf")),
    )
    each = F.transform(
        "terms", lambda t: F.struct(t.alias("term"), F.lit(0).alias("df"), F.lit(1).alias("cf"))
    )
    return (
        index.select(F.inline(F.concat(once, each)))
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
    )


def document_frequency(index: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """``(term, df)``, optionally for the terms of ``vocabulary`` only."""
    terms = index.select(F.explode(F.array_distinct("terms")).alias("term"))
    if vocabulary is not None:
        terms = terms.join(vocabulary, "term", "left_semi")
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(index: DataFrame) -> DataFrame:
    """One row: number of texts and their mean length in terms."""
    return index.agg(
        F.count("*").alias("n_docs"), F.sum("n_terms").alias("total_terms")
    ).withColumn("avg_terms", F.col("total_terms") / F.greatest(F.col("n_docs"), F.lit(1)))


def weighted_terms(
    queries: DataFrame,
    posted: DataFrame,
    totals: DataFrame,
    query_col: str,
    text_col: str,
    stop_words: Sequence[str] | None,
    terms: DataFrame | None,
    k1: float,
    b: float,
) -> DataFrame:
    """A row for each distinct term of a query: its weight, its upper bound, and counts.

    Stop words carry no weight.  Counts come from ``terms``, or from the postings of the
    asked terms only.  A query without any term drops out, so it has no results.  A term's
    upper bound is its weight at its highest frequency in the shortest text that has it.
    """
    asked = F.array_distinct(query_terms(F.col(text_col), stop_words))
    wanted = queries.select(query_col, F.explode(asked).alias("term")).distinct()
    if terms is None:
        known = posted.join(wanted.select("term").distinct(), "term", "left_semi")
        terms = known.groupBy("term").agg(
            F.count("*").alias("df"), F.max("tf").alias("max_tf"), F.min("n_terms").alias("min_terms")
        )
    df, n_docs = F.coalesce("df", F.lit(0)), F.coalesce("n_docs", F.lit(0))
    mean = F.coalesce(F.col("total_terms") / F.greatest(F.col("n_docs"), F.lit(1)), F.lit(0.0))
    idf = F.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    each = Window.partitionBy(query_col)
    weighted = (
        wanted.join(terms.select("term", "df", "max_tf", "min_terms"), "term", "left")
        .join(F.broadcast(totals.select("n_docs", "total_terms")))  # one row
        .select(query_col, "term", df.alias("df"), idf.alias("idf"), mean.alias("avg_terms"), "max_tf", "min_terms")
    )
    most = F.coalesce(F.col("idf") * saturation(F.col("max_tf"), F.col("min_terms"), F.col("avg_terms"), k1, b), F.lit(0.0))
    return weighted.select(
        query_col, "term", "df", "idf", "avg_terms", most.alias("most"), F.count("*").over(each).alias("n_asked")
    )


def saturation(tf: Column, n_terms: Column, avg_terms: Column, k1: float, b: float) -> Column:
    """What a term's frequency in a text counts, at most k1 + 1."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n_terms / F.greatest(avg_terms, F.lit(1e-9))))


def term_matches(
    posted: DataFrame, asked: DataFrame, id_col: str, query_col: str, k1: float, b: float, few: bool,
    max_queries: int = config.QUERY_BLOCK_ROWS, max_postings: int = config.POSTINGS_PER_KEY,
) -> DataFrame:
    """``(query, id, score, matched)`` summed over the asked terms a text has.

    With ``few`` asked terms these are broadcast.  Otherwise the vocabulary of the queries
    meets the postings first, one row for each term, and a key of the second join holds at
    most about ``max_postings`` postings and ``max_queries`` queries, however frequent the
    term is on either side.
    """
    rows = posted.select("term", id_col, "tf", "n_terms")
    told = asked.where("df > 0").select(query_col, "term", "df", "idf", "avg_terms")
    score = F.col("idf") * saturation(F.col("tf"), F.col("n_terms"), F.col("avg_terms"), k1, b)
    if few:
        known = rows.join(F.broadcast(told.select("term").distinct()), "term", "left_semi").repartition(id_col)
        met = known.join(F.broadcast(told), "term")
    else:
        counts = told.groupBy("term").agg(
            F.ceil(F.max("df") / max_postings).cast("int").alias("shards"),
            F.ceil(F.count("*") / max_queries).cast("int").alias("groups"),
        )
        rows = rows.join(counts, "term").withColumn("shard", F.pmod(F.xxhash64(id_col), F.col("shards")).cast("int"))
        rows = rows.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("shards", "groups")
        dealt = told.join(counts, "term").withColumn("group", F.pmod(F.xxhash64(query_col), F.col("groups")).cast("int"))
        dealt = dealt.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards", "groups")
        met = rows.join(dealt, ["term", "shard", "group"])
    return met.groupBy(query_col, id_col).agg(F.sum(score).alias("score"), F.count("*").alias("matched"))


def completed(
    posted: DataFrame, candidates: DataFrame, rest: DataFrame, id_col: str, query_col: str, k1: float, b: float
) -> DataFrame:
    """Candidates with the scores of their other asked terms: an equi-join on term and text."""
    looked_up = candidates.select(query_col, id_col).join(rest.select(query_col, "term", "idf", "avg_terms"), query_col)
    score = F.col("idf") * saturation(F.col("tf"), F.col("n_terms"), F.col("avg_terms"), k1, b)
    more = (
        looked_up.join(posted.select("term", id_col, "tf", "n_terms"), ["term", id_col])
        .groupBy(query_col, id_col)
        .agg(F.sum(score).alias("more"), F.count("*").alias("also"))
    )
    return candidates.join(more, [query_col, id_col], "left").select(
        query_col,
        id_col,
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
        (F.col("matched") + F.coalesce("also", F.lit(0))).alias("matched"),
    )


def _counted(weighted: DataFrame) -> tuple[DataFrame, int, int]:
    """The asked terms, written once, their number, and that of their postings."""
    weighted = written(weighted, "asked-terms")
    told = weighted.agg(F.count("*").alias("n"), F.coalesce(F.sum("df"), F.lit(0)).alias("matches")).first()
    return weighted, told["n"], told["matches"]


def _rarest(weighted: DataFrame, query_col: str, postings_wanted: int) -> DataFrame:
    """The rarest terms of each query, until they have so many postings together."""
    rare = Window.partitionBy(query_col).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    found = weighted.where("df > 0").withColumn("_seen", F.coalesce(F.sum("df").over(rare), F.lit(0)))
    return found.where(F.col("_seen") < postings_wanted).drop("_seen")


def _with_reach(weighted: DataFrame, threshold: DataFrame, query_col: str) -> DataFrame:
    """Each term with ``needless``: whether texts that have only such terms stay below the threshold.

    Terms are taken by their upper bounds, the least first; ``left`` is the sum of those of
    all needless terms.  A margin covers rounding of sums.
    """
    line = Window.partitionBy(query_col).orderBy("most", "term")
    reach = F.sum("most").over(line.rowsBetween(Window.unboundedPreceding, 0))
    known = weighted.join(threshold, query_col, "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    needless = reach < F.col("threshold") - 1e-6
    ruled = known.withColumn("needless", needless)
    left = F.sum(F.when(F.col("needless"), F.col("most")).otherwise(0.0)).over(Window.partitionBy(query_col))
    return ruled.withColumn("left", left)


def _has_phrase(candidates: DataFrame, index: DataFrame, queries: DataFrame, id_col: str, query_col: str, text_col: str) -> DataFrame:
    """Candidates whose text has the terms of the query one after another.

    Few candidates go to the texts by broadcast, so that only their texts meet the phrases; where
    an index keeps the texts, terms are made of those of candidates only.
    """
    candidates = written(candidates, "candidates")
    if candidates.count() <= config.BROADCAST_ROWS:
        candidates = F.broadcast(candidates)
    phrase = queries.select(query_col, F.concat(F.lit(" "), F.array_join(query_terms(F.col(text_col)), " "), F.lit(" ")).alias("phrase"))
    kept = TERMS_TEXT if TERMS_TEXT in index.columns else "terms"
    terms = tokens(F.coalesce(kept, F.lit(""))) if kept == TERMS_TEXT else F.col(kept)
    line = F.concat(F.lit(" "), F.array_join(terms, " "), F.lit(" "))
    wanted = index.select(id_col, kept).join(candidates, id_col)
    return wanted.join(phrase, query_col).where(line.contains(F.col("phrase"))).drop("phrase", kept)


def text_search(
    index: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    mode: str = "any",
    id_col: str = "chunk_id",
    query_col: str = "query_id",
    text_col: str = "query_text",
    stop_words: Sequence[str] | None = None,
    model_ver: str | None = None,
    where: Column | None = None,
    stats: TextStats | None = None,
    posted: DataFrame | None = None,
    k1: float = config.BM25_K1,
    b: float = config.BM25_B,
    salts: int = 1,
    max_queries: int = config.QUERY_BLOCK_ROWS,
    max_postings: int = config.POSTINGS_PER_KEY,
    max_matches: int = config.MATCHES_AT_ONCE,
    max_broadcast: int = config.BROADCAST_ROWS,
) -> DataFrame:
    """``(query, id, fts_score, rank)`` by BM25, best first, ties by id.

    ``mode``: any term, all terms, or the terms as a phrase.  ``index`` is a
    :func:`forward_index`, ``posted`` its stored :func:`blocks_of` or :func:`postings` (else
    blocks are made of it).  With ``model_ver`` the search knows the rows of that version only, in its
    statistics and its results; ``where`` only restricts which rows may be returned, by
    columns that the postings have.  ``stats`` are the stored counts of the index.
    At most ``max_broadcast`` asked terms go to the blocks.  With more, or with ``where``, postings
    are joined row by row; upper bounds are used there beyond ``max_matches`` postings of all
    queries' terms, counted once for each query.

    Texts that have all terms are sought among those that have the rarest, where rows are joined;
    a phrase is looked for in those texts only.
    """
    if mode not in MATCH_MODES:
        raise ValueError(f"mode must be one of {MATCH_MODES}")
    if posted is None:
        index = index if model_ver is None else index.where(F.col(VERSION) == model_ver)
        posted = written(blocks_of(index, id_col), "term-blocks")
    elif model_ver is not None:
        index, posted = index.where(F.col(VERSION) == model_ver), posted.where(F.col(VERSION) == model_ver)
    blocks = posted if termblocks.is_blocks(posted) else None
    posted = _rows_of(posted, id_col) if blocks is not None else posted
    terms, totals = (None, corpus_stats(index)) if stats is None else of_version(stats, model_ver)
    weighted = weighted_terms(queries, posted, totals, query_col, text_col, stop_words, terms, k1, b)
    weighted, n_asked, n_matches = _counted(weighted)
    if blocks is not None and where is None and n_asked <= max_broadcast:
        groups, field = _asked_groups(weighted, query_col, max_queries), queries.schema[query_col]
        if mode == "phrase":
            found = termblocks.whole_matches(blocks, groups, id_col, field, k1, b)
            found = _has_phrase(found, index, queries, id_col, query_col, text_col)
        else:
            found = termblocks.best_texts(blocks, groups, id_col, field, k, k1, b, mode == "all")
        return _ranked(found, query_col, id_col, k, salts)
    posted = posted if where is None else posted.where(where)
    limits = {"few": n_asked <= max_broadcast, "max_queries": max_queries, "max_postings": max_postings}
    if mode == "any" and n_matches <= max_matches:
        found = term_matches(posted, weighted, id_col, query_col, k1, b, **limits)
    elif mode == "any":
        first = term_matches(posted, _rarest(weighted, query_col, 4 * k), id_col, query_col, k1, b, **limits)
        kth = top_k_per_key(first, [query_col], [F.desc("score")], k, "_nth", salts).where(F.col("_nth") == k)
        threshold = kth.select(query_col, F.col("score").alias("threshold"))
        ruled = written(_with_reach(weighted, threshold, query_col), "ruled-terms")
        near = term_matches(posted, ruled.where("not needless"), id_col, query_col, k1, b, **limits)
        bounds = ruled.groupBy(query_col).agg(F.max("threshold").alias("threshold"), F.max("left").alias("left"))
        near = near.join(bounds, query_col).where(F.col("score") + F.col("left") >= F.col("threshold") - 1e-6)
        found = completed(posted, near.drop("threshold", "left"), ruled.where("needless"), id_col, query_col, k1, b)
    else:
        rare = Window.partitionBy(query_col).orderBy("df", "term")
        least = Window.partitionBy(query_col)
        ruled = weighted.withColumn("nth", F.row_number().over(rare)).withColumn("least", F.min("df").over(least)).where("least > 0")
        near = term_matches(posted, ruled.where("nth = 1"), id_col, query_col, k1, b, **limits)
        found = completed(posted, near, ruled.where("nth > 1"), id_col, query_col, k1, b)
        whole = ruled.where("nth = 1").select(query_col, "n_asked")
        found = found.join(whole, query_col).where("matched = n_asked").drop("n_asked")
        if mode == "phrase":
            found = _has_phrase(found, index, queries, id_col, query_col, text_col)
    return _ranked(found, query_col, id_col, k, salts)


def _ranked(found: DataFrame, query_col: str, id_col: str, k: int, salts: int) -> DataFrame:
    ranked = top_k_per_key(found, [query_col], [F.round(-F.col("score"), config.RANK_DIGITS), F.col(id_col)], k, "rank", salts)
    return ranked.select(query_col, id_col, F.col("score").alias("fts_score"), "rank")


def _asked_groups(weighted: DataFrame, query_col: str, max_queries: int) -> DataFrame:
    """The asked terms that some text has, in rows of about ``max_queries`` queries."""
    n_queries = weighted.select(query_col).distinct().count()
    return termblocks.asked_groups(weighted.where("df > 0"), query_col, max_queries, n_queries)


def match_counts(
    index: DataFrame,
    queries: DataFrame,
    *,
    id_col: str = "chunk_id",
    query_col: str = "query_id",
    text_col: str = "query_text",
    stop_words: Sequence[str] | None = None,
    stats: TextStats | None = None,
    posted: DataFrame | None = None,
    max_queries: int = config.QUERY_BLOCK_ROWS,
    max_broadcast: int = config.BROADCAST_ROWS,
) -> DataFrame:
    """``(query, mode, n_matches)``: how many texts each match mode finds, for queries that have terms."""
    posted = written(blocks_of(index, id_col), "term-blocks") if posted is None else posted
    blocks = posted if termblocks.is_blocks(posted) else None
    posted = _rows_of(posted, id_col) if blocks is not None else posted
    terms, totals = (None, corpus_stats(index)) if stats is None else of_version(stats, None)
    weighted = weighted_terms(
        queries, posted, totals, query_col, text_col, stop_words, terms, config.BM25_K1, config.BM25_B
    )
    weighted, n_asked, _ = _counted(weighted)
    few = n_asked <= max_broadcast
    asked = weighted.groupBy(query_col).agg(F.max("n_asked").alias("n_asked"))
    if blocks is not None and few:
        groups, field = _asked_groups(weighted, query_col, max_queries), queries.schema[query_col]
        counted = termblocks.counted_matches(blocks, groups, id_col, field)
        whole = termblocks.whole_matches(blocks, groups, id_col, field, config.BM25_K1, config.BM25_B)
    else:
        found = term_matches(posted, weighted, id_col, query_col, config.BM25_K1, config.BM25_B, few, max_queries)
        found = found.join(asked, query_col).withColumn("every", F.col("matched") == F.col("n_asked"))
        counted = found.groupBy(query_col).agg(F.count("*").alias("any"), F.count_if("every").alias("all"))
        whole = found.where("every")
    phrases = _has_phrase(whole.select(query_col, id_col), index, queries, id_col, query_col, text_col)
    phrases = phrases.groupBy(query_col).agg(F.count("*").alias("phrase"))
    modes = F.explode(F.array(*[F.struct(F.lit(m).alias("mode"), F.coalesce(m, F.lit(0)).alias("n_matches")) for m in MATCH_MODES]))
    whole = asked.join(counted, query_col, "left").join(phrases, query_col, "left")
    return whole.select(query_col, modes.alias("row")).select(query_col, "row.mode", "row.n_matches")
