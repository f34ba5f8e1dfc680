import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions import vectors as vector_functions
from tessera.functions.vectors import cosine_similarity, is_valid_vector, require_dimension
from tessera.operators import ann, blockjoin, dense, embedding, fusion, hybrid, ranking, response, searchstore, termblocks, textindex

RNG = np.random.default_rng(7)


def vectors(spark, n, dim=8, start=0):
    m = RNG.normal(size=(n, dim)).round(3)
    rows = [(start + i, [float(x) for x in v]) for i, v in enumerate(m)]
    return rows


def cosine_distance(a, b):
    a, b = np.array(a), np.array(b)
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return 1.0 - (float(a @ b) / n if n else 0.0)


def exact(corpus, queries, k):
    out = {}
    for q, qv in queries:
        ranked = sorted((round(cosine_distance(v, qv), 9), i) for i, v in corpus)[:k]
        out[q] = [i for _, i in ranked]
    return out


def as_lists(rows, query="query_id", item="chunk_id"):
    out = {}
    for r in sorted(rows, key=lambda r: (r[query], r["rank"])):
        out.setdefault(r[query], []).append(r[item])
    return out


CORPUS_DDL, QUERY_DDL = "chunk_id long, embedding array<float>", "query_id long, embedding array<float>"


@pytest.mark.parametrize("max_queries", [1000, 3])
def test_dense_search_equals_brute_force(spark, max_queries):
    corpus = vectors(spark, 300)
    corpus += [(1000 + i, corpus[0][1]) for i in range(200)]  # copies of one vector
    corpus.append((2000, [0.0] * 8))
    queries = vectors(spark, 7) + [(99, corpus[0][1])]
    bad = [(3000, None), (3001, [1.0, 2.0]), (3002, [float("nan")] * 8)]
    c = spark.createDataFrame(corpus + bad, CORPUS_DDL).repartition(5)
    q = spark.createDataFrame(queries, QUERY_DDL)
    got = dense.dense_search(c, q, 6, dim=8, max_queries=max_queries, salts=3)
    assert as_lists(got.collect()) == exact(corpus, queries, 6)


def test_dense_search_filters_before_ranking(spark):
    rows = [(i, v, "v1" if i % 2 else "v2", "a") for i, v in vectors(spark, 40)]
    c = spark.createDataFrame(rows, CORPUS_DDL + ", embedding_model_ver string, source string")
    q = spark.createDataFrame(vectors(spark, 2), QUERY_DDL)
    got = dense.dense_search(c, q, 50, dim=8, model_ver="v1").collect()
    assert {r["chunk_id"] % 2 for r in got} == {1} and len(got) == 40
    assert dense.dense_search(c, q, 5, dim=8, where=F.col("source") == "none").count() == 0


def test_vector_functions(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [2.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])],
        "a array<float>, b array<float>",
    )
    assert [r[0] for r in df.select(cosine_similarity(F.col("a"), F.col("b"))).collect()] == [1, -1, 0]
    checked = spark.createDataFrame([([1.0],), (None,), ([1.0, None],)], "v array<float>")
    assert [r[0] for r in checked.select(is_valid_vector(F.col("v"), 1)).collect()] == [True, False, False]
    with pytest.raises(Exception, match="expected 2 dimensions"):
        checked.limit(1).select(require_dimension(F.col("v"), 2)).collect()
    good, bad = dense.split_invalid(checked, "v", 1)
    assert (good.count(), bad.count()) == (1, 2)


TEXTS = [
    "the pod runs a container", "a pod is scheduled on a node", "node affinity and pod priority",
    "services route traffic to a pod", "kafka topics are split into partitions",
    "pod pod pod", "pod container", "", "container pod runs the", "unrelated words only",
]


def tokenise(t):
    return [w for w in re.split(r"[^\w]+|_", t.lower()) if w]


def bm25(texts, query, mode="any"):
    docs = {i: tokenise(t) for i, t in texts}
    n = len(docs)
    avg = sum(map(len, docs.values())) / n
    terms = list(dict.fromkeys(tokenise(query)))
    scores = {}
    for i, d in docs.items():
        tf = Counter(d)
        hit = [t for t in terms if tf[t]]
        if not hit or (mode != "any" and len(hit) < len(terms)):
            continue
        if mode == "phrase" and f" {' '.join(tokenise(query))} " not in f" {' '.join(d)} ":
            continue
        s = 0.0
        for t in hit:
            df = sum(t in x for x in docs.values())
            idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
            s += idf * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(d) / avg))
        scores[i] = s
    return [i for i, _ in sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))]


@pytest.mark.parametrize("mode", textindex.MATCH_MODES)
@pytest.mark.parametrize("max_queries", [1000, 2])
def test_text_search_equals_brute_force(spark, mode, max_queries):
    texts = list(enumerate(TEXTS * 3))
    asked = [(0, "pod container"), (1, "runs the"), (2, "kafka?"), (3, "nothing here"), (4, " ?! "), (5, "pod")]
    corpus = spark.createDataFrame(texts, "chunk_id long, text string").repartition(4)
    queries = spark.createDataFrame(asked, "query_id long, query_text string")
    index = textindex.forward_index(corpus)
    got = textindex.text_search(index, queries, 7, mode=mode, max_queries=max_queries)
    want = {q: bm25(texts, t, mode)[:7] for q, t in asked}
    assert as_lists(got.collect()) == {q: ids for q, ids in want.items() if ids}
    counts = textindex.match_counts(index, queries, max_queries=max_queries).collect()
    for r in counts:
        if r["mode"] == mode:
            assert r["n_matches"] == len(bm25(texts, dict(asked)[r["query_id"]], mode))


@pytest.mark.parametrize("limits", [{"max_matches": 0}, {"max_broadcast": 0}, {"max_matches": 0, "max_broadcast": 0, "max_postings": 3, "max_queries": 2}])
def test_every_way_of_the_term_join_finds_the_same(spark, folder, limits):
    """Upper bounds, and terms salted on both sides, against all texts scored by hand."""
    words = [f"w{i}" for i in range(40)]
    texts = [(i, " ".join(RNG.choice(words[: 5 + i % 36], 4 + i % 9)) + " all" * (i % 3)) for i in range(250)]
    asked = [(q, " ".join(RNG.choice(words, 6, replace=False)) + " all") for q in range(12)] + [(99, "all"), (100, "none")]
    corpus = spark.createDataFrame(texts, "chunk_id long, text string").repartition(4)
    queries = spark.createDataFrame(asked, "query_id long, query_text string")
    searchstore.write_search_tables(corpus, folder + "/tables", 8)
    tables = searchstore.read_search_tables(spark, folder + "/tables")
    got = textindex.text_search(tables.index, queries, 5, stats=tables.stats, posted=tables.postings, **limits)
    assert as_lists(got.collect()) == {q: ids for q, t in asked if (ids := bm25(texts, t)[:5])}


def test_bounds_leave_few_candidates(spark):
    """Texts with nothing but a frequent term are never scored in full."""
    texts = [(i, "the " * (1 + i % 4) + (f"rare{i % 7}" if i < 70 else "")) for i in range(2000)]
    index = textindex.forward_index(spark.createDataFrame(texts, "chunk_id long, text string"))
    queries = spark.createDataFrame([(1, "the rare3")], "query_id long, query_text string")
    posted = textindex.postings(index)
    weighted = textindex.weighted_terms(queries, posted, textindex.corpus_stats(index), "query_id", "query_text", None, None, 1.2, 0.75)
    first = textindex.term_matches(posted, textindex._rarest(weighted, "query_id", 8), "chunk_id", "query_id", 1.2, 0.75, True)
    kth = ranking.top_k_per_key(first, ["query_id"], [F.desc("score")], 2, "nth").where("nth = 2")
    ruled = textindex._with_reach(weighted, kth.select("query_id", F.col("score").alias("threshold")), "query_id")
    assert {r["term"]: r["needless"] for r in ruled.collect()} == {"the": True, "rare3": False}


def test_search_of_a_version_uses_its_own_counts(spark, folder):
    texts = [(i, t, "v1" if i % 2 else "v2") for i, t in enumerate(TEXTS * 2)]
    corpus = spark.createDataFrame(texts, "chunk_id long, text string, embedding_model_ver string")
    searchstore.write_search_tables(corpus, folder + "/tables", 8)
    tables = searchstore.read_search_tables(spark, folder + "/tables")
    queries = spark.createDataFrame([(1, "pod container"), (2, "runs the")], "query_id long, query_text string")
    for version in ("v1", "v2"):
        own = [(i, t) for i, t, v in texts if v == version]
        got = textindex.text_search(tables.index, queries, 9, model_ver=version, stats=tables.stats, posted=tables.postings)
        want = {q: bm25(own, t)[:9] for q, t in ((1, "pod container"), (2, "runs the"))}
        assert as_lists(got.collect()) == {q: ids for q, ids in want.items() if ids}


def test_searches_send_no_queries_through_the_driver(spark, monkeypatch):
    """With a query table larger than the driver may take in, and blocks of one row."""
    rows = vectors(spark, 200, 64)
    c = spark.createDataFrame(rows, CORPUS_DDL)
    q = spark.createDataFrame(vectors(spark, 400, 64), QUERY_DDL)
    for name in ("collect", "toArrow", "toPandas", "toLocalIterator", "first", "head", "take"):
        monkeypatch.setattr(type(c), name, lambda *a, name=name, **b: pytest.fail(f"{name} while a plan is built"))
    found = dense.dense_search(c, q, 3, dim=64, max_queries=1)
    assert found.count() == 1200


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_block_pairs_meet_by_broadcast_and_by_shuffle(spark, threshold):
    corpus, queries = vectors(spark, 500), vectors(spark, 40)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        c, q = spark.createDataFrame(corpus, CORPUS_DDL).repartition(6), spark.createDataFrame(queries, QUERY_DDL).repartition(3)
        assert as_lists(dense.dense_search(c, q, 4, dim=8, max_queries=5).collect()) == exact(corpus, queries, 4)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_few_queries_go_to_the_corpus(spark, monkeypatch):
    """The corpus is not shuffled for few queries; many meet it by group, and find the same."""
    corpus, queries = vectors(spark, 500), vectors(spark, 40)
    c, q = spark.createDataFrame(corpus, CORPUS_DDL).repartition(6), spark.createDataFrame(queries, QUERY_DDL)
    few = dense.dense_search(c, q, 4, dim=8, max_queries=5)
    assert "BroadcastNestedLoopJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(blockjoin, "BROADCAST_BYTES", 0)
    many = dense.dense_search(c, q, 4, dim=8, max_queries=5)
    assert "BroadcastNestedLoopJoin" not in many._jdf.queryExecution().executedPlan().toString()
    assert as_lists(few.collect()) == as_lists(many.collect()) == exact(corpus, queries, 4)


@pytest.mark.parametrize("kind, size", [("float", 4), ("double", 8)])
def test_vectors_travel_in_their_own_type(spark, kind, size):
    """A block of floats takes four bytes a number, and is scaled to length 1 where it is compared."""
    corpus = [(i, [x * 10.0**(i % 5) for x in v]) for i, v in vectors(spark, 90)] + [(500, [0.0] * 8)]
    c = spark.createDataFrame(corpus, f"chunk_id long, embedding array<{kind}>").repartition(3)
    block = blockjoin.packed(c, "chunk_id", "embedding", 8)
    assert all(len(r["vectors"]) == size * 8 * len(r["ids"]) for r in block.collect())
    queries = vectors(spark, 5, start=900)
    for other in ("float", "double"):
        q = spark.createDataFrame(queries, f"query_id long, embedding array<{other}>")
        found = dense.dense_search(c, q, 7, dim=8).collect()
        assert as_lists(found) == exact(corpus, queries, 7)
        own = dict(corpus)
        assert all(abs(r["distance"] - cosine_distance(own[r["chunk_id"]], queries[r["query_id"] - 900][1])) < 1e-6 for r in found)


@pytest.mark.parametrize("n, parts, batch, asked", [(300, 5, 7, 40), (300, 1, 10000, 70), (3, 8, 1, 5), (0, 2, 5, 5), (40, 3, 4, 0)])
def test_few_queries_meet_rows_once(spark, n, parts, batch, asked, monkeypatch):
    """A task's first row is one row, however many blocks of queries and Arrow batches there are."""
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        corpus, queries = vectors(spark, n), vectors(spark, asked, start=900)
        c = spark.createDataFrame(corpus + [(5000, None), (5001, [1.0])], CORPUS_DDL).repartition(parts)
        q = spark.createDataFrame(queries, QUERY_DDL).repartition(1)
        found = dense.dense_search(c, q, 400, dim=8, max_queries=1)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 2  # packing of queries, search: rows are not packed before
        assert as_lists(found.collect()) == {q: ids for q, ids in exact(corpus, queries, 400).items() if ids}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_postings_lie_in_blocks_of_texts(spark, folder, monkeypatch):
    """Stored postings are whole texts' lists, as many rows as blocks, and equal to the postings by row."""
    monkeypatch.setattr(termblocks.term_blocks, "__defaults__", (7,))
    texts = [(i, f"all w{i % 5} w{i % 3} " + "all " * (i % 4), "v1" if i % 3 else None, f"s{i % 2}") for i in range(60)] + [(60, "", "v1", None)]
    corpus = spark.createDataFrame(texts, "chunk_id long, text string, embedding_model_ver string, source string").repartition(2)
    searchstore.write_search_tables(corpus, folder + "/tables", 8)
    tables = searchstore.read_search_tables(spark, folder + "/tables")
    assert termblocks.is_blocks(tables.postings) and 9 <= tables.postings.count() < 30
    names = ["term", "chunk_id", "tf", "n_terms", "embedding_model_ver", "source"]
    rows = textindex._rows_of(tables.postings, "chunk_id").select(names)
    want = textindex.postings(tables.index).select(names)
    assert sorted(map(str, rows.collect())) == sorted(map(str, want.collect()))
    names = ["term", "df", "cf", "max_tf", "min_terms"]
    counted = textindex.text_stats(tables.index, want)
    for version in ("v1", None):
        of = [textindex.of_version(s, version).terms for s in (tables.stats, counted)]
        assert sorted(map(str, of[0].collect())) == sorted(map(str, of[1].collect()))


def test_lists_of_a_block_are_one_small_value(spark, folder, monkeypatch):
    """Readers hold few blocks at once, and the lists of a block closed."""
    monkeypatch.setattr(termblocks.term_blocks, "__defaults__", (5,))
    texts = [(i, f"all w{i % 5} " + "all " * (i % 300)) for i in range(200)]
    corpus = spark.createDataFrame(texts, "chunk_id long, text string").repartition(1)
    searchstore.write_search_tables(corpus, folder + "/tables", 8)
    kinds = dict(searchstore.read_search_tables(spark, folder + "/tables").postings.dtypes)
    assert kinds == {"chunk_id": "array<bigint>", "n_terms": "array<int>", "lists": "binary"}
    for path in Path(folder).glob("tables/postings/*.parquet"):
        groups = pq.ParquetFile(path).metadata
        assert all(groups.row_group(i).num_rows <= searchstore.GROUP_BLOCKS for i in range(groups.num_row_groups))


@pytest.mark.parametrize("repeats", [1, 2])
def test_terms_are_made_of_the_stored_texts(spark, folder, repeats):
    """The chunks are stored without their terms, and every way of the search finds the same."""
    texts = [(i, TEXTS[i % len(TEXTS)]) for i in range(30)]
    corpus = spark.createDataFrame(texts + [(30, None), (31, "")], "chunk_id long, text string")
    for i in range(1, repeats):
        corpus = corpus.unionByName(corpus.where("chunk_id = 3").withColumn("text", F.lit(f"again {i}")))
    searchstore.write_search_tables(corpus, folder + "/tables", 8)
    assert "terms" not in pq.read_schema(next(Path(folder).glob("tables/chunks/*.parquet"))).names
    tables = searchstore.read_search_tables(spark, folder + "/tables")
    own = textindex.forward_index(corpus.fillna(""))
    made = [i.select("chunk_id", "terms", "n_terms").collect() for i in (tables.index, own)]
    assert sorted(map(str, made[0])) == sorted(map(str, made[1]))
    queries = spark.createDataFrame([(1, "pod container"), (2, "runs the"), (3, "pod")], "query_id long, query_text string")
    for mode in textindex.MATCH_MODES:
        stored = textindex.text_search(tables.index, queries, 9, mode=mode, stats=tables.stats, posted=tables.postings)
        assert as_lists(stored.collect()) == as_lists(textindex.text_search(own, queries, 9, mode=mode).collect())


def test_texts_are_not_shuffled_to_look_for_phrases(spark):
    """Few candidates go to the texts, also where Spark would not broadcast by size."""
    index = textindex.forward_index(spark.createDataFrame([(i, f"a b c{i % 9}") for i in range(90)], "chunk_id long, text string"))
    queries = spark.createDataFrame([(1, "b c3"), (2, "c4 a"), (3, "a b")], "query_id long, query_text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = textindex.text_search(index, queries, 90, mode="phrase")
        assert "hashpartitioning(chunk_id" not in found._jdf.queryExecution().executedPlan().toString()
        assert Counter(r["query_id"] for r in found.collect()) == {1: 10, 3: 90}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("n", [0, 1, 9, 70_000])
def test_lists_open_as_they_were_closed(n):
    """Also with more texts than 16 bits tell apart, and high frequencies."""
    slots = np.r_[np.arange(n), np.arange(0, n, 3)]
    starts, tfs = np.array([0, n, len(slots)]), 1 + slots % 400
    value = pa.array([termblocks._closed(pa.array(["a", "b"]), starts, slots, tfs, n)], pa.binary())[0]
    words, *lists = termblocks._opened(value)
    assert words.to_pylist() == ["a", "b"]
    assert [x.to_pylist() for x in lists] == [x.tolist() for x in (starts, slots, tfs)]


def test_terms_are_counted_in_bounded_parts(monkeypatch):
    """Long lists, empty ones and many short ones give the same vectors whatever is counted at once."""
    lists = pa.array([[f"w{i * j % 50}" for j in range(i % 9 if i % 7 else 40)] for i in range(200)])
    whole = vector_functions._term_counts(lists, 8)
    count, parts = np.bincount, []
    monkeypatch.setattr(vector_functions, "TERMS_AT_ONCE", 16)
    monkeypatch.setattr(np, "bincount", lambda x, **b: parts.append(len(x)) or count(x, **b))
    assert vector_functions._term_counts(lists, 8).equals(whole)
    assert 0 < max(parts) <= 16


@pytest.mark.parametrize("mode", textindex.MATCH_MODES)
def test_rows_with_one_id_are_one_text(spark, mode):
    """By blocks and by rows, also with a filter, which only rows know."""
    texts = [(i % 30, f"a b c{i % 30} " + "a " * (i % 30 % 5), f"s{i % 2}") for i in range(45)] + [(None, "a b", "s0")] * 2 * (mode != "all")
    corpus = spark.createDataFrame(texts, "chunk_id long, text string, source string").repartition(3)
    queries = spark.createDataFrame([(1, "a b"), (2, "c3 c4 a"), (3, "b c7")], "query_id long, query_text string")
    index = textindex.forward_index(corpus)
    found = [textindex.text_search(index, queries, 40, mode=mode, posted=p) for p in (None, textindex.postings(index))]
    found.append(textindex.text_search(index, queries, 40, mode=mode, where=F.col("source").isNotNull()))
    lists = [{(r["query_id"], r["chunk_id"], r["rank"], round(r["fts_score"], 9)) for r in f.collect()} for f in found]
    assert lists[0] and lists[0] == lists[1] == lists[2]
    counts = [{tuple(r) for r in textindex.match_counts(index, queries, posted=p).collect()} for p in (None, textindex.postings(index))]
    assert counts[0] == counts[1]


def test_search_over_an_empty_corpus_or_without_queries(spark):
    empty = spark.createDataFrame([], "chunk_id long, text string")
    one = spark.createDataFrame([(1, "a")], "query_id long, query_text string")
    assert textindex.text_search(textindex.forward_index(empty), one, 3).count() == 0
    full = spark.createDataFrame([(1, "a b")], "chunk_id long, text string")
    index = textindex.forward_index(full)
    assert textindex.text_search(index, one.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        textindex.text_search(index, one, 3, mode="near")


def test_postings_and_stats_agree(spark):
    corpus = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_id long, text string")
    index = textindex.forward_index(corpus)
    from_postings = textindex.postings(index).groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("cf"))
    want = {tuple(r) for r in from_postings.collect()}
    assert {tuple(r) for r in textindex.term_stats(index).collect()} == want


def ranked(spark, ids, query=1):
    rows = [(query, c, i + 1, f"meta-{c}") for i, c in enumerate(ids)]
    return spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, title string")


def fused(spark, a, b, k=3):
    out = fusion.reciprocal_rank_fusion(ranked(spark, a), ranked(spark, b), k)
    return [(r["chunk_id"], r["rrf_score"]) for r in out.orderBy("rrf_rank").collect()]


def test_rrf_golden(spark):
    assert fused(spark, "abc", "bad") == [("a", 0.032522), ("b", 0.032522), ("c", 0.015873)]
    assert [c for c, _ in fused(spark, "xy", "", 2)] == ["x", "y"]
    assert [c for c, _ in fused(spark, "", "xy", 2)] == ["x", "y"]
    assert len(fused(spark, "abcdefghij", "klmnopqrst")) == 3
    assert fused(spark, "a", "a", 1) == [("a", round(2 / 61, 6))]


def test_rrf_takes_columns_of_the_dense_row(spark):
    text = ranked(spark, "ab").withColumn("title", F.lit("text"))
    out = fusion.reciprocal_rank_fusion(ranked(spark, "a"), text, 5).collect()
    assert {r["chunk_id"]: r["title"] for r in out} == {"a": "meta-a", "b": "text"}


def test_list_fusion_matches_the_pair_form(spark):
    lists = [ranked(spark, "abc"), ranked(spark, "bad")]
    out = fusion.fuse_lists(lists, 3).orderBy("rrf_rank").collect()
    assert [(r["chunk_id"], r["rrf_score"]) for r in out] == fused(spark, "abc", "bad")


def test_hybrid_attach_and_response(spark):
    rows = [(f"d{i}::0", f"d{i}", "src", 0, None, None, t) for i, t in enumerate(TEXTS)]
    chunks = spark.createDataFrame(
        rows, "chunk_id string, doc_id string, source string, chunk_index int, title string, "
        "source_url string, text string")
    asked = spark.createDataFrame([(1, "pod container"), (2, "zzz")], "query_id int, query_text string")
    vecs = embedding.hash_embed(chunks.select("chunk_id", "text"), F.col("text"), 32)
    index = textindex.forward_index(chunks)
    queries = embedding.hash_embed(asked, F.col("query_text"), 32)
    fused_rows = hybrid.hybrid_search(vecs, index, queries, 3, dim=32)
    found = hybrid.attach_chunks(fused_rows, chunks)
    out = {r["query_id"]: r for r in response.search_response(found, asked, "hybrid", "rrf_rank").collect()}
    assert out[1]["results"][0]["chunk_id"] == "d6::0" and len(out[1]["results"]) == 3
    assert out[1]["mode"] == "hybrid" and out[1]["query"] == "pod container"
    lines = response.to_json_lines(spark.createDataFrame([(1, "é")], "a int, b string")).collect()
    assert lines[0]["value"] == '{"a":1,"b":"é"}'


def test_response_scores(spark):
    df = spark.createDataFrame([(0.18804, None), (None, 0.032522)], "distance double, rrf_score double")
    dense_scores = df.select(response.response_score("dense", distance=F.col("distance"))).collect()
    assert [r[0] for r in dense_scores] == [0.812, 1.0]
    fused_scores = df.select(response.response_score("hybrid", F.col("rrf_score"))).collect()
    assert [r[0] for r in fused_scores] == [0.0, 0.0325]
    empty = spark.createDataFrame(
        [], "query_id int, chunk_id string, doc_id string, source string, chunk_index int, title string, "
        "source_url string, chunk_text_head string, distance double, rank int")
    asked = spark.createDataFrame([(1, "q")], "query_id int, query_text string")
    assert response.search_response(empty, asked, "dense", "rank").first()["results"] == []
    with pytest.raises(ValueError):
        response.response_score("text")


def test_newest_per_key(spark):
    rows = [("a", 1, 1), ("a", 3, 2), ("a", 3, 1), ("b", None, 1), ("c", None, 2), ("c", 0, 1)]
    df = spark.createDataFrame(rows, "k string, t int, tie int")
    got = ranking.newest_per_key(df, ["k"], "t", [F.col("tie")]).collect()
    assert {tuple(r) for r in got} == {("a", 3, 1), ("b", None, 1), ("c", 0, 1)}
    plan = ranking.newest_per_key(df, ["k"], "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # partial before the shuffle, final after


def test_salted_top_k_is_the_same(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), (F.col("id") * 37 % 1009).alias("v"), "id").repartition(9)
    order = [F.col("v"), F.col("id")]
    plain = ranking.top_k_per_key(df, ["k"], order, 20).collect()
    salted = ranking.top_k_per_key(df, ["k"], order, 20, salts=4).collect()
    assert sorted(plain) == sorted(salted) and len(plain) == 20


def test_embedder_plugin(spark):
    class Lengths:
        model_id, dimension = "lengths", 2

        def embed_batch(self, texts):
            return [[float(len(t)), 1.0] for t in texts]

    assert isinstance(Lengths(), embedding.Embedder)
    df = spark.createDataFrame([(i, "x" * i) for i in range(50)], "id int, text string").repartition(3)
    out = embedding.embed(df, "text", Lengths, 2, batch_size=7).collect()
    assert all(r["embedding"] == [float(r["id"]), 1.0] for r in out) and len(out) == 50
    assert embedding.embed(df.limit(0), "text", Lengths, 2).count() == 0
    with pytest.raises(Exception, match="expected 3 dimensions"):
        embedding.embed(df, "text", Lengths, 3).collect()


def test_hash_embedding_reference(spark):
    from hashlib import md5

    want = [0.0] * 16
    for t in ["pod", "pod", "node"]:
        h = int(md5(t.encode()).hexdigest()[:8], 16)
        want[h % 16] += 1.0 if h < 2**31 else -1.0
    df = spark.createDataFrame([("Pod, pod node",), (None,), ("",)], "t string")
    got = [r["embedding"] for r in embedding.hash_embed(df, F.col("t"), 16).collect()]
    assert got == [want, [0.0] * 16, [0.0] * 16]


def test_ann_reaches_its_target(spark, folder):
    centres = RNG.normal(size=(12, 8)) * 2
    rows = [(i, [float(x) for x in centres[i % 12] + RNG.normal(size=8)]) for i in range(1500)]
    corpus = spark.createDataFrame(rows, CORPUS_DDL).repartition(4)
    asked = spark.createDataFrame(
        [(i, [float(x) for x in centres[i % 12] + RNG.normal(size=8)]) for i in range(40)], QUERY_DDL)
    centers = ann.train_cells(corpus, "embedding", 8, n_cells=12)
    indexed = ann.assign_cells(corpus, "embedding", 8, centers)
    n_probe = ann.tune_probes(spark, indexed, asked, 10, centers=centers, dim=8)
    assert 1 <= n_probe < 12
    ann.write_index(indexed, folder + "/index")
    stored = spark.read.parquet(folder + "/index")
    found = ann.ann_search(stored, asked, 10, centers=centers, n_probe=n_probe, dim=8)
    truth = dense.dense_search(corpus, asked, 10, dim=8)
    report = ann.recall_report(found, truth, "query_id", "chunk_id").first()
    assert report["recall"] >= 0.95 and report["n_queries"] == 40
    every = ann.ann_search(stored, asked, 10, centers=centers, n_probe=12, dim=8)
    assert ann.recall_report(every, truth, "query_id", "chunk_id").first()["recall"] == 1.0
    one = ann.ann_search(stored, asked.limit(1), 5, centers=centers, n_probe=1, dim=8)
    assert one.count() == 5
    split = ann.ann_search(stored, asked, 10, centers=centers, n_probe=n_probe, dim=8, cell_rows=20, max_queries=7)
    assert as_lists(split.collect()) == as_lists(found.collect())
