import json
import os

import pytest
from pyspark.sql import functions as F

from tessera import config
from tessera.operators import (
    context, evaluation, frontier, history, landing, metrics, ordering, routing, stats, upsert,
)
from tessera.plans import inputs, jobs
from tessera.sources import bronze, markdown, store
from tessera.streaming import incremental, request_metrics

DDL = "k string, h string, v int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


TARGET = [("same", "1", 0), ("changed", "1", 0), ("null_t", None, 0), ("null_s", "1", 0), (None, "1", 0)]
SOURCE = [("same", "1", 9), ("changed", "2", 9), ("null_t", "2", 9), ("null_s", None, 9), ("new", "1", 9)]


@pytest.mark.parametrize("bound", [1000, 0])
def test_conditional_upsert(spark, bound):
    t, s = spark.createDataFrame(TARGET, DDL), spark.createDataFrame(SOURCE, DDL)
    once = upsert.upsert(t, s, ["k"], "h")
    want = [("same", "1", 0), ("changed", "2", 9), ("null_t", None, 0), ("null_s", "1", 0), (None, "1", 0),
            ("new", "1", 9)]
    assert rows(once) == sorted(want, key=str)
    assert rows(upsert.upsert(once, s, ["k"], "h")) == sorted(want, key=str)


def test_full_upsert_and_duplicate_keys(spark):
    t, s = spark.createDataFrame(TARGET, DDL), spark.createDataFrame(SOURCE, DDL)
    got = {r["k"]: r["v"] for r in upsert.upsert(t, s, ["k"]).collect()}
    assert got == {None: 0, "same": 9, "changed": 9, "null_t": 9, "null_s": 9, "new": 9}
    with pytest.raises(Exception, match="duplicate source key: same"):
        upsert.upsert(t, s.unionByName(s.where("k = 'same'")), ["k"]).collect()


def test_audit_columns(spark):
    t0, t1 = F.timestamp_seconds(F.lit(10)), F.timestamp_seconds(F.lit(20))
    s = spark.createDataFrame(SOURCE, DDL)
    empty = s.limit(0).withColumn("created_at", t0).withColumn("updated_at", t0)
    first = upsert.upsert_with_audit(empty, s.where("k <> 'new'"), ["k", "h"], t0)
    again = upsert.upsert_with_audit(first, s, ["k", "h"], t1)
    stamps = {r["k"]: (r[0], r[1]) for r in again.select(
        F.unix_seconds("created_at"), F.unix_seconds("updated_at"), "k").collect() if r["k"] != "null_s"}
    assert stamps == {"same": (10, 20), "changed": (10, 20), "null_t": (10, 20), "new": (20, 20)}


def test_skip_landed_is_per_source(spark):
    incoming = spark.createDataFrame([("a", "1"), ("b", "1"), ("a", "2")], "source string, doc_id string")
    landed = spark.createDataFrame([("a", "1", "d1"), ("a", "1", "d2")], "source string, doc_id string, date string")
    assert rows(upsert.skip_landed(incoming, landed)) == [("a", "2"), ("b", "1")]


def test_prune_orphans_leaves_other_documents(spark):
    table = spark.createDataFrame([("d1::0", "d1"), ("d1::1", "d1"), ("d2::5", "d2")], "chunk_id string, doc_id string")
    current = table.where("chunk_id = 'd1::0'")
    kept = upsert.prune_orphans(table, current, ["chunk_id"], "doc_id")
    assert rows(kept.select("chunk_id")) == [("d1::0",), ("d2::5",)]


def test_history(spark):
    v1 = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, v int")
    v2 = spark.createDataFrame([("a", 1), ("b", 2), ("d", 2)], "k string, v int")
    full = history.record_version(history.start_history(v1, 1), v2, ["k"], 2)
    assert rows(history.as_of(full, 1)) == rows(v1) and rows(history.as_of(full, 2)) == rows(v2)
    assert full.where("k = 'a'").count() == 1
    v3 = history.add_columns(v2, language="string").withColumn("language", F.lit("en"))
    wider = history.record_version(full, v3, ["k"], 3)
    assert rows(history.as_of(wider, 3)) == rows(v3)
    assert {r["language"] for r in history.as_of(wider, 1).collect()} == {None}
    changes = history.record_changes(history.start_history(v1, 1), v2.where("k <> 'a'"), ["k"], 2)
    assert rows(history.as_of(changes, 2)) == [("a", 1), ("b", 2), ("c", 1), ("d", 2)]
    versions = history.version_entry(v1, 1, F.timestamp_seconds(F.lit(1)), "append", "start").unionByName(
        history.version_entry(v2, 2, F.timestamp_seconds(F.lit(2)), "overwrite"))
    assert [r["version"] for r in history.recent_versions(versions, 1).collect()] == [2]
    assert tuple(history.oldest_and_newest(versions).first()) == (1, 2, 3, 3)
    assert history.version_by_tag(versions, "start").first()["version"] == 1
    union = history.union_versions(v1, v3)
    assert union.columns == ["k", "v", "language"] and union.count() == 6


def ranked(spark, lengths):
    data = [(1, i + 1, f"d{i}", "t", "s", "u" if i else None, i, "x" * n) for i, n in enumerate(lengths)]
    return spark.createDataFrame(
        data, "query_id int, rank int, doc_id string, title string, source string, source_url string, "
        "chunk_index int, chunk_text_head string")


def test_context_budget(spark):
    df = ranked(spark, [10, 10, 10])
    first = len("[1] t (s)\n") + 10
    second = len("[2] t (s) -- u\n") + 10
    exact = context.pack_context(df, "rank", first + second).first()
    assert (exact["n_used"], exact["used_chars"]) == (2, first + second)
    assert exact["context"] == "[1] t (s)\n" + "x" * 10 + "\n\n[2] t (s) -- u\n" + "x" * 10
    assert [c["number"] for c in exact["citations"]] == [1, 2]
    assert context.pack_context(df, "rank", first + second - 1).first()["n_used"] == 1
    assert context.pack_context(df, "rank", first - 1).count() == 0
    # the first block that does not fit ends it, even if a later one would fit
    assert context.pack_context(ranked(spark, [10, 500, 1]), "rank", 100).first()["n_used"] == 1
    assert [r["source_url"] for r in context.citations(df, "rank").orderBy("number").collect()] == ["", "u", "u"]


def test_prompt_and_notice(spark):
    df = spark.createDataFrame([("ctx", "q", "a"), (" ", "q", "a"), (None, "q", "a")], "c string, q string, a string")
    prompts = [r[0] for r in df.select(context.render_prompt(F.col("c"), F.col("q"))).collect()]
    assert "ctx" in prompts[0] and "== Asked ==\nq\n" in prompts[0] and prompts[1:] == [None, None]
    answers = [r[0] for r in df.select(context.answer_or_notice(F.col("c"), F.col("a"))).collect()]
    assert answers[0] == "a" and answers[1] == answers[2] != "a"


def test_one_retry_at_most(spark):
    asked = spark.createDataFrame(
        [(1, "what is a scheduler", "I don't have enough information."), (2, "what is it", "x" * 40)],
        "query_id int, question string, answer string")
    passes = []

    def retrieve(queries):
        passes.append(queries)
        return queries.select("query_id", F.col("query_text").alias("chunk_id"))

    out = rows(routing.retrieve_with_retry(asked, retrieve))
    assert out == [(1, "what", 1), (2, "explain in detail: what is it", 0)] and len(passes) == 2


def test_evaluation(spark):
    ddl = ("query_id int, answer string, question_vec array<float>, answer_vec array<float>, source string")
    answer = "Pods share networking between containers. Short. Nothing grounded whatsoever here"
    asked = spark.createDataFrame(
        [(1, answer, [1.0, 0.0], [1.0, 1.0], "s"), (2, " ", [1.0, 0.0], [-1.0, 0.0], "s")], ddl)
    got = spark.createDataFrame(
        [(1, [1.0, 0.0], "pods SHARE networking"), (1, [0.0, 1.0], "other"), (2, [1.0, 0.0], "x")],
        "query_id int, chunk_vec array<float>, chunk_text_head string")
    scores = {r["query_id"]: r for r in evaluation.score_retrieval(asked, got).collect()}
    assert (scores[1]["answer_relevance"], scores[1]["context_precision"]) == (0.7071, 0.5)
    assert (scores[1]["context_recall"], scores[1]["faithfulness"]) == (1.0, 0.5)
    assert (scores[2]["answer_relevance"], scores[2]["context_recall"]) == (0.0, -4.0)
    clamped = evaluation.score_retrieval(asked, got, clamp=True).where("query_id = 2").first()
    assert clamped["context_recall"] == 0.0
    none = evaluation.score_retrieval(asked, got.limit(0)).first()
    assert (none["chunks_retrieved"], none["context_precision"], none["faithfulness"]) == (0, 0.0, 0.0)


def test_mean_scores_average_rounded_values(spark):
    data = [(1, "a", 0.50004, 1.0, 1.0, 0.0), (2, "a", 0.6, 0.5, 1.0, 1.0), (3, "b", 0.7, 0.25, -1.0, 1.0)]
    df = spark.createDataFrame(data, "query_id int, source string, " + ", ".join(
        f"{m} double" for m in evaluation.METRICS))
    mean = evaluation.mean_scores(df).first()
    assert tuple(mean) == (3, 0.6, 0.5833, 0.3333, 0.6667)
    by_source = {r["source"]: (r["n_questions"], r["answer_relevance"])
                 for r in evaluation.mean_scores(df, "source").collect()}
    assert by_source == {"a": (2, 0.55), "b": (1, 0.7)}


def test_stats(spark):
    empty = spark.createDataFrame([], "embedding_model_ver string")
    assert rows(stats.version_counts(empty)) == [("_total", 0)]
    some = spark.createDataFrame([("a",), ("a",), ("b",)], "embedding_model_ver string")
    assert rows(stats.version_counts(some)) == rows(stats.version_rollup(some)) == [
        ("_total", 3), ("a", 2), ("b", 1)]
    no_chunks = spark.createDataFrame([], "doc_id string")
    assert tuple(stats.chunk_stats(no_chunks).first()) == (0, 0, 0.0)


def test_histogram_forms(spark):
    log = spark.createDataFrame([("a", 0.05), ("a", 0.06), ("a", 9.0)], "endpoint string, v double")
    long = metrics.histogram_long(log, F.col("v"), [0.05, 1.0], "endpoint").collect()
    assert [(r["le"], r["n"]) for r in long] == [("0.05", 1), ("1.0", 2), ("+Inf", 3)]


def test_walk_stops_and_caps(spark):
    edges = spark.createDataFrame(
        [("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "a", "d"), ("t", "a", "z")],
        "source string, url string, link string")
    seeds = spark.createDataFrame([("s", "a"), ("s", "a")], "source string, url string")
    assert rows(frontier.walk(seeds, edges, 9)) == [("s", "a", 0), ("s", "b", 1), ("s", "c", 2), ("s", "d", 1)]
    assert rows(frontier.walk(seeds, edges, 9, max_pages=2)) == [("s", "a", 0), ("s", "b", 1)]
    found = edges.select("source", F.col("link").alias("url"))
    assert rows(frontier.unseen(found, seeds, ["source", "url"]))[0] == ("s", "b")


BODY = "<html><head><title>T{0}</title></head><body><article><p>{1}</p></article></body></html>"


def pages(spark, texts):
    data = [("src", f"http://h.org/{i}", BODY.format(i, t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "source string, url string, raw string")


def test_medallion_end_to_end(spark, folder):
    day1, day2 = F.timestamp_seconds(F.lit(86_400)), F.timestamp_seconds(F.lit(172_800))
    lake = {n: f"{folder}/{n}" for n in ("bronze", "silver", "gold", "embeddings")}
    batch = pages(spark, ["word " * 200, "short", "other text " * 300])
    assert jobs.land_pages(spark, batch, lake["bronze"], day1, first=True)["rows"] == 2
    jobs.land_pages(spark, batch, lake["bronze"], day2)  # nothing new
    assert bronze.read_bronze(spark, lake["bronze"], False).count() == 2
    inventory = bronze.bronze_inventory(spark, lake["bronze"]).first()
    assert (inventory["source"], inventory["date"], inventory["n_objects"]) == ("src", "1970-01-02", 2)
    assert jobs.bronze_to_silver(spark, lake["bronze"], lake["silver"], False) == 2
    before = rows(store.read_table(spark, lake["silver"], "silver").drop("extra"))
    assert jobs.bronze_to_silver(spark, lake["bronze"], lake["silver"], False) == 2
    assert rows(store.read_table(spark, lake["silver"], "silver").drop("extra")) == before
    silver = store.read_table(spark, lake["silver"], "silver").orderBy("source_url").first()
    assert silver["extra"] == {"fetch_method": "browser"} and silver["title"] == "T0"
    first = jobs.silver_to_gold(spark, lake["silver"], lake["gold"], day1)
    assert first["n_docs"] == 2 and first == jobs.silver_to_gold(spark, lake["silver"], lake["gold"], day2)
    jobs.embed_gold(spark, lake["gold"], lake["embeddings"], day1, dim=16)
    jobs.embed_gold(spark, lake["gold"], lake["embeddings"], day2, dim=16)
    jobs.embed_gold(spark, lake["gold"], lake["embeddings"], day2, dim=16, model_ver="v2")
    table = store.read_table(spark, lake["embeddings"], "embeddings")
    assert rows(stats.version_counts(table)) == [
        ("_total", 2 * first["n_chunks"]), ("feature-hash-v1", first["n_chunks"]), ("v2", first["n_chunks"])]
    stamps = table.select(F.unix_seconds("created_at"), F.unix_seconds("updated_at"), "embedding_model_ver")
    assert {tuple(r) for r in stamps.collect()} == {
        (86_400, 172_800, "feature-hash-v1"), (172_800, 172_800, "v2")}


def silver_rows(spark, texts):
    data = [(i, "s", t, str(hash(t)), len(t), f"h{i}") for i, t in texts.items()]
    df = spark.createDataFrame(data, "doc_id string, source string, text string, content_hash string, char_count long, title string")
    return inputs.as_silver(df, F.timestamp_seconds(F.lit(1)))


def test_changes_reach_gold_and_embeddings(spark, folder):
    """A document shrinks, another vanishes with its whole partition, one is new, one stays."""
    silver, gold, embedded = (f"{folder}/{n}" for n in ("silver", "gold", "embeddings"))
    store.create_table(spark, silver, "silver")
    now, later = F.timestamp_seconds(F.lit(10)), F.timestamp_seconds(F.lit(20))
    texts = {"aa1": "a" * 1200, "aa2": "b" * 4000, "zz9": "c" * 700, "aa3": "d" * 900}
    jobs.apply_silver(spark, silver_rows(spark, texts), silver)
    assert jobs.propagate(spark, silver, gold, embedded, now, dim=8, model_ver="v1") == {"new": 4}
    jobs.embed_gold(spark, gold, embedded, now, dim=8, model_ver="v2")
    jobs.apply_silver(spark, silver_rows(spark, {"aa1": "tiny", "aa2": "e" * 1600, "new": "f" * 600}), silver)
    jobs.remove_documents(spark, spark.createDataFrame([("zz9",)], "doc_id string"), silver)
    assert jobs.propagate(spark, silver, gold, embedded, later, dim=8, model_ver="v1") == {"changed": 2, "gone": 1, "new": 1}
    chunks = {r["chunk_id"] for r in store.read_table(spark, gold, "gold").collect()}
    assert chunks == {"aa2::0", "aa2::1", "aa3::0", "new::0"}
    table = store.read_table(spark, embedded, "embeddings")
    found = {(r["chunk_id"], r["embedding_model_ver"], r["u"]) for r in table.withColumn("u", F.unix_seconds("updated_at")).collect()}
    assert found == {("aa2::0", "v1", 20), ("aa2::1", "v1", 20), ("new::0", "v1", 20), ("aa3::0", "v1", 10),
                     ("aa2::0", "v2", 10), ("aa2::1", "v2", 10), ("aa3::0", "v2", 10)}
    assert jobs.propagate(spark, silver, gold, embedded, later, dim=8, model_ver="v1") == {}
    jobs.remove_documents(spark, spark.createDataFrame([("aa1",), ("aa2",), ("aa3",), ("new",)], "doc_id string"), silver)
    jobs.propagate(spark, silver, gold, embedded, later, dim=8, model_ver="v1")
    assert store.read_table(spark, gold, "gold").count() == store.read_table(spark, embedded, "embeddings").count() == 0


def stored_files(path):
    found = (os.path.join(at, n) for at, _, names in os.walk(path) for n in names)
    return {f: os.stat(f).st_mtime_ns for f in found if f.endswith(".parquet")}


def test_files_that_keep_their_rows_stay(spark, folder, monkeypatch):
    """A change rewrites the files that lose rows, one after another, and leaves neither staged files nor shuffles of texts."""
    monkeypatch.setattr(config, "REWRITE_BYTES", 1)
    monkeypatch.setattr(config, "BROADCAST_ROWS", 1)
    silver, gold, embedded = (f"{folder}/{n}" for n in ("silver", "gold", "embeddings"))
    first, second = F.timestamp_seconds(F.lit(10)), F.timestamp_seconds(F.lit(20))
    texts = {f"{'ab'[i % 2]}{i}": chr(97 + i) * 4000 for i in range(12)}
    store.create_table(spark, silver, "silver")
    jobs.apply_silver(spark, silver_rows(spark, texts).repartition(4, "doc_id"), silver)
    jobs.propagate(spark, silver, gold, embedded, first, dim=8, model_ver="v1")
    jobs.embed_gold(spark, gold, embedded, first, dim=8, model_ver="v2")
    before = {p: stored_files(p) for p in (silver, gold, embedded)}
    held = spark.read.parquet(silver).where("doc_id = 'a0'").select("_metadata.file_path").first()[0].split("/")[-1]
    jobs.apply_silver(spark, silver_rows(spark, {"a0": "z" * 1600}), silver)
    jobs.remove_documents(spark, spark.createDataFrame([("b1",)], "doc_id string"), silver)
    assert jobs.propagate(spark, silver, gold, embedded, second, dim=8, model_ver="v1") == {"changed": 1, "gone": 1}
    for path in (silver, gold, embedded):
        assert not stored_files(f"{path}__staging")
    now = stored_files(silver)
    kept = {f for f in before[silver] if now.get(f) == before[silver][f]}
    assert kept and held not in {f.split("/")[-1] for f in now}
    texts = {k: v for k, v in texts.items() if k != "b1"} | {"a0": "z" * 1600}
    got = {r["doc_id"]: r["text"] for r in store.read_table(spark, silver, "silver").collect()}
    assert got == texts
    want = {(f"{k}::{i}", n) for k, v in texts.items() for i, n in enumerate([1500, 1500, 1400, 100] if len(v) == 4000 else [1500, 300])}
    assert {(r["chunk_id"], r["char_count"]) for r in store.read_table(spark, gold, "gold").collect()} == want
    stamps = [F.unix_seconds(c).alias(c) for c in ("created_at", "updated_at")]
    table = store.read_table(spark, embedded, "embeddings").select("chunk_id", "embedding_model_ver", *stamps)
    assert rows(table) == sorted(
        (c, v, 10, 20 if v == "v1" and c.startswith("a0::") else 10) for c, _ in want for v in ("v1", "v2"))


def test_merges_may_not_repeat_rows(spark, folder):
    store.create_table(spark, folder + "/silver", "silver")
    batch = silver_rows(spark, {"a": "x", "b": "y"})
    with pytest.raises(ValueError, match="repeats rows"):
        store.rewrite_partitions(
            spark, folder + "/silver", "silver", batch, lambda part, new: part.unionByName(new).unionByName(new), folder + "/staged")
    assert store.read_table(spark, folder + "/silver", "silver").count() == 0


def test_positions_are_gapless(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 1009).alias("k"), "id").repartition(11)
    found = sorted((r["position"], r["k"], r["id"]) for r in ordering.with_positions(df, [F.asc("k"), F.desc("id")]).collect())
    assert [p for p, _, _ in found] == list(range(3000))
    assert [(k, i) for _, k, i in found] == sorted(((i * 7919 % 1009, i) for i in range(3000)), key=lambda r: (r[0], -r[1]))
    assert ordering.with_positions(df.limit(0), [F.asc("k")]).collect() == []


def test_count_deltas(spark):
    def counts(rows_):
        return spark.createDataFrame(rows_, "k string, n long, m long")

    stored = counts([("a", 2, 5), ("b", 1, 1), ("c", 3, 3)])
    deltas = stats.count_deltas(counts([("a", 1, 2), ("b", 1, 1), ("c", 1, 1)]), counts([("a", 1, 4), ("d", 1, 1), ("c", 1, 1)]), ["k"], ["n", "m"])
    assert rows(deltas) == [("a", 0, 2), ("b", -1, -1), ("d", 1, 1)]
    assert rows(stats.merge_counts(stored, deltas, ["k"], ["n", "m"])) == [("a", 2, 7), ("c", 3, 3), ("d", 1, 1)]
    assert rows(stats.version_rollup(spark.createDataFrame([], "embedding_model_ver string"))) == [("_total", 0)]


def test_changed_content_replaces_the_silver_row(spark, folder):
    base = pages(spark, ["word " * 200])
    rows_ = landing.bronze_rows(base, F.timestamp_seconds(F.lit(1)))
    flat = store.with_ingest_date(rows_.drop("date", "raw"))
    store.create_table(spark, folder + "/silver", "silver")
    jobs.apply_silver(spark, flat, folder + "/silver")
    newer = flat.withColumn("content_hash", F.lit("other")).withColumn("ingest_date", F.lit("2030-01-01"))
    jobs.apply_silver(spark, newer, folder + "/silver")
    got = store.read_table(spark, folder + "/silver", "silver").collect()
    assert [(r["content_hash"], r["ingest_date"]) for r in got] == [("other", "1970-01-01")]


def test_bronze_json_cases(spark, folder):
    os.makedirs(folder + "/source=s/date=d/text")
    good = {"metadata": {"doc_id": "1", "ingested_at": "2024-05-01T10:00:00+00:00", "extra": {"a": "b"},
                         "byte_size": 3, "unknown": 1}, "text": "t"}
    cases = [good, {"metadata": {"source": "s"}, "text": "t"}, {"metadata": {"doc_id": "2"}, "text": None},
             {"metadata": {"doc_id": "3", "ingested_at": "not a time"}, "text": "t"}]
    for i, case in enumerate(cases):
        with open(f"{folder}/source=s/date=d/text/{i}.json", "w") as f:
            json.dump(case, f, indent=2)
    with open(f"{folder}/source=s/date=d/text/bad.json", "w") as f:
        f.write("{ broken")
    got = {r["doc_id"]: r for r in bronze.flatten(bronze.read_bronze(spark, folder)).collect()}
    assert set(got) == {"1", "3"} and got["3"]["ingested_at"] is None
    assert got["1"]["extra"] == {"a": "b"} and got["1"]["ingested_at"].year == 2024


def test_markdown_corpus(spark, folder):
    sizes = {"kafka": [1489, 1723, 1156], "react": [1111, 1147, 1181]}
    for source, lengths in sizes.items():
        os.makedirs(f"{folder}/corpus/{source}")
        for i, n in enumerate(lengths):
            text = f"# Title {i}\n" + "word " * 400
            with open(f"{folder}/corpus/{source}/f{i}.md", "w") as f:
                f.write(text[: n - 1] + "x")
    chunks = markdown.corpus_chunks(markdown.read_markdown(spark, folder + "/corpus"))
    assert chunks.count() == 13
    assert {r["title"] for r in chunks.collect()} == {"Title 0", "Title 1", "Title 2"}
    jobs.load_corpus(spark, folder + "/corpus", folder + "/emb", F.timestamp_seconds(F.lit(1)), dim=8)
    assert store.read_table(spark, folder + "/emb", "embeddings").count() == 13


def test_store_helpers(spark, folder):
    assert store.read_or_empty(spark, folder + "/none", "gold").count() == 0
    store.create_table(spark, folder + "/gold", "gold")
    store.create_table(spark, folder + "/gold", "gold", force=True)
    assert store.read_or_empty(spark, folder + "/gold", "gold").count() == 0
    store.write_evaluation(spark.range(2), spark.range(1), folder + "/eval")
    assert spark.read.json(folder + "/eval/results").count() == 2


def test_stream_of_landed_json(spark, folder):
    day = F.timestamp_seconds(F.lit(86_400))
    jobs.land_pages(spark, pages(spark, ["a " * 200, "b " * 200]), folder + "/bronze", day, first=True)
    for run in ("1", "1", "2"):  # resume without news, then a replay from nothing
        stream = incremental.bronze_stream(spark, folder + "/bronze", max_files=1)
        incremental.upsert_stream(stream, folder + "/silver", f"{folder}/checkpoint{run}")
        assert store.read_table(spark, folder + "/silver", "silver").count() == 2


def test_metrics_stream_equals_batch(spark):
    d = "/root/testdata/sf0.001"
    batch = metrics.windowed_histogram(
        inputs.table(spark, d, "events").withColumn("ts", inputs.utc_timestamp(F.col("ts"))),
        "ts", F.col("value"), request_metrics.config.GENERATION_BUCKETS, "1 day", "event_type")
    stream = request_metrics.run_available(spark, d)
    assert rows(stream.select(*batch.columns)) == rows(batch)


def test_quarantine(spark, folder):
    """Broken and incomplete records are kept once, good ones pass; a wrong type breaks its record."""
    os.makedirs(folder + "/landed")
    lines = [
        '{"metadata": {"doc_id": "1"}, "text": "one"}', '{"metadata": {"doc_id": "2"}, "text": "tw', '{"metadata": {}, "text": "t"}', "",
        '{"metadata": {"doc_id": "4", "byte_size": "many"}, "text": "t"}', '{"metadata": {"doc_id": "5"}, "text": null}',
    ]
    with open(f"{folder}/landed/a.json", "w") as f:
        f.write("\n".join(lines))
    for day in (1, 2):
        good = bronze.quarantine(spark, folder + "/landed", folder + "/kept", F.timestamp_seconds(F.lit(day)), multi_line=False)
        assert [(r["doc_id"], r["text"]) for r in good.collect()] == [("1", "one")]
        kept = bronze.read_quarantine(spark, folder + "/kept").collect()
        assert sorted(r["state"] for r in kept) == ["broken", "broken", "incomplete", "incomplete"]
    assert {lines[1], lines[4]} <= {r["record"] for r in kept}


def test_raw_bodies_are_read_back(spark, folder):
    rows_ = [("s", "2024-06-01", "k1", bytearray(b"a\xffb")), ("s", "2024-06-02", "k2", bytearray("é".encode())), ("t", "2024-06-01", "k3", bytearray())]
    bronze.write_raw(spark.createDataFrame(rows_, "source string, date string, raw_object_key string, raw binary"), folder)
    got = {r["raw_object_key"]: (r["date"], r["byte_size"], r["text"]) for r in bronze.raw_texts(spark, folder).collect()}
    assert got == {"k1": ("2024-06-01", 3, "a�b"), "k2": ("2024-06-02", 2, "é"), "k3": ("2024-06-01", 0, "")}


def test_rows_of_few_and_of_most_documents(spark, monkeypatch):
    """Whichever side is the smaller, it is broadcast, and the rows are the same."""
    rows = spark.createDataFrame([(f"d{i % 20}", i) for i in range(60)], "doc_id string, n int")
    for most, n, joined in ((5, 3, "BroadcastHashJoin"), (5, 17, "BroadcastHashJoin"), (1, 10, None)):
        monkeypatch.setattr(config, "BROADCAST_ROWS", most)
        found = jobs._of_documents(rows, spark.createDataFrame([(f"d{i}",) for i in range(n)], "doc_id string"))
        assert joined is None or joined in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["n"] for r in found.collect()) == [i for i in range(60) if i % 20 < n]


def test_pages_are_extracted_once(spark, folder):
    """Raw bodies and documents come from one stored extraction."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(raw):
        seen.add(1)
        return raw

    pages = spark.createDataFrame([("s", f"http://s/{i}", f"<p>{'word ' * 60}{i}</p>") for i in range(8)], "source string, url string, raw string")
    jobs.land_pages(spark, pages.withColumn("raw", counted("raw")), folder + "/bronze", F.lit("2024-01-01").cast("timestamp"), first=True)
    assert seen.value == 8
