"""Language, quality, near-duplicates, fingerprints and decontamination against brute force and held-out rows."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import LONG, documents, empty
from pyspark.sql import functions as F

from tessera.llm import decontam, fingerprints, langid, neardup, quality, queries, textops
from tessera.sources.tables import table

SF = "/root/testdata/sf0.001"


def key(row):
    return (str(row["doc_id"]), str(row["text"]))


# ---------------------------------------------------------------- language


def test_language_held_out(spark):
    found = queries.QUERIES["op10_rank_order"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    rows = found.where("held_out").collect()
    assert rows and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_rows(spark):
    docs = documents(spark)
    profiles = langid.learn(docs)
    found = langid.identify(docs, profiles)
    assert found.count() == docs.count()
    assert set(docs.columns) <= set(found.columns)
    for r in found.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert r["lang_pred"] in ("en", "de", "und")
    kept = langid.identify(docs, profiles, pred="p", score="q")
    assert {r["score"] for r in kept.select("score").collect()} == {"x-score"}
    assert langid.identify(empty(spark), langid.learn(empty(spark))).count() == 0
    assert langid.Profiles({}).identify("text") == ("und", 0.0)


def test_sample_is_exact(spark):
    """The least hashes of each language, though one language and one id hold most rows."""
    rows = [(i, "one" if i % 10 else "two") for i in range(4000)] + [(7, "one")] * 3000 + [(None, "two")] * 50 + [(1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string").withColumn("text", F.lit("a text"))
    hashed = docs.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).collect()
    for sample in (1, 60, 100_000):
        found = Counter(tuple(r) for r in langid.sampled(docs.withColumn("edge", F.lit(0)), sample).select("lang", "doc_id").collect())
        for lang in ("one", "two"):
            of = sorted({r["h"] for r in hashed if r["lang"] == lang})
            share = min(1.0, sample * 1.2 / sum(r["lang"] == lang for r in hashed))
            near = [h for h in of if h <= -(2.0**63) + 2.0**64 * share][:sample]
            assert {k: n for k, n in found.items() if k[0] == lang} == dict(
                Counter((lang, r["doc_id"]) for r in hashed if r["lang"] == lang and r["h"] in near)
            )
    assert langid.sampled(docs.limit(0)).count() == 0


def test_profiles_and_predictions_by_brute_force(spark):
    """Profiles, distances and predictions recomputed from strings, over a whole table."""
    folder = "/root/testdata/sf0.001"
    docs = table(spark, folder, "documents")
    rows = docs.select("doc_id", "text", "lang").collect()

    def strings(text):
        out = Counter()
        for word in "".join(c if c.isalpha() else " " for c in (text or "").lower()).split():
            out.update(word)
            padded = f" {word} "
            for n in (2, 3, 4):
                out.update(padded[i : i + n] for i in range(len(padded) - n + 1))
        return out

    def code(gram):
        """The number an n-gram has in the order of ties."""
        number = 0
        for c in gram:
            number = number << 16 | (1 if c == " " else ord(c) % 65_521 + 2)
        return number

    def order(counts):
        return sorted(counts, key=lambda g: (-counts[g], code(g)))[: langid.PLACES]

    learned = {}
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            learned.setdefault(r["lang"], Counter()).update(strings(r["text"]))
    places = {lang: {g: i for i, g in enumerate(order(counts))} for lang, counts in learned.items()}
    found = {r["doc_id"]: r for r in queries.QUERIES["op10_rank_order"](spark, folder).collect()}
    assert len(found) == len(rows)
    for r in rows:
        own = order(strings(r["text"]))
        far = {lang: sum(min(langid.PLACES, abs(at.get(g, 10**6) - i)) for i, g in enumerate(own)) for lang, at in places.items()}
        best = min(sorted(far), key=far.get)
        got = found[r["doc_id"]]
        assert got["lang_pred"] == (best if own else "und")
        assert got["score"] == pytest.approx(1 - far[best] / (langid.PLACES * len(own)) if own else 0.0)


def test_texts_far_from_every_profile(spark):
    rng = np.random.default_rng(3)
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang")
    profiles = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    limits = langid.least_scores(docs.where(~langid.held_out(F.col("doc_id"))), profiles)
    assert set(limits) == set(profiles.languages) and all(0.15 < v < 0.35 for v in limits.values())
    junk = lambda letters, n: " ".join("".join(rng.choice(list(letters), 7)) for _ in range(n))
    far = [junk("bcdfghjklmnpqrstvwxz", n) for n in (30, 300, 3000)] + [junk("абвгдежзиклмнопрстуфхцчшщыэюя", n) for n in (5, 50, 500)]
    near = ["zq", "бв", "и", "xyz 12"]
    rows = [(i, t) for i, t in enumerate(far)] + [(100 + i, t) for i, t in enumerate(near)] + [(200, None), (201, ""), (202, "12 !")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_language", F.lit("own"))
    kept = langid.recognised(odd, profiles, limits)
    assert kept.columns == odd.columns and {tuple(r) for r in kept.collect()} == {(100 + i, t, "own") for i, t in enumerate(near)}
    assert langid.recognised(docs, profiles, limits).count() == docs.count()
    assert langid.least_scores(docs.limit(0), profiles) == {}


def test_languages_are_learned_from_all_texts(spark):
    """Profiles and limits depend on every labelled text, also beyond a sample's bound."""
    rows = [(i, f"common words {'abc'[i % 3]}", "en") for i in range(2 * langid.SAMPLE)] + [(10**6, "zzzz " * 40_000, "en"), (10**6 + 1, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    profiles = langid.learn(docs)
    counts = Counter()
    for _, text, lang in rows:
        counts.update(langid.grams(text).tolist() if lang else [])
    want = sorted(counts, key=lambda c: (-counts[c], c))[: langid.PLACES]
    order = np.argsort(profiles.places[0])
    assert profiles.languages == ["en"] and profiles.codes[0][order].tolist() == want
    scores = [profiles.identify(text)[1] for _, text, lang in rows if lang]
    assert langid.least_scores(docs, profiles)["en"] == pytest.approx(langid.MARGIN * np.percentile(scores, 1))


def test_tally_in_pieces(monkeypatch):
    """Counts add up whether or not a task holds them to its end."""
    monkeypatch.setattr(langid, "HELD_GRAMS", 50)
    monkeypatch.setattr(langid, "HELD_COUNTS", 200)
    texts = [("a", f"word{chr(97 + i % 26)} other{chr(97 + i % 7)}") if i % 3 else ("b", "some text") for i in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts]), pa.array([t for _, t in texts])], names=["lang", "text"])
    got, want = Counter(), Counter()
    parts = [*langid._tally(iter([batch.slice(0, 90), batch.slice(90)]))]
    for part in parts:
        for lang, code, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
            got[lang, code] += n
    for lang, text in texts:
        want.update((lang, c) for c in langid.grams(text).view(np.int64).tolist())
    assert got == want and len(parts) > 2


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(4)
    of = {"a": rng.random(3001), "b": np.round(rng.random(500), 1), "c": np.array([0.25]), "d": np.array([0.0, 1.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in of.items() for x in xs], "lang string, s double")
    for part in (0.01, 0.5, 1.0):
        got = langid.percentiles(df, "lang", "s", part, 64)
        assert got == pytest.approx({k: np.percentile(xs, 100 * part) for k, xs in of.items()})
    assert langid.percentiles(df.limit(0), "lang", "s", 0.5) == {}


def test_out_of_place_distance():
    """Counted by hand over the same n-grams."""
    text = "ab abc"
    names = ["a", "b", "a", "b", "c"]
    assert len(langid.grams(text)) == len(names) + len(["_a", "ab", "b_", "_a", "ab", "bc", "c_"]) + len(["_ab", "ab_", "_ab", "abc", "bc_"]) + len(["_ab_", "_abc", "abc_"])
    own = langid.ranked(langid.grams(text)).view(np.int64).tolist()
    other = own[::-1]
    same, turned = langid.Profiles({"x": own}).identify(text), langid.Profiles({"x": other}).identify(text)
    assert same == ("x", 1.0)
    n = len(own)
    apart = sum(abs(i - (n - 1 - i)) for i in range(n))
    assert turned[1] == pytest.approx(1 - apart / (langid.PLACES * n))
    missing = langid.Profiles({"x": [1]}).identify(text)
    assert missing == ("x", 0.0)


# ---------------------------------------------------------------- quality


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    scored = queries.QUERIES["op8_attention"](spark, folder).join(table(spark, folder, "labels"), "doc_id")
    rows = scored.where("held_out").collect()
    assert all(r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    good = np.array([r["quality"] for r in rows])
    score = np.array([r["score"] for r in rows])
    assert ((score >= 0.3) == good).mean() > 0.93
    assert (score[good == 1][:, None] > score[good == 0][None]).mean() > 0.97


def test_quality_of_awkward_rows(spark):
    docs = documents(spark)
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (8, 1), (9, None), (None, 1), (10, 0), (10, 1)], "doc_id long, quality int")
    scored = quality.score(docs, quality.learn(docs, labels)).collect()
    assert len(scored) == docs.count() and all(0 <= r["score"] <= 1 for r in scored)
    by_text = {}
    for r in scored:
        assert by_text.setdefault(r["text"] or "", r["score"]) == pytest.approx(r["score"], abs=1e-9)
    none = quality.learn(empty(spark), labels.limit(0))
    assert none.constant == 0.5 and quality.score(empty(spark), none).count() == 0


def test_passages_do_not_see_their_neighbours():
    texts = ["abc abc", "Abc", LONG[:5000], ""]
    rows, first = quality.encode_passages(texts)
    for i, text in enumerate(texts):
        alone, _ = quality.encode_passages([text])
        assert np.allclose(alone, rows[first[i] : first[i + 1]])


def test_attention_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    bags = [rng.random((n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 5, 2) * 20]
    labels = np.array([float(b[:, 0].max() > 0.8) for b in bags])
    model = quality.fit(bags, labels, epochs=150)
    rows, first = np.concatenate(bags), np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    forward = model.forward(rows, first)
    assert ((forward["score"] > 0.5) == labels).mean() > 0.9
    assert np.allclose(np.add.reduceat(forward["a"], first[:-1]), 1)


def test_gradients_and_forward_pass_by_brute_force():
    """Finite differences of the loss, which a plain loop computes."""
    rng = np.random.default_rng(4)
    bags = [rng.random((n, quality.FEATURES)) for n in (1, 4, 2)]
    labels = np.array([1.0, 0.0, 1.0])
    model = quality.fit([b.astype(np.float32) for b in bags], labels, hidden=5, attention=3, epochs=2)
    w = model.weights

    def plain(bag):
        codes, marks = [], []
        for row in bag:
            h = np.tanh(sum((row[i] - w["mean"][i]) / w["scale"][i] * w["enc"][i] for i in range(len(row))) + w["enc_b"])
            codes.append(h)
            marks.append(sum(np.tanh(h @ w["tan"][:, j]) / (1 + np.exp(-(h @ w["gate"][:, j]))) * w["att"][j] for j in range(3)))
        share = [np.exp(m) / sum(np.exp(m) for m in marks) for m in marks]
        z = sum(s * h for s, h in zip(share, codes, strict=True))
        return 1 / (1 + np.exp(-(z @ w["out"] + w["out_b"][0])))

    def loss():
        scores = [plain(b) for b in bags]
        return -np.mean([np.log(s) if y else np.log(1 - s) for s, y in zip(scores, labels, strict=True)])

    rows, first = np.concatenate(bags), np.concatenate(([0], np.cumsum([len(b) for b in bags])))
    assert np.allclose(model.forward(rows, first)["score"], [plain(b) for b in bags])
    for name, slope in quality.gradients(model, rows, first, labels).items():
        for at in list(np.ndindex(w[name].shape))[:: max(1, w[name].size // 12)]:
            kept = w[name][at]
            sides = []
            for change in (1e-5, -1e-5):
                w[name][at] = kept + change
                sides.append(loss())
            w[name][at] = kept
            assert slope[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-7)


def test_quality_sample_is_bounded_by_bytes(spark, monkeypatch):
    """Whole documents in hash order, without those too long, until the bytes are used up."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda bags, labels: seen.append((bags, labels)))
    monkeypatch.setattr(quality, "TRAIN_BYTES", 20_000)
    monkeypatch.setattr(quality, "TRAIN_ROW", 6_000)
    rows = [(i, "x" * (700 * i)) for i in range(12)] + [(3, "é"), (4, None)]
    labels = [(i, i % 2) for i in range(12)]
    docs, marked = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    quality.learn(docs, marked)
    total, wanted = 0, []
    order = {r["doc_id"]: r["h"] for r in marked.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    for i in sorted(range(12), key=order.get):
        size = sum(len((t or "").encode()) for d, t in rows if d == i)
        if size <= 6_000:
            total += size
            if total <= 20_000:
                wanted += [(max(1, -(-len((t or "").encode()) // quality.PASSAGE)), i % 2) for d, t in rows if d == i]
    (bags, got_labels), = seen
    assert sorted(zip([len(b) for b in bags], got_labels, strict=True)) == sorted(wanted) and len(wanted) < len(rows)


# ---------------------------------------------------------------- near duplicates


def shingles(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_components(rows, size, percent):
    sets = [(d, shingles(t, size)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d in parent}


@pytest.mark.parametrize("folder", [SF])
def test_near_duplicates_equal_brute_force(spark, folder):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, folder, "documents").collect()]
    expected = brute_components(rows, 4, 80)
    found = queries.QUERIES["op4_setsketch"](spark, folder).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in found} == {d: len(shingles(t, 4)) for d, t in rows}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_near_duplicates_of_groups_and_chains(spark):
    """A large group of near copies, a chain whose ends are not alike, and texts that share a passage."""
    rng = np.random.default_rng(1)
    word = lambda: f"w{rng.integers(10**6)}"
    base = [word() for _ in range(60)]
    rows = []
    for i in range(60):
        copy = list(base)
        copy[int(rng.integers(60))] = word()
        rows.append((1000 + i, " ".join(copy)))
    chain = [word() for _ in range(80)]
    for i in range(12):
        rows.append((2000 + i, " ".join(chain[2 * i : 2 * i + 50])))
    shared = [word() for _ in range(40)]
    for i in range(40):
        rows.append((3000 + i, " ".join(shared + [word() for _ in range(25)])))
    rows += [(10, " ".join(base)), (11, " ".join(base).upper()), (12, None), (13, "")]
    rng.shuffle(rows)
    rows = [(int(d), t if t is None else str(t)) for d, t in rows]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=4, threshold=0.8)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == brute_components(rows, 4, 80)


def test_rows_of_one_id_link_their_texts(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{n}" for n in rng.integers(10**6, size=40)) for _ in range(5)]
    rows = [(1, texts[0]), (2, texts[1]), (10, texts[0]), (10, texts[1]), (10, texts[2]), (10, None), (3, texts[2] + " and"), (4, texts[3]), (5, texts[4])]
    found = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in found.collect()) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)] + [(10, 1)] * 3 + [(10, 10)]
    alone = neardup.near_duplicates(spark.createDataFrame([(10, texts[0]), (10, texts[1]), (4, texts[3])], "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in alone.collect()) == [(4, 4, True), (10, 10, True), (10, 10, True)]


def test_near_duplicates_of_awkward_rows(spark):
    docs = documents(spark)
    found = neardup.near_duplicates(docs, size=5, threshold=0.8).collect()
    assert len(found) == docs.count()
    by_id = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert by_id[2]["component_id"] == 1 and by_id[9]["component_id"] == 8 and by_id[10]["component_id"] == 6
    assert by_id[3]["component_id"] == 3 and by_id[5]["n_shingles"] == 0
    assert all(r["kept"] and r["component_id"] is None for r in found if r["doc_id"] is None)
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_components_of_paths(spark):
    edges = [(f"{i:03d}".encode(), f"{i + 1:03d}".encode()) for i in range(40) if i % 13] + [(b"100", b"050"), (b"000", b"000")]
    got = neardup.components(spark.createDataFrame([tuple(map(bytearray, e)) for e in edges], "a binary, b binary")).collect()
    label = {bytes(r["node"]): bytes(r["label"]) for r in got}
    assert len(label) == len(got)
    for a, b in edges:
        if a != b:
            assert label[a] == label[b]
    assert label[b"013"] != label[b"014"] and label[b"100"] == b"050"


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(2)
    hashes = rng.integers(0, 2**63, 4000).astype(np.uint64)
    left, right = hashes[:2500], hashes[500:]
    a, b, whole = neardup.sketches([left, right, hashes])
    assert (neardup.merge(a, b) == whole).all()
    assert abs(neardup.cardinality(whole) / 4000 - 1) < 0.25
    found = neardup.resemblance(a[None], b[None], np.array([2500.0]), np.array([3500.0]))[0]
    assert abs(found - 0.5) < 0.12
    assert (neardup.sketches([np.empty(0, np.uint64)]) == 0).all()


def test_small_sets_share_a_band():
    """Sets of 4 and 5 elements, similarity 0.8: with independent registers, one pair in 200,000 shares no band."""
    rng = np.random.default_rng(3)
    lost = 0
    for _ in range(10):
        hashes = rng.integers(0, 2**63, (2000, 5)).astype(np.uint64)
        a, b = neardup.sketches([h[:4] for h in hashes]), neardup.sketches(list(hashes))
        lost += int((~(a == b).reshape(2000, -1, neardup.ROWS).all(2).any(1)).sum())
    assert lost <= 2


def test_sketches_do_not_depend_on_their_parts(monkeypatch):
    hashes = np.random.default_rng(4).integers(0, 2**63, 3000).astype(np.uint64)
    sets = [hashes[:1], hashes[:0], hashes[1:2000], hashes[1900:], hashes[:7]]
    whole = neardup.sketches(sets)
    monkeypatch.setattr(neardup, "_ELEMENTS", 500)
    assert (neardup.sketches(sets) == whole).all()


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_and_edited_texts(spark):
    rows = sorted(((r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()))
    found = {r["doc_id"]: r for r in queries.QUERIES["op6_bottom_k"](spark, SF).collect()}
    assert len(found) == len(rows)
    errors = []
    for i, (doc_id, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = found[doc_id]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = shingles(text, 5), shingles(edited, 5)
        errors.append(abs(len(a & b) / len(a | b) - r["near_edited"]))
        assert r["fingerprint"] == fingerprints.to_text(fingerprints.bottom_k(text))
    assert np.mean(errors) < 0.04 and max(errors) < 0.25


def test_fingerprints_of_awkward_rows(spark):
    docs = documents(spark)
    found = fingerprints.compared(docs).collect()
    assert len(found) == docs.count()
    order = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    expected = []
    for i, (doc_id, text) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        cut = len(text) // 4
        expected.append((str(doc_id), hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["edited_sha256"]) for r in found) == sorted(expected)
    assert fingerprints.compared(empty(spark)).count() == 0
    one = fingerprints.compared(docs.where("doc_id = 1")).first()
    assert one["near_next"] == 1.0


def test_fingerprints_merge_and_estimate(spark):
    words = [f"w{i}" for i in range(3000)]
    parts = [" ".join(words[:2000]), " ".join(words[1996:])]
    whole = fingerprints.bottom_k(" ".join(words))
    a, b = map(fingerprints.bottom_k, parts)
    assert (fingerprints.merge(a, b) == whole).all()
    assert abs(fingerprints.distinct(whole) / 2996 - 1) < 0.3
    assert fingerprints.distinct(fingerprints.bottom_k("a b c d e f")) == 2
    assert fingerprints.containment(a, whole) > 0.8 > fingerprints.containment(whole, b)
    frame = spark.createDataFrame([(1, parts[0]), (2, parts[1])], "doc_id long, text string")
    merged = fingerprints.merged(fingerprints.sketches(frame).withColumn("g", F.lit(1)), "g").first()
    assert merged["fingerprint"] == fingerprints.to_text(whole)
    assert (fingerprints.from_text(merged["fingerprint"]) == whole).all()


# ---------------------------------------------------------------- decontamination


def test_items_are_found_where_they_stand(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in table(spark, folder, "documents").collect()}
    items = {r["item_id"]: r["text"] for r in table(spark, folder, "benchmark").collect()}
    expected = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    found = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op9_latent"](spark, folder).collect()}
    assert found == expected and expected


def test_reworded_items_and_recall(spark):
    """Copies with a sixth of the words changed, dropped or added, in documents of the table's own words."""
    folder = "/root/testdata/sf0.01"
    rng = np.random.default_rng(4)
    docs = [r["text"] for r in table(spark, folder, "documents").where("n_chars > 1500").limit(300).collect()]
    items = table(spark, folder, "benchmark")
    texts = [r["text"] for r in items.orderBy("item_id").collect()]
    clean = [t for t in docs if not any(x in t for x in texts)]
    pool = " ".join(clean).split()
    rows, planted = [], set()
    for i, text in enumerate(clean):
        words = text.split()
        if i % 2 == 0:
            item = texts[i % len(texts)].split()
            for place in rng.choice(len(item), len(item) // 6, replace=False):
                item[place] = str(rng.choice(["", pool[rng.integers(len(pool))], item[place] + " " + pool[rng.integers(len(pool))]]))
            at = int(rng.integers(len(words)))
            words[at:at] = " ".join(item).split()
            planted.add((i, i % len(texts)))
        rows.append((i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, items).collect()}
    assert len(found & planted) >= 0.9 * len(planted)
    assert not found - planted


def test_short_items_are_found_wherever_they_stand():
    """Items of 15 to 20 words, verbatim and with a third reworded, without any help of the latent space."""
    rng = np.random.default_rng(8)
    words = [rng.integers(0, 2**32, n).astype("<u4") for n in [15, 16, 17, 18, 19, 20] * 20]
    space = decontam.LatentSpace(np.ones(decontam.TERMS + 1, np.float32), np.zeros((decontam.TERMS + 1, 4), np.float32))
    space.idf[-1] = 0
    items = decontam.Items.of([{"item_id": i, "text": " ".join(map(str, w))} for i, w in enumerate(words)], space)
    pool = rng.integers(0, 2**32, 500).astype("<u4")
    for changed in (0, 3):
        texts = []
        for item in items.words:
            copy = item.copy()
            places = rng.choice(len(item) - 3, len(item) // changed if changed else 0, replace=False)
            copy[places] = rng.choice(pool, len(places))
            text = rng.choice(pool, 300)
            texts.append(np.insert(text, int(rng.integers(301)), copy))
        found = {(d, i) for d, i, *_ in decontam.matches(list(range(len(texts))), texts, items, space)}
        assert found == {(i, i) for i in range(len(texts))}


def test_sequences_outlast_a_fifth_of_changes():
    for n in range(1, 200):
        item = np.arange(n)
        own = decontam.sequences_of(item)
        assert all(1 <= size <= decontam.WHOLE and begin + size <= n for begin, size in own)
        if n >= decontam.WHOLE:
            assert sum(size for _, size in own[: n // 5 + 1]) <= n and len(own) >= n // 5 + 1
            assert min(size for _, size in own) >= 3 and any(begin + size == n for begin, size in own)


def test_decontamination_of_awkward_rows(spark):
    docs = documents(spark)
    items = spark.createDataFrame(
        [(1, "quick brown fox jumps over the lazy dog near the river bank today", "x"), (2, None, "x"), (3, "", "x"), (4, "one two", "x")],
        "item_id long, text string, words string",
    )
    found = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()}
    assert {(1, 1), (2, 1)} <= found and not {d for d, i in found if i in (2, 3)}
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.contaminated(empty(spark), items).count() == 0


def test_longest_common_subsequence():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(1, 30))
        table_ = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table_[i + 1, j + 1] = table_[i, j] + 1 if x == y else max(table_[i, j + 1], table_[i + 1, j])
        assert decontam.common_length(a, b) == table_[-1, -1]


def test_words_of_the_search():
    assert len(decontam.word_codes("A b, b. 'A' ... x")) == 5
    assert len(set(decontam.word_codes("A b, b. 'A' ... x").tolist())) == 3
    assert len(textops.word_hashes("A b, b. 'A' ... x")) == 6
