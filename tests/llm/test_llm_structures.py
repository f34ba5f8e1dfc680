"""Merkle manifest, prefix trie and exact top-k search against plain Python."""

import re
import zlib
from collections import defaultdict
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
import pytest
from cases import CLASHING, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import merkle, ordered, prefixtrie, vafile


def clashing(df):
    return df.select("*", *[F.lit(f"x-{n}").alias(n) for n in (*CLASHING, "tree", "at", "depth", "top", "size", "v", "dim", "digest") if n not in df.columns])


# --------------------------------------------------------------------------- numbers in a total order


def test_numbers_are_gapless_in_groups_of_any_size(spark):
    rows = [("hot", i // 3) for i in range(3000)] + [(f"g{i % 40}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x long").repartition(7)
    found = defaultdict(list)
    for r in ordered.numbered(df, "g", [F.asc("x")]).collect():
        found[r.g].append((r["at"], r.x))
    for own in found.values():
        assert [a for a, _ in sorted(own)] == list(range(len(own)))
        assert [x for _, x in sorted(own)] == sorted(x for _, x in own)
    assert sum(map(len, found.values())) == len(rows)


# --------------------------------------------------------------------------- Merkle manifest


def tree_of(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([merkle.digest_of(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def steps(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 3 * 3 :][:3]
        out.append(("".join(run[: i % 3]), "".join(run[i % 3 + 1 :])))
        i //= 3
    return out


def manifest_by_hand(rows):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    sources = defaultdict(list)
    for doc_id, source, lang, n_chars, text in rows:
        leaf = merkle.digest_of(*map(field, (doc_id, source, lang, n_chars, text)))
        changed = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
            changed = text.replace("\n", "")
        again = merkle.digest_of(*map(field, (doc_id, source, lang, n_chars, changed)))
        sources[source].append(((doc_id is not None, doc_id or 0), leaf, again, doc_id))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[1] for x in sorted(sources[s])]) for s in order}
    top = tree_of([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for i, (_, leaf, again, doc_id) in enumerate(sorted(sources[s])):
            way = steps(trees[s], i) + steps(top, k)
            for left, right in way:
                again = merkle.digest_of(left, again, right)
            proof = merkle.digest_of(*(x for step in way for x in step))
            out.append((doc_id, leaf, trees[s][-1][0], top[-1][0], proof, again, again == top[-1][0]))
    return sorted(out, key=str)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def test_manifest_of_awkward_rows(spark):
    docs = documents(spark)
    docs = clashing(docs.unionByName(docs.where("doc_id = 7")).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.col("source"))))
    found = sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str)
    assert found == manifest_by_hand(tuple(r) for r in docs.select(FIELDS).collect())
    assert not all(r[-1] for r in found) and any(r[-1] for r in found)


def test_manifest_of_a_hot_source_and_many_sources(spark, monkeypatch):
    """Several blocks and rounds of one source, and of the sources' tree."""
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "WIDTH", 9)
    rows = [(i, "hot" if i % 3 else f"s{i % 50}", "en", i, f"text\n{i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted((tuple(r) for r in merkle.manifest(docs).collect()), key=str) == manifest_by_hand(rows)


def test_manifest_of_few_rows(spark):
    assert merkle.manifest(empty(spark)).collect() == []
    one = spark.createDataFrame([(5, "a", None, None, "x")], "doc_id long, source string, lang string, n_chars long, text string")
    (row,) = merkle.manifest(one).collect()
    assert row.leaf == row.subroot == row.root == row.folded_root and row.verified
    assert row.proof_sha256 == sha256(b"").hexdigest()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 250))
def test_sweeps_of_a_block(n):
    digests = [merkle.digest_of(str(i)) for i in range(n)]
    levels = merkle.forward(digests, merkle.height_of(n))
    assert levels == tree_of(digests)
    told = dict(merkle.backward(levels, ("l", "r", None)))
    assert len(told) == n
    for i, suffix in told.items():
        assert list(merkle.steps_of(suffix)) == [*steps(levels, i), ("l", "r")]


# --------------------------------------------------------------------------- prefix trie


def trie_by_hand(rows):
    told = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            told[conv].append((turn is not None, turn or 0, key, role, text))
    told = {c: [t[3:] for t in sorted(v)] for c, v in told.items()}
    wanted = {c: zlib.crc32(str(c).encode()) % 4 for c in told}
    rebuilt = {c: told.get(c - c % 20, [])[: wanted[c]] + v[wanted[c] :] for c, v in told.items()}
    members, children, sums = defaultdict(list), defaultdict(int), defaultdict(lambda: [0, 0])
    for c, v in rebuilt.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        saved = (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            sums[p[:d]][0] += saved
            sums[p[:d]][1] += not children[p]
    out = set()
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        up = min(members[p[:-1]]) if p else None
        out.add((min(m), len(p), up, len(m), children[p], sums[p][1], sums[p][0], sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string"


def trie_cases():
    rows = [(c, t, "user" if t % 2 else "assistant", f"turn {t if t < 3 else c % 4} of  {'all' if t < 2 else c % 5}") for c in range(60) for t in range(c % 7)]
    rows += [(100, t, "user", f"x {t}") for t in range(150)]  # one long conversation and copies of it
    rows += [(c, t, "user", f"x {t}") for c in range(101, 110) for t in range(150 if c % 2 else 90)]
    rows += [(40, None, None, None), (41, None, None, "a"), (41, None, None, "a"), (41, 0, "b", ""), (41, 0, "a", "\x1cz y")]
    return [*rows, (None, 1, "user", "x"), (205, 0, "user", "alone"), (-7, 0, "user", "below"), (-7, 1, "user", "zero")]


@pytest.mark.parametrize(("limit", "block", "piece"), [(prefixtrie.LOCAL, prefixtrie.BLOCK, prefixtrie.PIECE), (20, 8, 2)])
def test_trie(spark, monkeypatch, limit, block, piece):
    monkeypatch.setattr(prefixtrie, "BLOCK", block)
    monkeypatch.setattr(prefixtrie, "PIECE", piece)
    rows = trie_cases()
    found = prefixtrie.trie(clashing(spark.createDataFrame(rows, TURNS)), limit).collect()
    assert {tuple(r) for r in found} == trie_by_hand(rows) and len(found) == len(trie_by_hand(rows))


def test_trie_of_few_rows(spark):
    assert prefixtrie.trie(spark.createDataFrame([], TURNS)).collect() == []
    assert prefixtrie.trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).collect() == []
    rows = [(1, None, None, None)]
    assert {tuple(r) for r in prefixtrie.trie(spark.createDataFrame(rows, TURNS)).collect()} == trie_by_hand(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1, exclude_max=True), st.integers(0, 9), st.integers(0, 3)), min_size=1, max_size=80))
def test_totals_of_a_component(nodes):
    parent = [int(x * i) if i else -1 for i, (x, _, _) in enumerate(nodes)]
    values = [(a, b) for _, a, b in nodes]
    want = [list(v) for v in values]
    for i in range(len(nodes) - 1, 0, -1):
        want[parent[i]][0] += want[i][0]
        want[parent[i]][1] += want[i][1]
    assert prefixtrie.subtree_totals(parent, values) == want


# --------------------------------------------------------------------------- exact top-k


def top_by_hand(rows, k, asked):
    sound = {}
    for vec_id, v in rows:
        if vec_id is not None and v and all(x is not None and np.isfinite(x) for x in v):
            own = [int(np.floor(64 * float(x))) for x in v]
            sound[vec_id] = min(sound.get(vec_id, own), own)
    out = set()
    for q, a in sound.items():
        if asked(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in sound.items() if c != q and len(a) == len(b))
            out |= {(q, i + 1, c, -s) for i, (s, c) in enumerate(scored[:k])}
    return out


def vector_rows():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 5)]) for i in range(300)]
    rows += [(i, rows[40][1]) for i in range(300, 420)]  # one very common vector
    rows += [(20, rows[20][1]), (21, [0.0] * 5), (60, None), (500, []), (501, [1.0, None, 0.0, 0.0, 0.0]), (502, [float("nan")] * 5)]
    return [*rows, (503, [float("inf")] * 5), (None, [1.0] * 5), (520, [1.0, -2.0]), (521, [0.5, 0.25]), (540, [1.0] * 3)]


@pytest.mark.parametrize("parts", [1, 4])
def test_top_k(spark, monkeypatch, parts):
    monkeypatch.setattr(vafile, "parts_of", lambda rows, cores: parts)
    monkeypatch.setattr(vafile, "BLOCK_QUERIES", 7)
    rows = vector_rows()
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5))
    found = vafile.top_k(df, F.col("vec_id") % 20 == 0, 6).collect()
    assert {tuple(r) for r in found} == top_by_hand(rows, 6, lambda i: i % 20 == 0) and len(found) == len({tuple(r) for r in found})
    many = {tuple(r) for r in vafile.top_k(df, F.col("vec_id") % 100 == 0, 1000).collect()}
    assert many == top_by_hand(rows, 1000, lambda i: i % 100 == 0)


def test_groups_of_several_files():
    """Vectors beyond a file's bound are in the next file of their group, and found."""
    rng = np.random.default_rng(5)
    rows = [(i, [int(x) for x in rng.integers(-50, 50, 4)]) for i in range(50)]

    def batch(some):
        columns = [pa.array([4] * len(some), pa.int32()), pa.array([0] * len(some), pa.int32()), pa.array([i for i, _ in some]), pa.array([v for _, v in some])]
        return pa.RecordBatch.from_arrays(columns, names=["dim", "part", "vec_id", "v"])

    def numbered(blocks, number):
        for b in blocks:
            own = [b.column(0), b.column(1), pa.array([number] * b.num_rows, pa.int32()), *b.columns[2:]]
            yield pa.RecordBatch.from_arrays(own, names=["dim", "part", "number", "ids", "marks", "cells", "vectors"])

    files = [*numbered(vafile._pack(iter([batch(rows)]), 20, True), 0)]
    asked = [*numbered(vafile._pack(iter([batch(rows[:10])]), 4, False), -1)]
    assert len(files) == 3
    found = {}
    for b in vafile._search(iter([*files, *asked]), 6):
        for q, c, s in zip(*(x.to_pylist() for x in b.columns), strict=True):
            found.setdefault(q, []).append((-s, c))
    got = {(q, i + 1, c, -s) for q, own in found.items() for i, (s, c) in enumerate(sorted(own)[:6])}
    assert got == top_by_hand([(i, [x / 64 for x in v]) for i, v in rows], 6, lambda i: i < 10)


def test_top_k_of_large_numbers(spark):
    rows = [(i, [float(1 << 22) + i, -(2.0**21), 1.5]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in vafile.top_k(df, F.col("vec_id") == 0, 5).collect()} == top_by_hand(rows, 5, lambda i: i == 0)
    assert vafile.top_k(df.where("vec_id < 0"), F.col("vec_id") == 0, 5).collect() == []
    with pytest.raises(Exception, match="(?i)overflow|too large|out of"):
        vafile.top_k(spark.createDataFrame([(i, [2.0**40] * 3) for i in range(3)], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, 5).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 60), st.integers(1, 6), st.integers(1, 30))
def test_bounds_hold_and_reading_stops_when_certain(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    v, q = rng.integers(-spread, spread + 1, (n, dim)), rng.integers(-spread, spread + 1, (2, dim))
    marks, code = vafile.approximation(v, 4)
    wide = np.zeros((dim, 2, vafile.CELLS), np.int64)
    wide[:, :, :4] = marks
    lower, upper = vafile.bounds(q, wide, code)
    exact = q @ v.T
    assert (lower <= exact).all() and (exact <= upper).all()
    ids = rng.permutation(n)
    for i in range(2):
        found, score, read = vafile.nearest(q[i], lower[i], upper[i], ids, v, min(5, n))
        order = np.lexsort((ids, -exact[i]))[:5]
        assert (found == ids[order]).all() and (score == exact[i][order]).all() and read <= n


def test_few_exact_vectors_are_read():
    rng = np.random.default_rng(1)
    v = np.floor(64 * rng.normal(0, 0.125, (4000, 64))).astype(np.int64)
    lower, upper = vafile.bounds(v[:20], *vafile.approximation(v))
    read = [vafile.nearest(v[i], lower[i], upper[i], np.arange(4000), v, 20)[2] for i in range(20)]
    assert max(read) < 800
