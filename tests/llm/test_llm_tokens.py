"""Plane files and packing against the plain tokenizer and brute force."""

import zlib

import numpy as np
import pytest
from cases import LONG, documents, empty
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import bitplanes, packing, textops
from tessera.llm.textops import WordEncoder, default_vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_vocabulary())


def ids_of(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.characters(codec="utf-8"), st.sampled_from([*" \n\t.,'sS|é́Å\x1c 0aB#", "<|startoftext|>", "<|endoftext|>", "<|", "|>"])), max_size=60))
def test_encoder_equals_tokenizer(parts):
    text = "".join(parts)
    own = _ENCODER(text)
    assert own == np.array(_PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_ENCODER = WordEncoder(default_vocabulary(), limit=50, places=64)
_PLAIN = Tokenizer.from_file(default_vocabulary())


def test_names_of_added_tokens():
    assert np.frombuffer(_ENCODER("a <|endoftext|> b"), "<u4").tolist() == [320, 49407, 321]
    texts = ["<|startoftext|>word", "word<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|> <|endoftext|>", "", "don<|endoftext|>'t<|startoftext|><|endoftext|>", "<|endoftext|>"]
    ids, first = _ENCODER.many(*textops.joined_bytes(texts))
    for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
        assert ids[a:b].tolist() == _PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\x0b\x1cabAB\xa0")), max_size=30), max_size=6))
def test_words_and_shingles_of_many_texts(texts):
    """Words are equal where their bytes are, whatever stands around; shingles follow them."""
    words, first = textops.word_hashes_many(*textops.joined_bytes(texts))
    named = {}
    for i, text in enumerate(texts):
        own = text.encode().lower().split()
        assert len(own) == first[i + 1] - first[i]
        for word, code in zip(own, words[first[i] : first[i + 1]].tolist(), strict=True):
            assert named.setdefault(word, code) == code
        sets = textops.shingles_many(words, first, 3)[i]
        rows = [tuple(own[j : j + 3]) for j in range(max(1, len(own) - 2))] if own else []
        assert len(sets) == len(set(rows)) and (np.diff(sets.astype(object)) > 0).all()
    assert len(set(named.values())) == len(named)


def test_stretches_change_nothing(monkeypatch):
    text = LONG[:20_000] + "x" * 3000 + "\n" + LONG[:500]
    texts = [text, "", "ab cd", text]
    whole = textops.word_hashes_many(*textops.joined_bytes(texts))
    ids = _ENCODER.many(*textops.joined_bytes(texts))
    monkeypatch.setattr(textops, "SLICE", 256)
    parts = textops.word_hashes_many(*textops.joined_bytes(texts))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))
    again = _ENCODER.many(*textops.joined_bytes(texts))
    assert all((a == b).all() for a, b in zip(ids, again, strict=True))
    assert ids[0][: ids[1][1]].tobytes() == ids_of(_PLAIN, text, 1)[:-1].tobytes()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    for n in (1, 7, 8, 1000):
        ids = np.random.default_rng(n).integers(0, 2**32, n, dtype=np.uint32)
        assert (bitplanes.from_planes(bitplanes.to_planes(ids, kind), n) == ids).all()


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files(spark, folder, tokenizer, kind):
    docs = documents(spark)
    rows = docs.select("doc_id", "text").collect()
    bitplanes.write_ids(docs, f"{folder}/ids", default_vocabulary(), end_id=1, chunk_ids=4096, planes=kind)
    found = bitplanes.read_ids(spark, f"{folder}/ids").collect()
    order = sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or ""))
    start, expected = 0, []
    for r in order:
        ids = ids_of(tokenizer, r["text"], 1)
        expected.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes()))
        start += len(ids)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) for r in found), key=lambda r: r[1])
    assert got == expected
    index = bitplanes.chunk_index(spark, f"{folder}/ids")
    assert index.agg({"n_ids": "sum"}).first()[0] == start
    assert index.where("n_ids > 4096").count() == 0


def test_plane_files_of_nothing(spark, folder):
    bitplanes.write_ids(empty(spark), f"{folder}/none", default_vocabulary())
    assert bitplanes.read_ids(spark, f"{folder}/none").count() == 0


def test_packing(spark, tokenizer):
    docs = documents(spark)
    size = 64
    packed = packing.pack(docs, default_vocabulary(), size=size, end_id=0, keep_ids=True)
    rows = packed.collect()
    expected = []
    for r in docs.select("doc_id", "text").collect():
        ids = ids_of(tokenizer, r["text"], 0)
        for piece, at in enumerate(range(0, len(ids), size)):
            own = ids[at : at + size]
            expected.append((str(r["doc_id"]), piece, at, len(own), zlib.crc32(own.tobytes())))
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], bytes(r["ids"])))
    for pieces in bins.values():
        at = 0
        for offset, length, _ in sorted(pieces):
            assert offset == at
            at += length
        assert at <= size
    whole = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    assert whole == {k: b"".join(p[2] for p in sorted(v)) for k, v in bins.items()}
    assert packing.pack(empty(spark), default_vocabulary()).count() == 0


def one_by_one(lengths, size):
    """Best-two-fit on single pieces."""
    left, bins = sorted(lengths), []
    while left:
        bin_, gap = [], size
        for length in sorted(left, reverse=True):
            if length <= gap:
                bin_.append(length)
                gap -= length
                left.remove(length)
        if gap and len(bin_) > 1:
            small, best = min(bin_), (min(bin_), None)
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if best[0] < a + b <= gap + small:
                        best = (a + b, (a, b))
            if best[1]:
                bin_.remove(small)
                left.append(small)
                for x in best[1]:
                    left.remove(x)
                    bin_.append(x)
                left.sort()
        bins.append(sorted(bin_, reverse=True))
    return bins


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=25))
def test_plan_is_that_of_single_pieces(lengths):
    counts = {x: lengths.count(x) for x in set(lengths)}
    plan = packing.plan_bins(counts, 30)
    placed = [x for pattern, times in plan for x in pattern * times]
    assert sorted(placed) == sorted(lengths)
    assert all(sum(pattern) <= 30 and times > 0 for pattern, times in plan)
    assert sum(times for _, times in plan) == len(one_by_one(lengths, 30))


def test_plan_needs_few_steps():
    rng = np.random.default_rng(3)
    counts = {int(x): int(n) for x, n in enumerate(rng.integers(0, 10**9, 2048)) if x}
    plan = packing.plan_bins(counts, 2048)
    total = sum(length * n for length, n in counts.items())
    assert len(plan) < 3 * 2048
    assert sum(times for _, times in plan) * 2048 < 1.01 * total + 2048
