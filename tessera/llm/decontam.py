"""Benchmark decontamination by latent semantic retrieval.

All documents are cut into overlapping passages.  Their TF-IDF matrix has a column for
each of a fixed number of hashed terms; one distributed pass sketches its right singular
vectors (a randomised SVD in Nystroem form), which turn passages and benchmark items into
short whitened vectors.  Passages whose cosine with an item is high are candidates; for
these, the idf weight of the shared words, then the longest common subsequence of words
and the item's last words (its answer) decide, so that reworded copies are found and
passages on the same subject are not.

What the latent space misses is found by exact word sequences.  An item is cut into one
sequence more than the words a copy may lack, so that a copy with changed or missing words
has one of them unchanged; its answer is a further one.  Where a text has one of an item's
sequences, the same subsequence and answer decide.

Defined results: a null or empty text has no passages and matches nothing; an item
without words is never found; rows with a null or repeated id are searched row by row;
without items or documents the result has no rows; columns other than doc_id, text and
item_id are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textops import joined_bytes, plain, slices, stored, word_hashes_many

#: Words of a block; a passage is two neighbouring blocks.
BLOCK = 16
#: Hashed terms (a power of two), columns of the random matrix, leading directions that only
#: tell languages and common words apart and are left out, and dimensions kept.
TERMS, COLUMNS, LEADING, DIMENSIONS = 16_384, 40, 8, 32
#: Items are compared in sections of at most so many words.
SECTION = 48
#: Share of the cosine expected of a verbatim copy that makes a candidate.
NEAR = 0.6
#: Share of the smaller idf weight that a candidate must have in common.
WEIGHT = 0.4
#: Items of fewer words are looked up whole; longer ones by sequences of 3 to :data:`RUN` words.
WHOLE, RUN = 8, 5
#: Words of the passages and items that are compared at once.
COMPARED = 1 << 20
#: Items of one search pass; more are searched in further passes over the stored words.
ITEM_BLOCK = 20_000
#: Rows of a partial sum that travel together, and sums added up in one group.
ROWS, FAN_IN = 2048, 64

#: Signs that are no part of a word.
_SIGNS = np.isin(np.arange(256), np.frombuffer(b".,;:!?\"'()[]{}*#|", np.uint8))


# --------------------------------------------------------------------------- words


def codes_many(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all words, A-Z lower-cased and without signs, and each text's first."""
    sign = _SIGNS[data]
    before = np.concatenate(([0], np.cumsum(sign)))
    hashes, first = word_hashes_many(data[~sign], starts - before[starts])
    return (hashes >> np.uint64(32)).astype("<u4"), first


def word_codes(text: str | None) -> np.ndarray:
    """The same for one text."""
    return codes_many(*joined_bytes([text or ""]))[0]


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = []
        for _, _, data, starts in slices(batch.column(1)):
            codes, first = codes_many(data, starts)
            words += [codes[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["doc_id", "words"])


class Blocks:
    """Words of several texts in rows of :data:`BLOCK`, the last of a text filled up with :data:`TERMS`."""

    def __init__(self, texts: list[np.ndarray]):
        sizes = np.array([len(t) for t in texts], np.int64)
        blocks = -(-sizes // BLOCK)
        self.text = np.repeat(np.arange(len(texts)), blocks)
        self.first = np.concatenate(([0], np.cumsum(blocks)))
        self.terms = np.full(int(self.first[-1]) * BLOCK, TERMS, np.uint16)
        if len(texts):
            words = np.concatenate(texts)
            shift = self.first[:-1] * BLOCK - np.concatenate(([0], np.cumsum(sizes)[:-1]))
            self.terms[np.arange(len(words)) + np.repeat(shift, sizes)] = (words & (TERMS - 1)).astype(np.uint16)
        self.terms = self.terms.reshape(-1, BLOCK)
        #: Blocks that are followed by one of the same text.
        self.inner = np.flatnonzero(self.text[1:] == self.text[:-1]) if len(self.text) else np.empty(0, np.int64)

    def paired(self, values: np.ndarray) -> np.ndarray:
        """Sums over passages: each block and the next one of its text."""
        out = values.copy()
        out[self.inner] += values[self.inner + 1]
        return out


def _text_batches(batches: Iterator[pa.RecordBatch], words: int = 400_000) -> Iterator[tuple[list, list[np.ndarray]]]:
    """doc_ids and word codes of texts with about ``words`` words together."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(doc_id)
            texts.append(np.frombuffer(raw.as_buffer(), "<u4"))
            held += len(texts[-1])
            if held >= words:
                yield ids, texts
                ids, texts, held = [], [], 0
    if texts:
        yield ids, texts


# --------------------------------------------------------------------------- sums over tasks


def _rows(name_of: str, part: int, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(matrix), ROWS):
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{name_of}{at:06d}"]), pa.array([part], pa.int32()), pa.array([matrix[at : at + ROWS].tobytes()], pa.binary())],
            ["rows", "part", "sums"],
        )


_SUMS = "rows string, part int, sums binary"


def _added(table: pa.Table) -> pa.Table:
    order = np.argsort(table.column("part").to_numpy(), kind="stable")
    total = sum(np.frombuffer(table.column("sums")[int(i)].as_py(), np.float64) for i in order)
    rows, part = table.column("rows")[0], table.column("part")[0].as_py() // FAN_IN
    return pa.table({"rows": [rows.as_py()], "part": pa.array([part], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})


def _total(partial: DataFrame) -> dict[str, np.ndarray]:
    """Sums of fixed size over any number of tasks, at most :data:`FAN_IN` in one group at a time."""
    for _ in range(3):
        partial = partial.groupBy("rows", (F.col("part") / FAN_IN).cast("int").alias("g")).applyInArrow(
            lambda table: _added(table), _SUMS
        )
    found: dict[str, list] = {}
    for row in sorted(partial.collect(), key=lambda r: (r["rows"], r["part"])):
        found.setdefault(row["rows"], []).append(np.frombuffer(bytes(row["sums"]), np.float64))
    whole: dict[str, list] = {}
    for rows, sums in found.items():
        whole.setdefault(rows[:-6], []).append(sum(sums))
    return {name: np.concatenate(parts) for name, parts in whole.items()}


# --------------------------------------------------------------------------- latent space


@dataclass
class LatentSpace:
    """idf of the terms, and the map from TF-IDF to whitened latent dimensions."""

    idf: np.ndarray
    map: np.ndarray

    def vectors(self, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors and idf weights of all passages."""
        raw = blocks.paired(self.block_sums(blocks))
        size = np.sqrt((raw * raw).sum(1, keepdims=True))
        weight = blocks.paired(self.idf[blocks.terms].sum(1))
        return raw / np.maximum(size, 1e-12), weight

    def block_sums(self, blocks: Blocks) -> np.ndarray:
        out = np.zeros((len(blocks.terms), self.map.shape[1]), np.float32)
        for i in range(BLOCK):
            out += self.map[blocks.terms[:, i]]
        return out


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, blocks_seen = np.zeros(TERMS, np.float64), 0
    for _, texts in _text_batches(batches):
        blocks = Blocks(texts)
        ordered = np.sort(blocks.terms, axis=1)
        new = np.ones(ordered.shape, bool)
        new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        counts += np.bincount(ordered[new], minlength=TERMS + 1)[:TERMS]
        blocks_seen += len(ordered)
    yield from _rows("df", TaskContext.get().partitionId(), counts)
    yield from _rows("n", TaskContext.get().partitionId(), np.array([float(blocks_seen)]))


def _random(columns: int) -> np.ndarray:
    return np.random.default_rng(11).standard_normal((TERMS + 1, columns)).astype(np.float32)


def _sketcher(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weighted = _random(COLUMNS) * idf[:, None]
        space = LatentSpace(idf, weighted)
        square = idf * idf
        found, inner = np.zeros((TERMS, COLUMNS)), np.zeros((COLUMNS, COLUMNS))
        for _, texts in _text_batches(batches, 100_000):
            blocks = Blocks(texts)
            if not len(blocks.terms):
                continue
            norm = np.sqrt(np.maximum(blocks.paired(square[blocks.terms].sum(1)), 1e-12)).astype(np.float32)[:, None]
            y = blocks.paired(space.block_sums(blocks)) / norm
            inner += y.T.astype(np.float64) @ y
            share = y / norm  # of a passage, for each of its words
            both = share.copy()
            both[blocks.inner + 1] += share[blocks.inner]
            flat = blocks.terms.ravel().astype(np.int64)
            for column in range(COLUMNS):
                weights = np.repeat(both[:, column], BLOCK)
                found[:, column] += np.bincount(flat, weights, TERMS + 1)[:TERMS]
        part = TaskContext.get().partitionId()
        yield from _rows("b", part, found * idf[:TERMS, None])
        yield from _rows("g", part, inner)

    return run


def learn(words: DataFrame) -> LatentSpace:
    """The latent space of all passages of ``doc_id, words``: two passes, sums of fixed size.

    ``B = A'A W`` and ``G = W'A'A W`` for a random W give ``A'A ~ B G^-1 B'``.
    """
    counted = _total(words.mapInArrow(_document_frequency, _SUMS))
    n = float(counted["n"].sum()) if counted else 0.0
    df = counted["df"] if counted else np.zeros(TERMS)
    idf = np.concatenate((np.log((n + 1) / (df + 0.5)), [0.0])).astype(np.float32)
    if n == 0:
        return LatentSpace(idf, np.zeros((TERMS + 1, DIMENSIONS), np.float32))
    sums = _total(words.mapInArrow(_sketcher(idf), _SUMS))
    b, g = sums["b"].reshape(TERMS, COLUMNS), sums["g"].reshape(COLUMNS, COLUMNS)
    value, vector = np.linalg.eigh((g + g.T) / 2)
    good = value > 1e-7 * value.max()
    right, sigma, _ = np.linalg.svd(b @ (vector[:, good] / np.sqrt(value[good])), full_matrices=False)
    kept = (sigma > 1e-4 * sigma[0]).nonzero()[0]
    kept = kept[min(LEADING, len(kept) // 2) :][:DIMENSIONS]
    latent = right[:, kept] / sigma[kept] * idf[:TERMS, None]
    return LatentSpace(idf, np.concatenate((latent, np.zeros((1, len(kept))))).astype(np.float32))


# --------------------------------------------------------------------------- search


def common_length(left: np.ndarray, right: np.ndarray) -> int:
    """Length of the longest common subsequence, all rows of the table at once as bits of a number."""
    places: dict[int, int] = {}
    for i, word in enumerate(left.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    full = (1 << len(left)) - 1
    row = full
    for word in right.tolist():
        hit = row & places.get(word, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


_FACTORS = np.random.default_rng(17).integers(1, 2**63, WHOLE, np.uint64) * np.uint64(2) + np.uint64(1)
#: Leading bits of a sequence's hash that are looked up first.
_BITS = 22


def _sequence_hashes(codes: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each of the sizes, the hashes of all sequences of so many words."""
    words = codes.astype(np.uint64)
    sums = np.zeros(len(words), np.uint64)
    for size in range(1, max(sizes, default=0) + 1):
        if size > len(words):
            return
        sums = sums[: len(words) - size + 1] + words[size - 1 :] * _FACTORS[size - 1]
        if size in sizes:
            yield size, sums


def sequences_of(item: np.ndarray) -> list[tuple[int, int]]:
    """Begin and size of the word sequences by which an item is looked up.

    A copy that keeps 0.8 of the words has one of ``len // 5 + 1`` disjoint parts whole; one
    that keeps fewer must have the answer.
    """
    n = len(item)
    if n < WHOLE:
        return [(0, n)]
    edges = np.linspace(0, n, n // 5 + 2).astype(int).tolist()
    size = min(RUN, len(answer_of(item)))
    return sorted({*((a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)), (n - size, size)})


class Sequences:
    """The word sequences of all items by size, sorted by hash."""

    def __init__(self, words: list[np.ndarray]):
        cuts: dict[int, list] = {}
        for i, item in enumerate(words):
            for begin, size in sequences_of(item):
                cuts.setdefault(size, []).append((i, begin))
        first = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)
        self.tables = {}
        for size, value in _sequence_hashes(np.concatenate([np.empty(0, "<u4"), *words]), list(cuts)):
            item, begin = np.array(cuts[size]).T
            value = value[first[item] + begin]
            order = np.argsort(value, kind="stable")
            likely = np.zeros(1 << _BITS, bool)
            likely[value >> np.uint64(64 - _BITS)] = True
            self.tables[size] = (likely, value[order], item[order], begin[order])

    def places(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Text, item, and the word of the text where a copy of the item would begin."""
        for size, value in _sequence_hashes(words, list(self.tables)):
            likely, known, item, begin = self.tables[size]
            at = np.flatnonzero(likely[value >> np.uint64(64 - _BITS)])
            text = np.searchsorted(first, at, "right") - 1
            inside = at + size <= first[text + 1]
            at, text = at[inside], text[inside]
            low, high = (np.searchsorted(known, value[at], side) for side in ("left", "right"))
            at, text, low, count = at[high > low], text[high > low], low[high > low], (high - low)[high > low]
            total = np.cumsum(count)
            for some in np.split(np.arange(len(at)), np.flatnonzero(np.diff(total // COMPARED)) + 1):
                n = count[some]
                row = np.repeat(low[some], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                of = np.repeat(text[some], n)
                yield of, item[row], np.maximum(np.repeat(at[some], n) - begin[row] - first[of], 0)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of several ranges, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def exact_places(texts: list[np.ndarray], items: Items, space: LatentSpace) -> Iterator[tuple[int, int, int, int, int]]:
    """Text, item, block, and first and last word of the places whose words may make a copy.

    The words of the place bound the common subsequence from above, so no copy is dropped;
    those with fewer than 0.8 of the words need :data:`WEIGHT` of the item's idf weight too.
    """
    words = np.concatenate(texts)
    sizes = np.array([len(t) for t in texts])
    first = np.concatenate(([0], np.cumsum(sizes)))
    item_size = np.array([len(w) for w in items.words])
    item_first = np.cumsum(item_size) - item_size
    item_words = np.concatenate(items.words)
    for text, item, start in items.sequences.places(words, first):
        text, item, block = np.unique(np.stack((text, item, start // BLOCK)), axis=1)
        around = item_size[item] // 4
        low = np.maximum(block * BLOCK - around, 0)
        high = np.minimum((block + 1) * BLOCK + item_size[item] + around, sizes[text])
        total = np.cumsum(high - low + item_size[item])
        for some in np.split(np.arange(len(text)), np.flatnonzero(np.diff(total // COMPARED)) + 1):
            n, m = (high - low)[some], item_size[item[some]]
            pair = np.arange(len(some), dtype=np.uint64) << np.uint64(32)
            theirs = np.sort(np.repeat(pair, n) | words[_ranges(first[text[some]] + low[some], n)])
            own = item_words[_ranges(item_first[item[some]], m)]
            wanted = np.repeat(pair, m) | own
            place = np.minimum(np.searchsorted(theirs, wanted), max(0, len(theirs) - 1))
            there = theirs[place] == wanted if len(theirs) else np.zeros(len(wanted), bool)
            of = np.repeat(np.arange(len(some)), m)
            idf = space.idf[own & (TERMS - 1)].astype(np.float64)
            common = np.bincount(of[there], minlength=len(some)) / m
            weight = np.bincount(of[there], idf[there], len(some)) >= WEIGHT * np.bincount(of, idf, len(some))
            good = some[(common >= 0.8) | (common >= 0.6) & weight]
            yield from zip(*(x[good].tolist() for x in (text, item, block, low, high)), strict=True)


@dataclass
class Items:
    """Benchmark items, and their sections with vectors, weights and cosine limits."""

    ids: list[int]
    words: list[np.ndarray]
    section_item: np.ndarray
    vectors: np.ndarray
    limits: np.ndarray
    weights: np.ndarray
    shared: np.ndarray
    sequences: Sequences

    @classmethod
    def of(cls, rows: list, space: LatentSpace) -> Items:
        ids, words = [], []
        for row in rows:
            codes = word_codes(row["text"])
            if len(codes):
                ids.append(row["item_id"])
                words.append(codes)
        owner, sections = [], []
        for i, codes in enumerate(words):
            for part in np.array_split(codes, -(-len(codes) // SECTION)):
                owner.append(i)
                sections.append(part)
        terms = [s & (TERMS - 1) for s in sections]
        raw = np.stack([space.map[t].sum(0) for t in terms]) if terms else np.zeros((0, space.map.shape[1]), np.float32)
        size = np.sqrt((raw * raw).sum(1, keepdims=True))
        # at the least favourable place, a passage shares this many words with a copy of the section
        length = np.array([len(s) for s in sections], np.float64)
        passage = 2 * BLOCK
        common = np.minimum(np.minimum(length, passage), (length + passage - BLOCK) / 2)
        shared = np.zeros((len(sections), TERMS + 1), np.float32)  # idf of the terms a section has
        for i, t in enumerate(terms):
            shared[i, t] = space.idf[t]
        return cls(
            ids, words, np.array(owner, np.int64), raw / np.maximum(size, 1e-12), NEAR * common / np.sqrt(length * passage),
            np.array([space.idf[t].sum() for t in terms]), shared, Sequences(words),
        )


def answer_of(item: np.ndarray) -> np.ndarray:
    """The words that stand for an item's answer: its last eighth, three at least."""
    return item[-max(3, len(item) // 8) :]


def _contains(region: np.ndarray, part: np.ndarray) -> bool:
    if len(part) > len(region):
        return False
    windows = np.lib.stride_tricks.sliding_window_view(region, len(part))
    return bool((windows == part).all(1).any())


def matches(ids: list, texts: list[np.ndarray], items: Items, space: LatentSpace) -> list[tuple]:
    """doc_id, item_id, first word, words, cosine, common share and answer of the items found."""
    blocks = Blocks(texts)
    if not len(blocks.terms) or not len(items.section_item):
        return []
    vectors, weights = space.vectors(blocks)
    rows, sections, cosines = [], [], []
    for at in range(0, len(items.section_item), 1024):
        for top in range(0, len(vectors), 4096):
            cosine = vectors[top : top + 4096] @ items.vectors[at : at + 1024].T
            row, section = np.nonzero(cosine >= items.limits[at : at + 1024].astype(np.float32))
            rows.append(row + top)
            sections.append(section + at)
            cosines.append(cosine[row, section])
    row, section, cosine = (np.concatenate(x) for x in (rows, sections, cosines))
    # idf weight of the passage's words that the section has
    following = np.where(np.isin(row, blocks.inner), row + 1, len(blocks.terms))
    terms = np.concatenate((blocks.terms, np.full((1, BLOCK), TERMS, np.uint16)))
    first, flat = section * (TERMS + 1), items.shared.ravel()
    common = np.zeros(len(row), np.float32)
    for i in range(BLOCK):
        common += flat[first + terms[row, i]]
        common += flat[first + terms[following, i]]
    good = common >= WEIGHT * np.minimum(weights[row], items.weights[section])
    best: dict[tuple, tuple] = {}
    for r, s, c in zip(row[good].tolist(), section[good].tolist(), cosine[good].tolist(), strict=True):
        text, i = int(blocks.text[r]), int(items.section_item[s])
        item = items.words[i]
        start = int(r - blocks.first[text]) * BLOCK
        low = max(0, start - len(item))
        region = texts[text][low : start + 2 * BLOCK + len(item)]
        share = common_length(item, region) / len(item)
        if share < 0.6:
            continue
        answer = _contains(region, answer_of(item))
        if share >= 0.8 or answer:
            found = (share, c, -low, len(region), answer)
            if found > best.get((text, i), (0.0,)):
                best[text, i] = found
    by_latent = set(best)
    first_section = np.searchsorted(items.section_item, np.arange(len(items.ids)))
    for text, i, block, low, high in exact_places(texts, items, space):
        if (text, i) in by_latent:
            continue
        item, region = items.words[i], texts[text][low:high]
        share = common_length(item, region) / len(item)
        if share < 0.6 or len(item) < WHOLE and share < 1:
            continue
        answer = _contains(region, answer_of(item))
        if share >= 0.8 or answer:
            c = float(vectors[blocks.first[text] + block] @ items.vectors[first_section[i]])
            found = (share, c, -low, high - low, answer)
            if found > best.get((text, i), (0.0,)):
                best[text, i] = found
    return [(ids[t], items.ids[i], -low, n, float(c), share, answer) for (t, i), (share, c, low, n, answer) in sorted(best.items())]


_MATCH = "doc_id long, item_id long, first_word long, n_words long, cosine double, common double, answer boolean"


def _searcher(rows: list, space: LatentSpace):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(rows, space)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
        names = [c.split()[0] for c in _MATCH.split(", ")]
        for ids, texts in _text_batches(batches, 100_000):
            columns = list(zip(*matches(ids, texts, items, space), strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item found in it.

    Words are hashed once and stored; two passes learn the space, and one pass searches
    for a block of at most about :data:`ITEM_BLOCK` items.  Nothing is shuffled but sums
    of fixed size.
    """
    spark = docs.sparkSession
    words = stored(plain(docs, "doc_id", "text").where("text is not null").mapInArrow(_coded, "doc_id long, words binary"), "words")
    items = plain(benchmark, "item_id", "text").where("text is not null")
    n_items = items.count()
    found = spark.createDataFrame([], _MATCH)
    if n_items == 0:
        return found
    space = learn(words)
    blocks = -(-n_items // ITEM_BLOCK)
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = own.collect()
        found = found.union(words.mapInArrow(_searcher(rows, space), _MATCH))
    return found
