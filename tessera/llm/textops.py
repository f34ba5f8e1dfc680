"""What several operators share: hashes of words and shingles, token ids, stored steps.

Texts are handled many at a time as arrays of bytes.  What a Python worker remembers is
bounded and only saves time, so a lost worker costs nothing but recomputation.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessera.session import shared_folder


# --------------------------------------------------------------------------- bytes of many texts

#: Bytes of text handled at once, so that the arrays stay in the processor's cache.
SLICE = 1 << 19
#: A-Z as a-z.
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_BLANK = np.isin(np.arange(256), [32, *range(9, 14)])
#: A random number for each byte, and an odd base whose powers weigh places.
_TABLE = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)
_ODD = 0x9E3779B97F4A7C15 | 1


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a column, without a copy, and where each starts; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    starts = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def joined_bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The same for a list of texts."""
    raws = [t.encode("utf-8", "surrogatepass") for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(r) for r in raws], dtype=np.int64)))
    return np.frombuffer(b"".join(raws), np.uint8), starts.astype(np.int64)


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, row after the last, bytes, starts."""
    data, starts = text_bytes(column)
    row, rows = 0, len(starts) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(starts, starts[row] + size, "right")) - 1)
        yield row, end, data[starts[row] : starts[end]], starts[row : end + 1] - starts[row]
        row = end


@lru_cache(maxsize=8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    return of(_ODD), of(pow(_ODD, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of stretches of bytes, wherever they stand: sums of powers, made even."""
    power, inverse = _powers(1 << max(10, int(len(data)).bit_length()))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_ODD))


def _pieces(blank: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs without blanks; a run ends with its text."""
    n = len(blank)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begin, close = ~blank, ~blank
    begin[1:] &= blank[:-1] | edge[1:n]
    close[:-1] &= blank[1:] | edge[1:n]
    return np.flatnonzero(begin), np.flatnonzero(close) + 1


def _stretches(data: np.ndarray, blanks: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cuts after blanks, about ``size`` apart: a long text needs no more memory than a short one."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + 2 * size)
        if end < n:
            inside = np.flatnonzero(blanks[data[at:end]])
            if len(inside):
                end = at + int(inside[-1]) + 1
            else:
                beyond = np.flatnonzero(blanks[data[end:]])
                end = end + int(beyond[0]) + 1 if len(beyond) else n
        yield at, end
        at = end


def word_hashes_many(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (between ASCII white space, A-Z lower-cased), and each text's first."""
    found, begins = [], []
    for at, end in _stretches(data, _BLANK, SLICE):
        part = data[at:end]
        inner = starts[(starts >= at) & (starts <= end)] - at
        begin, close = _pieces(_BLANK[part], inner)
        found.append(span_hashes(_LOWER[part], begin, close))
        begins.append(begin + at)
    if not found:
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    return np.concatenate(found), np.searchsorted(np.concatenate(begins), starts)


def word_hashes(text: str | None) -> np.ndarray:
    """The same for one text."""
    return word_hashes_many(*joined_bytes([text or ""]))[0]


def shingles_many(words: np.ndarray, starts: np.ndarray, size: int) -> list[np.ndarray]:
    """Distinct, sorted hashes of each text's ``size``-word shingles; fewer words are one shingle."""
    wide = max(0, len(words) - size + 1)
    rolled = np.full(wide, size, np.uint64)
    for i in range(size):
        rolled = mix(rolled * np.uint64(_ODD) + words[i : i + wide])
    out = []
    for first, last in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if last - first >= size:
            own = np.sort(rolled[first : last - size + 1])
            fresh = own[1:] != own[:-1]
            out.append(own if fresh.all() else own[np.concatenate(([True], fresh))])
        else:
            own = np.full(min(1, last - first), last - first, np.uint64)
            for word in words[first:last]:
                own = mix(own * np.uint64(_ODD) + word)
            out.append(own)
    return out


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """The same for one text."""
    return shingles_many(words, np.array([0, len(words)]), size)[0]


def unit_interval(hashes: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1]."""
    return ((hashes >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


# --------------------------------------------------------------------------- token ids


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Classes of bytes: blank, letter, digit, punctuation, and what only the tokenizer can judge.
BLANK, LETTER, DIGIT, MARK, OTHER = range(5)
_CLASS = np.array(
    [
        BLANK if _BLANK[b]
        else LETTER if chr(b).isalpha() and b < 128
        else DIGIT if 48 <= b <= 57
        else MARK if 33 <= b <= 126 and b != 39
        else OTHER
        for b in range(256)
    ],
    np.uint8,
)


class WordEncoder:
    """Token ids of whole texts, equal to the tokenizer's, found once per distinct unit.

    The vocabulary drops white space and never joins over it, so the ids of a text are
    those of its pieces between blanks.  A piece of Latin letters, digits and marks falls
    into runs of letters, single digits and runs of marks, which go to the vocabulary's
    merges one by one; any other piece is a unit of its own and goes through the whole
    tokenizer.  The name of an added token in a text is that token, and ends the piece before it.  Units are known again by a 64-bit hash in a table of two places each; at
    ``limit`` units the table starts anew, so its size is bounded.
    """

    def __init__(self, path: str, limit: int = 1_000_000, places: int = 1 << 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in added.values()):
            raise ValueError("added tokens are only known where their names stand in a text as they are")
        self.added = {t.content.encode(): i for i, t in added.items()}
        self.letters = _byte_letters()
        self.limit, self.places = limit, places
        self._clear()

    def _clear(self) -> None:
        self.hashes = np.zeros(self.places, np.uint64)
        self.unit_at = np.full(self.places, -1, np.int32)
        self.ids = np.empty(1 << 16, np.uint32)
        self.first = np.zeros(1 << 16, np.int64)  # of unit i; i + 1 has its end
        self.units = 0

    def _spell(self, raw: bytes, plain: bool) -> list[int]:
        if plain:
            return [t.id for t in self.tokenizer.model.tokenize(raw.decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(raw.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids

    def _learn(self, keys: np.ndarray, raws: list[bytes], plain: list[bool]) -> np.ndarray:
        """Numbers of new units, whose hashes are ``keys``."""
        spelt = [self._spell(r, p) for r, p in zip(raws, plain, strict=True)]
        sizes = np.array([len(s) for s in spelt], np.int64)
        at, n = int(self.first[self.units]), len(keys)
        while at + int(sizes.sum()) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while self.units + n + 1 > len(self.first):
            self.first = np.concatenate((self.first, np.zeros_like(self.first)))
        self.ids[at : at + int(sizes.sum())] = np.fromiter((i for s in spelt for i in s), np.uint32, int(sizes.sum()))
        self.first[self.units + 1 : self.units + n + 1] = at + np.cumsum(sizes)
        numbers = np.arange(self.units, self.units + n)
        self.units += n
        one, two = self._places_of(keys)
        place = np.where((self.unit_at[one] >= 0) & (self.unit_at[two] < 0), two, one)
        self.hashes[place], self.unit_at[place] = keys, numbers
        return numbers

    def _places_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mask = np.uint64(self.places - 1)
        return (keys & mask).astype(np.int64), ((keys >> np.uint64(40)) & mask).astype(np.int64)

    def _numbers(self, keys: np.ndarray, raw_of: Callable[[int], tuple[bytes, bool]]) -> np.ndarray:
        one, two = self._places_of(keys)
        found = np.where(self.hashes[one] == keys, self.unit_at[one], -1)
        other = found < 0
        found[other] = np.where(self.hashes[two[other]] == keys[other], self.unit_at[two[other]], -1)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh, example, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            told = [raw_of(int(missing[i])) for i in example]
            found[missing] = self._learn(fresh, [t[0] for t in told], [t[1] for t in told])[back]
        return found

    def many(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (unsigned 32-bit) of all texts, and each text's first."""
        ids, begins, firsts, done = [], [], [], 0
        for at, end in _stretches(data, _BLANK, SLICE):
            if self.units > self.limit:
                self._clear()
            own, begin, first = self._stretch(data[at:end], starts[(starts >= at) & (starts <= end)] - at)
            ids.append(own)
            begins.append(begin + at)
            firsts.append(first + done)
            done += len(own)
        if not ids:
            return np.empty(0, np.uint32), np.zeros(len(starts), np.int64)
        place = np.concatenate([*firsts, [done]])
        return np.concatenate(ids), place[np.searchsorted(np.concatenate(begins), starts)]

    def _added(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins, ends and ids of the added tokens of a stretch; a name lies within one text."""
        found, raw = [], data.tobytes()
        for name, own in self.added.items():
            at = raw.find(name)
            while at >= 0:
                end = at + len(name)
                if np.searchsorted(starts, at, "right") == np.searchsorted(starts, end, "left"):
                    found.append((at, end, own))
                at = raw.find(name, end)
        begin, end, own = np.array(sorted(found), np.int64).reshape(-1, 3).T
        return begin, end, own.astype(np.uint32)

    def _stretch(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a stretch, and the begin and first id of each of its units."""
        at, close, own = self._added(data, starts)
        ids, unit, place = self._ordinary(data, starts, list(zip(at.tolist(), close.tolist(), strict=True)))
        if not len(at):
            return ids, unit, place
        before = np.searchsorted(unit, at)
        size = np.insert(np.diff(np.append(place, len(ids))), before, 1)
        ids = np.insert(ids, np.append(place, len(ids))[before], own)
        return ids, np.insert(unit, before, at), np.cumsum(size) - size

    def _ordinary(self, data: np.ndarray, starts: np.ndarray, without: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for what stands outside the stretches ``without``."""
        kind, low = _CLASS[data], _LOWER[data]
        for begin, end in without:
            kind[begin:end] = BLANK
        lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for two signs
        tail = data[lead + 1]
        letter = (tail != 0x97) & (tail != 0xB7)
        kind[lead[letter]] = kind[lead[letter] + 1] = LETTER
        low[lead[letter & (tail < 0x9F)] + 1] += 32
        piece, piece_end = _pieces(kind == BLANK, starts)
        begin = kind != BLANK
        begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begin[piece] = True
        unit = np.flatnonzero(begin)
        of_piece = np.cumsum(np.isin(unit, piece, assume_unique=True)) - 1 if len(unit) != len(piece) else np.arange(len(unit))
        strange = np.zeros(len(piece), bool)
        strange[np.searchsorted(piece, np.flatnonzero(kind == OTHER), "right") - 1] = True
        if strange.any():
            kept = ~strange[of_piece] | (unit == piece[of_piece])
            unit, of_piece = unit[kept], of_piece[kept]
        if not len(unit):
            return np.empty(0, np.uint32), unit, unit
        end = np.minimum(np.append(unit[1:], len(data)), piece_end[of_piece])
        number = self._numbers(
            span_hashes(low, unit, end), lambda i: (low[unit[i] : end[i]].tobytes(), not strange[of_piece[i]])
        )
        first = self.first[number]
        size = self.first[number + 1] - first
        place = np.cumsum(size) - size
        ids = self.ids[np.repeat(first - place, size) + np.arange(int(size.sum()))]
        return ids, unit, place

    def __call__(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        return self.many(*joined_bytes([text or ""]))[0].astype("<u4").tobytes()


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary file."""
    return WordEncoder(path)


def encoded(column: pa.Array, encoder: WordEncoder, end: bytes) -> Iterator[bytes]:
    """Ids of every text of a column, each closed by ``end``."""
    for _, _, data, starts in slices(column):
        ids, first = encoder.many(data, starts)
        raw = ids.astype("<u4").tobytes()
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield raw[4 * a : 4 * b] + end


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --------------------------------------------------------------------------- batches


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[str | None]:
    """The texts of a batch one by one, so that few are held at a time."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py()


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns; others, whatever they are called, stay out of the job."""
    return df.select(*names)


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once into the shared folder and read again: survives lost executors."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
