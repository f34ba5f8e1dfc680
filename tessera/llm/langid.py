"""Language identification by rank-order profiles of character n-grams.

A language's profile is its most frequent n-grams in order; a document is compared to
every profile by the out-of-place distance: how far each of the document's most frequent
n-grams stands from its place in the profile, with the profile's length for those that
are missing.  The language at the least distance is predicted.

Defined results: a text that is null or has no letter is ``und`` with score 0; equal
distances go to the first language in order; without any labelled text everything is
``und``; rows with a null or repeated id keep one result per row; an empty table gives
no rows.  Columns other than those named are passed through by ``identify``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.textops import stored, texts_of

UNKNOWN = "und"
#: n-grams of 1 to this many characters.
LONGEST = 4
#: The blank around a word; not 0, as an n-gram that begins with it would equal the one without.
BLANK = 1
#: Places of a profile, for languages and documents alike.
PLACES = 400
#: n-grams counted at once, and counts that a task holds.
HELD_GRAMS, HELD_COUNTS = 1 << 20, 1 << 21
#: Labelled texts of a language that :func:`sampled` takes by default.
SAMPLE = 1500
#: A text is taken for a language from this part of the score that 99 % of its learned texts reach.
MARGIN = 0.5
#: Letters from which a text's score can reject it.
FEW = 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point: a number of 16 bits above :data:`BLANK` if a letter, else 0."""
    codes = np.arange(0x110000, dtype=np.uint32)
    letter = np.array([chr(c).isalpha() for c in range(0x110000)])
    return np.where(letter, codes % 65_521 + 1 + BLANK, 0).astype(np.uint64)


def grams(text: str | None) -> np.ndarray:
    """Codes of all n-grams of letters, words padded by one blank; empty without letters."""
    if not text:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kept = np.zeros(len(raw) + 2, np.uint64)
    kept[1:-1] = _letters()[raw]
    word = kept > 0
    if not word.any():
        return np.empty(0, np.uint64)
    kept[~word] = BLANK
    inside = word.copy()  # one blank before and after a word
    inside[1:] |= word[:-1]
    inside[:-1] |= word[1:]
    chars = kept[inside]
    again = (chars[1:] == BLANK) & (chars[:-1] == BLANK)
    if again.any():
        chars = chars[np.concatenate(([True], ~again))]
    out, code = [chars[chars > BLANK]], chars
    for n in range(2, LONGEST + 1):
        code = (code[:-1] << np.uint64(16)) | chars[n - 1 :]
        inner = np.ones(len(code), bool)
        for i in range(1, n - 1):  # a blank stands at an end of an n-gram only
            inner &= chars[i : i + len(code)] > BLANK
        out.append(code[inner])
    return np.concatenate(out)


def ranked(codes: np.ndarray) -> np.ndarray:
    """The most frequent codes in order, ties by code."""
    values, counts = _counted(codes)
    if len(values) > PLACES:
        few = counts >= np.partition(counts, len(counts) - PLACES)[len(counts) - PLACES]
        values, counts = values[few], counts[few]
    return values[np.argsort(-counts, kind="stable")[:PLACES]]


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each stands there."""
    if len(codes) == 0:
        return codes, np.empty(0, np.int64)
    codes = np.sort(codes)
    edges = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1], [True])))
    return codes[edges[:-1]], np.diff(edges)


class Profiles:
    """Profiles of all languages, and the distance of a document to each."""

    def __init__(self, ranks: dict[str, list[int]]):
        self.languages = sorted(ranks)
        self.codes, self.places = [], []
        for language in self.languages:
            codes = np.array(ranks[language], np.int64).view(np.uint64)
            order = np.argsort(codes)
            self.codes.append(codes[order])
            self.places.append(np.arange(len(codes))[order])

    def identify(self, text: str | None) -> tuple[str, float]:
        codes = grams(text)
        if len(codes) == 0 or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(codes)
        places = np.arange(len(own))
        distances = []
        for codes, theirs in zip(self.codes, self.places, strict=True):
            at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
            found = codes[at] == own
            apart = np.where(found, np.abs(theirs[at] - places), PLACES)
            distances.append(int(np.minimum(apart, PLACES).sum()))
        best = int(np.argmin(distances))
        return self.languages[best], 1.0 - distances[best] / (PLACES * len(own))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of each language, summed over the batches of a task as far as they can be held."""
    fresh: dict[str, list[np.ndarray]] = {}  # codes not counted yet
    held: dict[str, int] = {}
    sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def add(language: str) -> None:
        values, counts = _counted(np.concatenate(fresh.pop(language)))
        held[language] = 0
        if language in sums:
            both = [np.concatenate(x) for x in zip(sums[language], (values, counts), strict=True)]
            values, at = np.unique(both[0], return_inverse=True)
            total = np.zeros(len(values), np.int64)
            np.add.at(total, at, both[1])
            counts = total
        sums[language] = values, counts

    def result(language: str) -> pa.RecordBatch:
        values, counts = sums.pop(language)
        columns = [pa.array([language] * len(values), pa.string()), pa.array(values.view(np.int64)), pa.array(counts)]
        return pa.RecordBatch.from_arrays(columns, ["lang", "code", "n"])

    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
            own = fresh.setdefault(language, [])
            own.append(grams(text))
            held[language] = held.get(language, 0) + len(own[-1])
            if held[language] > HELD_GRAMS:
                add(language)
                if sum(len(v) for v, _ in sums.values()) > HELD_COUNTS:
                    yield from map(result, [*sums])
    for language in [*fresh]:
        add(language)
    yield from map(result, [*sums])


def sampled(labelled: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, text, lang`` of the ``sample`` ids with the least hashes of each language, or of all if fewer.

    Rows of a language are counted on the map side; the share of the hash range that holds a
    fifth more than ``sample`` of them leaves a bounded rest to cut exactly, and what is cut at
    travels as one row a language (as the profiles do).  No text is shuffled.  Where ids
    repeat, a share may hold fewer than ``sample`` ids; all rows of a chosen id are taken.
    """
    known = labelled.select("doc_id", "text", "lang").where("lang is not null").withColumn("order", F.xxhash64("doc_id"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.least(F.lit(1.0), F.lit(sample * 1.2) / F.col("rows"))
    edge = F.lit(-(2.0**63)) + F.lit(2.0**64) * share
    near = known.select("lang", "order").join(F.broadcast(sizes.select("lang", edge.alias("edge"))), "lang").where("order <= edge")
    first = Window.partitionBy("lang").orderBy("order")
    nth = near.select("lang", "order").distinct().withColumn("nth", F.row_number().over(first))
    last = nth.where(F.col("nth") <= sample).groupBy("lang").agg(F.max("order").alias("last"))
    return known.join(F.broadcast(last), "lang").where("order <= last").select("doc_id", "text", "lang")


def _labelled(labelled: DataFrame, sample: int | None) -> DataFrame:
    """``doc_id, text, lang`` of all rows with a language, or of a :func:`sampled` part of them."""
    if sample is not None:
        return sampled(labelled, sample)
    return labelled.select("doc_id", "text", "lang").where("lang is not null")


def learn(labelled: DataFrame, sample: int | None = None) -> Profiles:
    """Profiles from ``doc_id, text, lang``: all texts, or those of at most ``sample`` ids for each language.

    Counting is distributed; the driver receives :data:`PLACES` codes for each language.
    """
    texts = _labelled(labelled, sample).select("lang", "text")
    counts = texts.mapInArrow(_tally, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # codes in order as unsigned numbers, like the documents'
    place = Window.partitionBy("lang").orderBy(F.desc("n"), (F.col("code") < 0), "code")
    top = counts.withColumn("place", F.row_number().over(place)).where(F.col("place") <= PLACES)
    ranks: dict[str, list[int]] = {}
    for row in sorted(top.select("lang", "place", "code").collect(), key=lambda r: (r["lang"], r["place"])):
        ranks.setdefault(row["lang"], []).append(row["code"])
    return Profiles(ranks)


def least_scores(labelled: DataFrame, profiles: Profiles, sample: int | None = None) -> dict[str, float]:
    """For every language, the least score at which a text is taken for it.

    That is :data:`MARGIN` of the score that 99 % of the texts learned from reach among
    those predicted right; a language that none is predicted for has no limit.
    """
    found = identify(_labelled(labelled, sample), profiles, pred="_pred", score="_score").where("_pred = lang")
    lows = percentiles(stored(found.select("lang", "_score"), "scores"), "lang", "_score", 0.01)
    return {language: MARGIN * low for language, low in lows.items()}


def percentiles(scores: DataFrame, key: str, score: str, part: float, bins: int = 4096) -> dict[str, float]:
    """The exact percentile ``part`` of the scores (0 to 1) of each key, between two of them as by ``percentile``.

    Scores are counted in bins; only those in the bins of the two scores wanted are put in
    order, each once with its count.  The driver receives the counts of bins and two scores of each key.
    """
    binned = scores.withColumn("_bin", F.floor(F.col(score) * bins).cast("int"))
    sizes: dict[str, dict[int, int]] = {}
    for row in binned.groupBy(key, "_bin").agg(F.count("*").alias("n")).collect():  # at most bins + 1 of a key
        sizes.setdefault(row[key], {})[row["_bin"]] = row["n"]
    wanted, at = [], {}
    for name, counts in sizes.items():
        at[name] = (sum(counts.values()) - 1) * part
        for nth in {int(np.floor(at[name])), int(np.ceil(at[name]))}:
            before = 0
            for number in sorted(counts):
                if before + counts[number] > nth:
                    break
                before += counts[number]
            wanted.append((name, number, nth, nth - before))
    if not wanted:
        return {}
    places = scores.sparkSession.createDataFrame(wanted, T.StructType([scores.schema[key], *(T.StructField(n, T.LongType()) for n in ("_bin", "nth", "place"))]))
    places = F.broadcast(places)
    distinct = binned.join(places.select(key, "_bin").distinct(), [key, "_bin"], "left_semi").groupBy(key, "_bin", score).agg(F.count("*").alias("n"))
    line = Window.partitionBy(key, "_bin").orderBy(score).rowsBetween(Window.unboundedPreceding, 0)
    reached = distinct.withColumn("upto", F.sum("n").over(line))
    hit = reached.join(places, [key, "_bin"]).where((F.col("place") < F.col("upto")) & (F.col("place") >= F.col("upto") - F.col("n")))
    found = {(r[key], r["nth"]): r[score] for r in hit.collect()}
    out = {}
    for name, x in at.items():
        low, high = found[name, int(np.floor(x))], found[name, int(np.ceil(x))]
        out[name] = low if low == high else (np.ceil(x) - x) * low + (x - np.floor(x)) * high
    return {name: float(x) for name, x in out.items()}


def recognised(docs: DataFrame, profiles: Profiles, limits: dict[str, float]) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language; columns as they are.

    A text without a letter goes, and one whose score is below its language's limit; the
    score of a text of fewer than :data:`FEW` letters says little, so such a text stays.
    """
    pred, score = "_language", "_language_score"
    while {pred, score} & set(docs.columns):
        pred, score = f"_{pred}", f"_{score}"
    found = identify(docs, profiles, pred=pred, score=score)
    limit = F.lit(0.0)
    for language, least in sorted(limits.items()):
        limit = F.when(F.col(pred) == language, F.lit(least)).otherwise(limit)
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    return found.where((F.col(pred) != UNKNOWN) & ((F.col(score) >= limit) | (letters < FEW))).select(*docs.columns)


def identify(docs: DataFrame, profiles: Profiles, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the columns ``pred`` and ``score`` (0 to 1); its other columns stay as they are.

    No shuffle; a task holds one text's n-grams.
    """
    names = [n for n in docs.columns if n not in (pred, score)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.identify(text) for text in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                [*batch.schema.names, pred, score],
            )

    kept = docs.select(*names)
    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(run, f"{fields}, `{pred}` string, `{score}` double")


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 1 by 3 (never null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
