"""Near-duplicate classes by SetSketch registers.

A document is the set of its word shingles.  Its sketch has registers that keep, on an
exponential scale, the truncated minimum of exponentially spaced hash values: the
register-wise maximum of two sketches is the sketch of the union, and two registers agree
about as often as the sets overlap.  Bands of register values propose pairs, a joint
likelihood estimate drops most of the wrong ones, and full sets confirm the rest.

Equal sets are one class from the start, however many copies there are.  First each class
is compared to one other that shares a band value, which joins most of what belongs
together.  Under a band value that still holds several components, every member outside
the largest one meets all members of other components, in blocks of bounded size; a
block emits a link only where it joins components it has not joined yet.  So every pair
that shares a band value and might link two components is looked at, and neither pairs
nor links of a group are ever listed.

Defined results: a null text, or one without words, has the empty set, is linked with
nothing, and is its own component; rows without an id are never linked and are kept, with
null as component; rows with one id are one document, which links all sets it has (a row of
it without words stands alone); an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.textops import mix, plain, shingles_many, slices, stored, unit_interval, word_hashes_many

#: Registers, rows of a band, and the sketch's scale: base and rate of the register values.
REGISTERS, ROWS = 240, 6
BASE, RATE = 1.001, 20.0
TOP = 65_534
#: Standard errors by which an estimate may fall short of the threshold.
SLACK = 4.5


# --------------------------------------------------------------------------- sketch


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (unsigned 16-bit) of sets of distinct 64-bit hashes, a row for each.

    Each element has its values at the registers in a random order of its own (a shuffle,
    made as far as it is needed), in increasing size; so only the first few of an element can change a register, and the elements
    leave the loop as soon as their next value is too large for all registers.
    """
    registers = np.zeros(len(sets) * REGISTERS, np.int64)
    hashes = np.concatenate([np.empty(0, np.uint64), *sets])
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    log = np.log(BASE)
    for at in range(0, len(hashes), _ELEMENTS):
        state, row = hashes[at : at + _ELEMENTS], rows[at : at + _ELEMENTS]
        first, own = int(row[0]), registers[int(row[0]) * REGISTERS : (int(row[-1]) + 1) * REGISTERS]
        row = row - first
        value = np.zeros(len(state))
        # the registers each element has yet to meet are the end of its order; the next is drawn from them
        order = np.tile(_ALL, len(state))
        begin = np.arange(len(state)) * REGISTERS
        for step in range(REGISTERS):
            state = mix(state + np.uint64(0x9E3779B97F4A7C15))
            value = value - np.log(unit_interval(state)) / (RATE * (REGISTERS - step))
            level = np.clip(np.floor(1 - np.log(value) / log), 0, TOP).astype(np.int64)
            drawn = begin + step + (mix(state ^ np.uint64(0xA5A5A5A5)) % np.uint64(REGISTERS - step)).astype(np.int64)
            place = order[drawn]
            order[drawn] = order[begin + step]
            np.maximum.at(own, row * REGISTERS + place, level)
            alive = level > own.reshape(-1, REGISTERS).min(1)[row]
            if not alive.all():
                state, value, begin, row = state[alive], value[alive], begin[alive], row[alive]
            if len(state) == 0:
                break
    return registers.reshape(-1, REGISTERS).astype("<u2")


#: Elements whose orders are held at once, and the registers before any is drawn.
_ELEMENTS = 1 << 16
_ALL = np.arange(REGISTERS, dtype=np.uint8)


def merge(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(left, right)


def cardinality(registers: np.ndarray) -> float:
    """Estimated number of elements."""
    total = np.power(BASE, -registers.astype(np.float64)).sum()
    return REGISTERS * (1 - 1 / BASE) / (RATE * np.log(BASE) * total)


def resemblance(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard of rows of sketches, given both numbers of elements.

    Registers are larger on the left, larger on the right, or equal, with chances that
    depend on the Jaccard similarity and the shares of the two sets; the likelihood of
    the three counts is maximal where its derivative is 0, found by halving.
    """
    more = (left > right).sum(1).astype(np.float64)
    less = (left < right).sum(1).astype(np.float64)
    equal = left.shape[1] - more - less
    share = n_left / np.maximum(1, n_left + n_right)
    other = 1 - share
    low = np.zeros(len(more))
    high = np.minimum(np.minimum(share / np.maximum(other, 1e-12), other / np.maximum(share, 1e-12)), 1.0)
    scale = (BASE - 1) / BASE

    def chance(x):
        return -np.log1p(-np.clip(x, 0, 1) * scale) / np.log(BASE)

    def slope(x):
        return scale / (1 - np.clip(x, 0, 1) * scale) / np.log(BASE)

    top = high.copy()
    for _ in range(24):
        j = (low + high) / 2
        a, b = share - other * j, other - share * j
        pa_, pb = chance(a), chance(b)
        da, db = -other * slope(a), -share * slope(b)
        rest = np.maximum(1e-12, 1 - pa_ - pb)
        gradient = more * da / np.maximum(pa_, 1e-12) + less * db / np.maximum(pb, 1e-12) - equal * (da + db) / rest
        low = np.where(gradient > 0, j, low)
        high = np.where(gradient > 0, high, j)
    return np.minimum((low + high) / 2, top)


# --------------------------------------------------------------------------- per document


def _describer(size: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, nodes, registers = [], [], []
            for _, _, data, starts in slices(batch.column(2)):
                sets = shingles_many(*word_hashes_many(data, starts), size)
                counts += [len(own) for own in sets]
                nodes += [xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None for own in sets]
                registers += [r.tobytes() for r in sketches(sets)]
            columns = [pa.array(counts, pa.int64()), pa.array(nodes, pa.binary()), pa.array(registers, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], ["doc_id", "text_hash", "n_shingles", "node", "registers"]
            )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 64-bit key for each band of each sketch."""
    bands = REGISTERS // ROWS
    for batch in batches:
        n = batch.num_rows
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(n, bands, ROWS).astype(np.uint64)
        band = np.broadcast_to(np.arange(bands), (n, bands))
        key = band.astype(np.uint64)
        for i in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + registers[:, :, i] + np.uint64(1))
        nodes = batch.column(0).take(pa.array(np.repeat(np.arange(n), bands)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.ravel().view(np.int64)), pa.array(band.ravel().astype(np.int16)), nodes], ["key", "band", "node"]
        )


def _floor(threshold: float) -> float:
    return threshold - SLACK * (threshold * (1 - threshold) / REGISTERS) ** 0.5


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verifier(threshold: float, percent: int):
    """Pairs whose estimate is near the threshold or above, and whose full sets confirm it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(n, REGISTERS) for i in (2, 3))
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in batch.column(i)] for i in (4, 5))
            sizes = [np.array([len(v) for v in side], np.float64) for side in (x, y)]
            good = resemblance(a, b, *sizes) >= _floor(threshold)
            for i in np.flatnonzero(good):
                good[i] = _linked(x[i], y[i], percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole runs of rows with equal ``key, mb, pb``, and where each begins; the rows come sorted by these."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        starts = _starts(table)
        if len(starts) > 1:
            yield table.slice(0, int(starts[-1])), starts[:-1]
        held = table.slice(int(starts[-1])).combine_chunks() if len(starts) else None
    if held is not None:
        yield held, _starts(held)


def _starts(table: pa.Table) -> np.ndarray:
    if not table.num_rows:
        return np.empty(0, np.int64)
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for name in ("key", "mb", "pb"):
        column = table.column(name).to_numpy()
        new[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(new)


#: Pairs whose estimate is computed at once.
_PAIRS = 20_000


def _block_linker(threshold: float, percent: int):
    """Links between components: the pivots of every run against its members.

    A pair of two pivots is looked at once, and every pair under its first common band
    only.  What a task has joined already needs no further link.
    """

    def pairs_of(start: int, end: int, rows: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        run = np.arange(start, end)
        pivots, members = run[rows["pivot"][start:end]], run[~rows["pivot"][start:end]]
        theirs = rows["registers"][members]
        for pivot in pivots:
            open_ = rows["label"][members] != rows["label"][pivot]
            open_ &= ~(rows["minor"][members] & (rows["node"][members] <= rows["node"][pivot]))
            chosen = np.flatnonzero(open_)
            if not len(chosen):
                continue
            equal = (theirs[chosen] == rows["registers"][pivot]).reshape(len(chosen), -1, ROWS).all(2)
            chosen = members[chosen[equal.argmax(1) == rows["band"][pivot]]]
            if len(chosen):
                yield np.full(len(chosen), pivot), chosen

    def confirmed(found: list[tuple[np.ndarray, np.ndarray]], rows: dict, joined: _Joined) -> list[tuple]:
        left, right = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        like = resemblance(rows["registers"][left], rows["registers"][right], rows["size"][left], rows["size"][right])
        links = []
        for i in np.argsort(-like, kind="stable"):
            if like[i] < _floor(threshold):
                break
            x, y = int(left[i]), int(right[i])
            if joined.apart(rows["names"][x], rows["names"][y]) and _linked(rows["sets"][x], rows["sets"][y], percent):
                joined.join(rows["names"][x], rows["names"][y])
                links.append((rows["nodes"][x], rows["nodes"][y]))
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined = _Joined()
        for table, starts in _runs(batches):
            names = table.column("label").to_pylist()
            nodes = table.column("node").to_pylist()
            rank = {v: i for i, v in enumerate(sorted(set(nodes)))}
            code = {v: i for i, v in enumerate(dict.fromkeys(names))}
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in table.column("shingles")]
            rows = {
                "names": names, "nodes": nodes, "sets": sets, "size": np.array([len(v) for v in sets], np.float64),
                "node": np.array([rank[v] for v in nodes]), "label": np.array([code[v] for v in names]),
                "pivot": table.column("pivot").to_numpy(), "minor": table.column("minor").to_numpy(),
                "band": table.column("band").to_numpy(),
                "registers": np.frombuffer(b"".join(table.column("registers").to_pylist()), "<u2").reshape(-1, REGISTERS),
            }
            links, waiting, held = [], [], 0
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), table.num_rows], strict=True):
                for pair in pairs_of(start, end, rows):
                    waiting.append(pair)
                    held += len(pair[0])
                    if held >= _PAIRS:
                        links += confirmed(waiting, rows, joined)
                        waiting, held = [], 0
            if waiting:
                links += confirmed(waiting, rows, joined)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in (0, 1)], ["a", "b"])

    return run


class _Joined:
    """Components that a task has joined so far."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x: bytes) -> bytes:
        while (up := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(up, up)
            x = up
        return x

    def apart(self, x: bytes, y: bytes) -> bool:
        return self.root(x) != self.root(y)

    def join(self, x: bytes, y: bytes) -> None:
        self.parent[self.root(x)] = self.root(y)


# --------------------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of every node's component, for edges ``a, b``.

    Alternating large and small stars: each step hangs neighbours below the least node
    they know of, by a grouped minimum and a join, until nothing changes.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(e: DataFrame) -> DataFrame:
        arcs = both(e)
        least = arcs.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return arcs.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        hung = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return hung.union(least.select("a", F.col("m").alias("b"))).distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = state(current)
    while seen[0]:
        current = stored(small(large(current)), "edges")
        now = state(current)
        if now == seen:
            break
        seen = now
    labelled = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labelled.union(current.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()


# --------------------------------------------------------------------------- links


#: Members of a band value that one task compares at a time, and their shingles together.
BLOCK_MEMBERS, BLOCK_SHINGLES = 512, 200_000


def _with_sets(nodes: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """node, n, registers and full sets of the classes that share a band value with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [own.tobytes() for _, _, *raw in slices(batch.column(3)) for own in shingles_many(*word_hashes_many(*raw), size)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["node", "n", "registers", "shingles"])

    texts = docs.join(nodes, ["doc_id", "text_hash"]).select("node", "n", "registers", "text")
    found = texts.mapInArrow(run, "node binary, n long, registers binary, shingles binary")
    # rows that repeat an id and a text give the same set
    return found.groupBy("node").agg(*[F.min(c).alias(c) for c in ("n", "registers", "shingles")])


def links(classes: DataFrame, docs: DataFrame, size: int, threshold: float, known: DataFrame) -> DataFrame:
    """node and label of all classes that are linked to others; the least node of a component is its label.

    ``classes`` has node, doc_id, text_hash, n and registers; ``docs`` doc_id, text_hash and text;
    ``known`` has links ``a, b`` that hold beforehand.
    """
    percent = round(100 * threshold)
    keys = classes.select("node", "registers").mapInArrow(_bands, "key long, band short, node binary").repartition("key")
    shared = keys.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    members = stored(keys.join(shared, "key", "left_semi"), "members")
    if members.isEmpty():
        return components(known)
    nodes = classes.join(members.select("node").distinct(), "node", "left_semi")
    sets = stored(_with_sets(nodes, docs, size), "sets")

    # one comparison for each member: with the least node it shares a band value with
    least = members.groupBy("key").agg(F.min("node").alias("p"))
    pairs = members.join(least, "key").where("p < node").groupBy("node").agg(F.min("p").alias("p"))
    sides = [sets.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "registers", "shingles")]) for c in ("a", "b")]
    first = (
        pairs.select(F.col("p").alias("a"), F.col("node").alias("b"))
        .join(sides[0], "a")
        .join(sides[1], "b")
        .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        .select("a", "b", "registers_a", "registers_b", "shingles_a", "shingles_b")
        .mapInArrow(_verifier(threshold, percent), "a binary, b binary")
    )
    first = stored(first, "links")

    # under values with several components: all members outside the largest meet the others
    # each class hangs below one other at most; two steps up are enough to tell most components apart
    below = first.select(F.col("b").alias("node"), F.col("a").alias("up"))
    above = below.select(F.col("node").alias("up"), F.col("up").alias("top"))
    label = below.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("label"))
    now = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    now = stored(now.join(sets.select("node", "n"), "node"), "labelled")
    parts = now.groupBy("key", "label").agg(F.count("*").alias("k"), F.sum("n").alias("n"))
    whole = parts.groupBy("key").agg(
        F.count("*").alias("labels"), F.max_by("label", F.struct("k", "label")).alias("major"),
        F.sum("k").alias("k"), F.sum("n").alias("n"), F.max(F.struct("k", "label", "n")).alias("top"),
    )
    blocks = lambda k, n: F.greatest(F.ceil(k / BLOCK_MEMBERS), F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")
    open_ = whole.where("labels > 1").select(
        "key", "major", blocks(F.col("k"), F.col("n")).alias("mbs"),
        blocks(F.col("k") - F.col("top.k"), F.col("n") - F.col("top.n")).alias("pbs"),
    )
    held = now.join(open_, "key").withColumn("minor", F.col("label") != F.col("major"))
    place = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    names = ["key", "band", "node", "label", "minor"]
    as_member = held.select(*names, F.lit(False).alias("pivot"), place("mbs").alias("mb"), every("pbs").alias("pb"))
    as_pivot = held.where("minor").select(*names, F.lit(True).alias("pivot"), every("mbs").alias("mb"), place("pbs").alias("pb"))
    met = as_member.union(as_pivot).join(sets.select("node", "registers", "shingles"), "node")
    runs = met.repartition("key", "mb", "pb").sortWithinPartitions("key", "mb", "pb")
    second = runs.mapInArrow(_block_linker(threshold, percent), "a binary, b binary")
    return components(stored(first.union(second).union(known), "all-links"))


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id and kept, one row per row of ``docs``."""
    docs = plain(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64("text"))
    schema = "doc_id long, text_hash long, n_shingles long, node binary, registers binary"
    described = stored(docs.select("doc_id", "text_hash", "text").mapInArrow(_describer(size), schema), "described")
    sets = described.where("doc_id is not null and node is not null")
    row = F.min(F.struct("doc_id", "text_hash")).alias("row")
    classes = sets.groupBy("node").agg(row, F.min("n_shingles").alias("n"), F.min("registers").alias("registers"))
    classes = stored(classes.select("node", "row.*", "n", "registers"), "classes")
    # rows with one id but different texts are one document, which may stand in several classes
    several = sets.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last")).where("a <> last")
    known = stored(sets.join(several, "doc_id").where("node <> a").select("a", F.col("node").alias("b")).distinct(), "known-links")
    label_of = links(classes, docs, size, threshold, known)
    rooted = classes.join(label_of, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    least = rooted.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    known = rooted.join(least, "label").select("node", "component_id")
    return (
        described.drop("registers")
        .join(known, "node", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
    )
