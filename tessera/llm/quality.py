"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages.  Every passage of the whole text is encoded from its
bytes, a gated attention network gives each passage a weight, and the weighted mean of
the passage codes is scored.  Labels belong to documents only; which passages matter is
learned from them.

Defined results: a null or empty text is one passage without content, which gets a score
like any other; without labels, or with labels of one class, every score is the share of
good labels (0.5 without any); rows with a null or repeated id are scored row by row; an
empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.textops import mix

#: Bytes of a passage.
PASSAGE = 512
#: Byte classes, hashed pairs of neighbours, and four ratios.
CLASSES, PAIRS = 14, 64
FEATURES = CLASSES + PAIRS + 4
#: Documents learned from at most: the labelled ones with the least hash of their id.
TRAIN_DOCS = 6000
#: Bytes of their texts together at most, and of the rows of one of them; a longer one is not learned from.
TRAIN_BYTES, TRAIN_ROW = 32 << 20, 1 << 19


def _byte_classes() -> np.ndarray:
    kinds = np.full(256, 10, np.int64)
    for kind, members in enumerate(
        (range(97, 123), range(65, 91), range(48, 58), b" \t", b"\n\r", b".", b",", b"|", b"!?", b"#$%&*~^=")
    ):
        kinds[list(members)] = kind
    kinds[:9] = kinds[14:32] = kinds[127] = 13
    kinds[128:192], kinds[192:] = 11, 12
    return kinds


_CLASS = _byte_classes()


def encode_passages(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the first row of each text."""
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.array([len(r) for r in raws], np.int64)
    passages = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate(([0], np.cumsum(passages)))
    data = np.frombuffer(b"".join(raws), np.uint8)
    out = np.zeros((int(first[-1]), FEATURES), np.float32)
    if len(data):
        start = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        own = np.repeat(first[:-1], sizes) + (np.arange(len(data)) - np.repeat(start, sizes)) // PASSAGE
        n = int(first[-1])
        counts = np.bincount(own * CLASSES + _CLASS[data], minlength=n * CLASSES).reshape(n, CLASSES)
        length = counts.sum(1)
        total = np.maximum(1, length)[:, None]
        out[:, :CLASSES] = np.sqrt(counts / total)
        low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint64)
        pair = (mix(low[:-1] * np.uint64(257) + low[1:] + np.uint64(1)) % np.uint64(PAIRS)).astype(np.int64)
        inner = own[:-1] == own[1:]
        counts = np.bincount((own[:-1] * PAIRS + pair)[inner], minlength=n * PAIRS).reshape(n, PAIRS)
        out[:, CLASSES:-4] = np.sqrt(counts / total)
        again = np.bincount(own[:-1][inner & (data[:-1] == data[1:])], minlength=n) / total[:, 0]
        change = np.bincount(own[:-1][inner & (_CLASS[data[:-1]] != _CLASS[data[1:]])], minlength=n) / total[:, 0]
        out[:, -4:] = np.stack([again, change, length / PASSAGE, _repeats(low, own, n)], 1)
    return out, first


def _repeats(low: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Share of the words of each passage that equal the word before."""
    letter = (_CLASS[low.astype(np.uint8)] < 3) | (low >= 128)
    begins = np.flatnonzero(letter & np.concatenate(([True], ~letter[:-1] | (own[1:] != own[:-1]))))
    if len(begins) == 0:
        return np.zeros(n)
    place = np.flatnonzero(letter)
    word = np.searchsorted(begins, place, "right") - 1
    values = mix(low[place] + (place - begins[word]).astype(np.uint64) * np.uint64(256))
    starts = np.searchsorted(place, begins)
    code = np.add.reduceat(values, starts)
    passage = own[begins]
    same = (code[1:] == code[:-1]) & (passage[1:] == passage[:-1])
    return np.bincount(passage[1:][same], minlength=n) / np.maximum(1, np.bincount(passage, minlength=n))


@dataclass
class AttentionModel:
    """Passage code, gated attention and score; ``constant`` replaces it if nothing was learned."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    constant: float | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w, edges = self.weights, first[:-1]
        size = np.diff(first)
        h = np.tanh(((x - w["mean"]) / w["scale"]) @ w["enc"] + w["enc_b"])
        t, g = np.tanh(h @ w["tan"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        e = (t * g) @ w["att"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, edges), size))
        a = e / np.repeat(np.add.reduceat(e, edges), size)
        z = np.add.reduceat(h * a[:, None], edges, axis=0)
        score = 1 / (1 + np.exp(-(z @ w["out"] + w["out_b"][0])))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "score": score}

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        if not texts:
            return np.empty(0)
        return self.forward(*encode_passages(texts))["score"].astype(np.float64)


def gradients(model: AttentionModel, x: np.ndarray, first: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of some documents, for every weight that is learned."""
    w, size = model.weights, np.diff(first)
    f = model.forward(x, first)
    error = (f["score"] - labels) / len(labels)
    spread = np.repeat(error[:, None] * w["out"], size, axis=0)
    value = (spread * f["h"]).sum(1)
    mean = np.repeat(np.add.reduceat(f["a"] * value, first[:-1]), size)
    de = f["a"] * (value - mean)
    dt = (de[:, None] * w["att"]) * f["g"] * (1 - f["t"] ** 2)
    dg = (de[:, None] * w["att"]) * f["t"] * f["g"] * (1 - f["g"])
    dh = (spread * f["a"][:, None] + dt @ w["tan"].T + dg @ w["gate"].T) * (1 - f["h"] ** 2)
    scaled = (x - w["mean"]) / w["scale"]
    return {
        "enc": scaled.T @ dh, "enc_b": dh.sum(0), "tan": f["h"].T @ dt, "gate": f["h"].T @ dg,
        "att": (f["t"] * f["g"]).T @ de, "out": f["z"].T @ error, "out_b": np.array([error.sum()]),
    }


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 25) -> AttentionModel:
    """Adam on the logistic loss of the documents, in the order of a fixed seed."""
    if len(labels) == 0 or labels.min() == labels.max():
        return AttentionModel(constant=float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(7)
    rows = np.concatenate(bags)
    init = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    w = {
        "enc": init(FEATURES, hidden), "enc_b": np.zeros(hidden), "tan": init(hidden, attention),
        "gate": init(hidden, attention), "att": init(attention), "out": init(hidden), "out_b": np.zeros(1),
    }
    fixed = {"mean": rows.mean(0).astype(np.float64), "scale": rows.std(0).astype(np.float64) + 1e-3}
    model = AttentionModel(fixed | w)
    moment, square, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), 64):
            chosen = order[at : at + 64]
            x = np.concatenate([bags[i] for i in chosen])
            first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in chosen])))
            step += 1
            for k, g in gradients(model, x, first, labels[chosen]).items():
                g = g + 1e-4 * w[k]
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                w[k] -= 0.005 * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    return model


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows, _ = encode_passages([text.as_py()])
            yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([rows.tobytes()], pa.binary())], ["label", "rows"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = TRAIN_DOCS) -> AttentionModel:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality).

    All passages of at most ``sample`` documents of :data:`TRAIN_BYTES` together reach the
    driver.  A document with labels of both values counts as bad.
    """
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    # at most `sample` narrow rows, so they are broadcast and no text is shuffled
    first = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    bytes_ = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).alias("size")
    sizes = docs.select("doc_id", "text").join(F.broadcast(first), "doc_id").groupBy("doc_id", "label").agg(bytes_)
    # a running sum over at most `sample` narrow rows
    until = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fitting = sizes.where(F.col("size") <= TRAIN_ROW).withColumn("total", F.sum("size").over(until))
    chosen = fitting.where(F.col("total") <= TRAIN_BYTES).select("doc_id", "label")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")
    found = texts.mapInArrow(_bags, "label int, rows binary").collect()
    found.sort(key=lambda r: (bytes(r["rows"]), r["label"]))
    bags = [np.frombuffer(bytes(r["rows"]), np.float32).reshape(-1, FEATURES) for r in found]
    return fit(bags, np.array([r["label"] for r in found], np.float64))


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """``docs`` with ``score`` (0 to 1), from the whole text; no shuffle."""
    kept = docs.select(*[n for n in docs.columns if n != "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            scores, held, size = [], [], 0
            for value in texts:  # a few megabytes of text at a time
                held.append(value.as_py())
                size += len(held[-1] or "")
                if size > 1 << 20:
                    scores.append(model.score(held))
                    held, size = [], 0
            scores.append(model.score(held))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], [*batch.schema.names, "score"])

    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return kept.mapInArrow(run, f"{fields}, score double")


def held_out(doc_id: Column) -> Column:
    """Documents whose label is never learned: crc32 of the id as text is a multiple of 5 (never null)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
