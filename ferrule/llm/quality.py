"""Quality classifier: a linear support vector machine over naive Bayes features.

Features are indicators of hashed n-grams of whole texts: words and pairs of
them, the shapes of words and of pairs of them, and which of the last words a
word repeats.  Each
is scaled by the log-ratio of its smoothed shares of the two classes' counts,
and the vector by the root of the number of its features.  The hinge loss is
minimised by dual coordinate descent; a logistic curve, fitted on rows that the
machine has not seen, turns margins into scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import U, Words, ascii_lower, buffers, from_blob, mix, pieces, space_words
from .labelled import training_rows
from .store import ship

BITS = 18


def _shapes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B], table[0x61:0x7B], table[0x30:0x3A], table[0x80:] = ord("A"), ord("a"), ord("0"), ord("a")
    return table


def _squeeze(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters, digits and case as classes, with runs of one class (but of white space) as one byte."""
    shape = _shapes()[buf]
    keep = np.ones(len(buf), bool)
    keep[1:] = (shape[1:] != shape[:-1]) | ~space_words()[buf[1:]]
    keep[offsets[:-1][offsets[:-1] < len(buf)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return shape[keep], total[offsets]


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of each text, and where those of text d begin."""
    table = space_words()
    words = Words(buf, offsets, table, ascii_lower())
    shape = Words(*_squeeze(buf, offsets), table, None)
    n, h = len(words.h), words.h
    owner = np.repeat(np.arange(len(offsets) - 1), words.counts)
    same = np.zeros(n, np.int64)
    for back in (1, 2, 3):
        if n > back:
            same[back:] += ((h[back:] == h[:-back]) & (owner[back:] == owner[:-back])).astype(np.int64) << (back - 1)
    (two, both), (pair, valid) = words.grams(2), shape.grams(2)
    size = np.minimum(np.log2(words.counts + 1).astype(np.int64), 16)
    every = np.arange(len(offsets) - 1)
    hashed = [mix(h ^ U(0x11)), mix(shape.h ^ U(0x22)), mix(pair[valid] ^ U(0x33)), mix(same.astype(U) + U(0x44 << 32)), mix(size.astype(U) + U(0x55 << 32)), mix(two[both] ^ U(0x66))]
    owners = [owner, np.repeat(every, shape.counts), np.repeat(every, shape.counts)[: len(pair)][valid], owner, every, owner[: len(two)][both]]
    code = np.concatenate([(o.astype(U) << U(BITS)) | (x >> U(64 - BITS)) for o, x in zip(owners, hashed, strict=True)])
    code = np.unique(code)
    return (code & U((1 << BITS) - 1)).astype(np.uint32), np.searchsorted(code >> U(BITS), np.arange(len(offsets)))


def _each(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offsets = buffers(batch.column(column))
    for a, b in pieces(offsets):
        yield a, b, *features(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, found, first in _each(batch, 1):
            blob = pa.array([found[x:y].tobytes() for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), blob, batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a)], ["doc_id", "features", "y", "natural"])


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, found: np.ndarray, first: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(self.weight[found])])
        n = np.maximum(np.diff(first), 1)
        return (total[first[1:]] - total[first[:-1]]) / np.sqrt(n) + self.bias

    def scores(self, found: np.ndarray, first: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margins(found, first) + self.shift)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """Log-ratio of each feature's smoothed share of the counts of class 1 and of class 0."""
    counts = np.full((2, 1 << BITS), smooth)
    for row, label in zip(rows, y.tolist(), strict=True):
        counts[label][row] += 1
    share = counts / counts.sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear machine that minimises |w|^2/2 + cost * sum of hinge losses.  Classes weigh alike."""
    sign = np.where(y == 1, 1.0, -1.0)
    share = np.array([max((y == 0).sum(), 1), max((y == 1).sum(), 1)])
    upper = cost * len(y) / (2 * share[y])
    w, bias, alpha = np.zeros(size), 0.0, np.zeros(len(y))
    square = np.array([v @ v + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)).tolist():
            gradient = sign[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            if step := (new - alpha[i]) * sign[i]:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, y), with smoothed targets."""
    ones = int(y.sum())
    target = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * margin).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (h * margin * margin).sum() + 1e-3, (h * margin).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = a - step * da, b - step * db
        if max(abs(da), abs(db)) < 1e-6:
            break
    return max(a, 1e-3), b


def fit(rows: list[np.ndarray], y: np.ndarray, natural: np.ndarray) -> Model:
    """Fits the machine on three quarters of the rows, and the curve on the natural ones of the rest.

    With one class, or none, every text gets that class's smoothed share.
    """
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(p / (1 - p))))
    held = (np.arange(len(y)) % 4 == 3) & natural
    if not 0 < y[held].sum() < held.sum():
        held[:] = False
    use = np.flatnonzero(~held)
    r = ratios([rows[i] for i in use], y[use])
    values = [r[rows[i]] / np.sqrt(max(len(rows[i]), 1)) for i in use]
    w, bias = dual_descent([rows[i] for i in use], values, y[use], 1 << BITS)
    model = Model(w * r, bias, 1.0, 0.0)
    curve = np.flatnonzero(held) if held.any() else use
    found = np.concatenate([rows[i] for i in curve])
    first = np.concatenate([[0], np.cumsum([len(rows[i]) for i in curve])])
    model.slope, model.shift = logistic(model.margins(found, first), y[curve])
    return model


def fit_rows(got: list[tuple[int, bytes, int, bool]]) -> Model:
    """fit() of rows (doc_id, features, y, natural), in an order that doesn't depend on how they come."""
    got = sorted(got)
    got = [got[i] for i in np.random.default_rng(11).permutation(len(got)).tolist()]
    return fit([from_blob(x[1], np.uint32) for x in got], np.array([x[2] for x in got], np.int64), np.array([x[3] for x in got], bool))


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    m = fit_rows([row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)])
    columns = [[m.weight.tobytes()], [float(m.bias)], [float(m.slope)], [float(m.shift)]]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["weight", "bias", "slope", "shift"])


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, *, most: int = 6000, most_of_class: int = 2000) -> Model:
    """A model of `label`, from at most most + 2 * most_of_class labelled rows for which `allowed` holds.

    Those rows are fitted in one task; the driver gets the model alone.
    """
    ship(docs.sparkSession)
    chosen = training_rows(docs, labels, label, allowed, most, most_of_class)
    found = chosen.mapInArrow(_blobs, "doc_id long, features binary, y int, natural boolean")
    got = found.repartition(1).mapInArrow(_fitted, "weight binary, bias double, slope double, shift double").collect()
    return Model(from_blob(got[0]["weight"], np.float64), got[0]["bias"], got[0]["slope"], got[0]["shift"]) if got else fit_rows([])


def _score(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            kept = [(i, x) for i, x in enumerate(batch.schema.names) if x in names]
            parts = [m.scores(found, first) for _, _, found, first in _each(batch, batch.schema.names.index("text"))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i, _ in kept], pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], [*[x for _, x in kept], "score"])

    return run


def score(docs: DataFrame, model: Model, *, keep_text: bool = True) -> DataFrame:
    """docs with `score`: 0 to 1, higher where label 1 is likelier.  Only `text` is looked at.

    Without keep_text the result lacks that column, which spares its way back.

    A null text counts as empty.  Empty and white texts get the score of a
    text without n-grams.  Rows are kept as they are, repeated ones too.  A
    column named score is replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop("score")
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    kind = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "score double"])
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model), [f.name for f in fields]), kind)


def predicted() -> Column:
    return (F.col("score") >= 0.5).cast("int")
