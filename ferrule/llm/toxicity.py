"""Toxicity: a convolutional text classifier, trained in numpy.

A word is embedded as the sum of two rows of a hashed table, one of the whole
word and one of its first four bytes, so that inflected forms share; filters of
several widths run over a whole text, each is pooled to its largest response,
and a linear layer gives the logit.  Rows that only few training texts use stay
zero, so that such words respond like none.  Thresholds are calibrated by
language, which is told from a text's own commonest function words, on rows
that the network has not seen: a score of 0.5 is the threshold of the text's
language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from .kernel import U, Words, ascii_lower, buffers, from_blob, mix, pieces, plain_words
from .labelled import training_rows
from .quality import sigmoid
from .store import ship

BITS = 18
HEAD_BITS = 16
ROWS = (1 << BITS) + (1 << HEAD_BITS)
WIDTHS = (1, 2, 3)
FUNCTION_WORDS = {
    "en": "the of and to in is that for with was as by are this from",
    "de": "der die und den von zu das mit ist im auf ein des dem für",
    "fr": "le la les de des et un une que est dans par pour du au",
    "es": "el la los las de que en un una por con del su no para",
}


def _language_hashes() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of function words, sorted, and a row of languages that have each."""
    names = sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})
    raw = " ".join(names).encode()
    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), plain_words(), None)
    has = np.array([[w in ws.split() for ws in FUNCTION_WORDS.values()] for w in names], np.int64)
    order = np.argsort(words.h)
    return words.h[order], has[order]


def languages(words: Words) -> np.ndarray:
    """Of each text the language with the most function words, as an index; one more where there are none."""
    hashes, has = _language_hashes()
    at = np.searchsorted(hashes, words.h)
    at[at == len(hashes)] = 0
    count = np.where((hashes[at] == words.h)[:, None], has[at], 0) if len(at) else np.zeros((0, has.shape[1]), np.int64)
    total = np.concatenate([np.zeros((1, count.shape[1]), np.int64), np.cumsum(count, 0)])
    total = total[words.first[1:]] - total[words.first[:-1]]
    return np.where(total.max(1) > 0, total.argmax(1), has.shape[1])


@dataclass
class Network:
    embed: np.ndarray  # rows of words, then of their heads, x dims
    filters: list[np.ndarray]  # of each width: width x dims x filters
    bias: np.ndarray  # of all filters
    out: np.ndarray
    out_bias: float
    threshold: np.ndarray  # logit, by language, and one for none
    slope: float = 1.0

    @classmethod
    def new(cls, dims: int = 8, each: int = 8, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, 0.5, (w, dims, each)).astype(np.float32) for w in WIDTHS]
        n = each * len(WIDTHS)
        return cls(rng.normal(0, 0.1, (ROWS, dims)).astype(np.float32), filters, np.zeros(n, np.float32), rng.normal(0, 0.5, n).astype(np.float32), 0.0, np.zeros(len(FUNCTION_WORDS) + 1))

    def embedded(self, codes: np.ndarray) -> np.ndarray:
        return self.embed[codes[0]] + self.embed[codes[1]]

    def responses(self, x: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of each place and filter, to embedded words; beyond a text's end a word is zero."""
        n, at = len(x), np.arange(len(x))
        parts = []
        for f in self.filters:
            total = x @ f[0]
            for j in range(1, len(f)):
                if n > j:
                    more = x[j:] @ f[j]
                    more[at[:-j] + j >= last[:-j]] = 0
                    total[:-j] += more
            parts.append(total)
        return np.concatenate(parts, 1) + self.bias

    def logits(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each text; one without words responds with nothing."""
        counts = np.diff(first)
        pooled = np.zeros((len(counts), len(self.bias)), np.float32)
        some = counts > 0
        if codes.shape[1]:
            places = self.responses(self.embedded(codes), np.repeat(first[1:], counts))
            pooled[some] = np.maximum(np.maximum.reduceat(places, first[:-1][some], 0), 0)
        return pooled @ self.out + self.out_bias


class _Adagrad:
    def __init__(self, rate: float):
        self.rate, self.seen = rate, {}

    def __call__(self, name: str, value: np.ndarray, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        seen = self.seen.setdefault(name, np.full_like(value, 1e-6))
        if rows is None:
            seen += gradient * gradient
            value -= self.rate * gradient / np.sqrt(seen)
        else:
            seen[rows] += gradient * gradient
            value[rows] -= self.rate * gradient / np.sqrt(seen[rows])


def _step(net: Network, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, adapt: _Adagrad, rare: np.ndarray) -> None:
    codes = np.concatenate(texts, 1)
    counts = np.array([t.shape[1] for t in texts])
    first = np.concatenate([[0], np.cumsum(counts)])
    last = np.repeat(first[1:], counts)
    x = net.embedded(codes)
    places = net.responses(x, last)
    top = np.maximum.reduceat(places, first[:-1], 0)
    pooled = np.maximum(top, 0)
    error = (sigmoid(pooled @ net.out + net.out_bias) - y) * weight / len(y)
    back = np.outer(error, net.out) * (top > 0)
    # the gradient reaches only the place of each text's largest response
    at_doc, at_filter = np.nonzero(back)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.empty(len(at_doc), np.int64)
    for f in np.unique(at_filter).tolist():
        own = at_filter == f
        peak = np.flatnonzero(places[:, f] == top[owner, f])
        docs, index = np.unique(owner[peak], return_index=True)
        place[own] = peak[index][np.searchsorted(docs, at_doc[own])]
    g = back[at_doc, at_filter].astype(np.float32)
    each = net.filters[0].shape[2]
    into = np.zeros_like(x)
    for k, f in enumerate(net.filters):
        own = at_filter // each == k
        column, grad = at_filter[own] % each, g[own]
        change = np.zeros_like(f)
        for j in range(len(f)):
            p = place[own] + j
            inside = p < last[place[own]]
            p = p[inside]
            np.add.at(change[j].T, column[inside], grad[inside, None] * x[p])
            np.add.at(into, p, grad[inside, None] * f[j].T[column[inside]])
        adapt(f"filter{k}", f, change)
    adapt("bias", net.bias, back.sum(0).astype(np.float32))
    adapt("out", net.out, (pooled.T @ error).astype(np.float32) + 1e-4 * net.out)
    shift = np.array([net.out_bias], np.float32)
    adapt("shift", shift, np.array([error.sum()], np.float32))
    net.out_bias = float(shift[0])
    touched = np.flatnonzero(np.abs(into).sum(1) > 0)
    rows, which = np.unique(codes[:, touched], return_inverse=True)
    change = np.zeros((len(rows), x.shape[1]), np.float32)
    np.add.at(change, which.reshape(-1), np.concatenate([into[touched], into[touched]]))
    common = ~rare[rows]
    adapt("embed", net.embed, change[common], rows[common])


def fit(texts: list[np.ndarray], language: np.ndarray, y: np.ndarray, natural: np.ndarray, *, epochs: int = 8, batch: int = 32, rate: float = 0.05, least_texts: int = 8, decay: float = 0.85) -> Network:
    """Trains on four fifths of the rows; thresholds come from the natural ones of the rest.

    `decay` was chosen among 0.5, 0.7, 0.85 and 1 on an inner fold: of the rows
    that training may see, those with a remainder of 1 by 5 judged networks
    that the others had trained.

    With one class, or none, every text gets that class's smoothed share.
    """
    net = Network.new()
    if len(set(y.tolist())) < 2:
        net.out[:] = 0
        p = (y.sum() + 1) / (len(y) + 2)
        net.out_bias = float(np.log(p / (1 - p)))
        return net
    full = np.array([t.shape[1] > 0 for t in texts])
    held = (np.arange(len(y)) % 5 == 4) & natural
    if not 0 < y[held].sum() < held.sum():
        held[:] = False
    use = np.flatnonzero(~held & full)
    weight = np.where(y == 1, len(use) / (2 * max(y[use].sum(), 1)), len(use) / (2 * max((y[use] == 0).sum(), 1)))
    # rows that few texts use would only learn those texts by heart: they stay zero
    spread = np.zeros(len(net.embed), np.int64)
    for k in use.tolist():
        spread[np.unique(texts[k])] += 1
    rare = spread < least_texts
    net.embed[rare] = 0
    adapt, rng = _Adagrad(rate), np.random.default_rng(5)
    for _ in range(epochs):
        order = rng.permutation(use)
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            _step(net, [texts[k] for k in own], y[own], weight[own], adapt, rare)
        net.embed *= decay  # what no gradient renews fades, such as the noise that rows begin with
    curve = np.flatnonzero(held) if held.any() else use
    logit = np.concatenate([net.logits(np.concatenate([texts[k] for k in part], 1), np.concatenate([[0], np.cumsum([texts[k].shape[1] for k in part])])) for part in np.array_split(curve, max(len(curve) // 256, 1))])
    whole = best_threshold(logit, y[curve], 0.0)
    net.threshold[:] = whole
    for k in range(len(net.threshold)):
        own = language[curve] == k
        if y[curve][own].sum() >= 5 and (y[curve][own] == 0).sum() >= 5:
            net.threshold[k] = best_threshold(logit[own], y[curve][own], whole)
    return net


def best_threshold(logit: np.ndarray, y: np.ndarray, usual: float) -> float:
    """The middle of the widest gap of logits among the cuts of best balanced accuracy."""
    order = np.argsort(logit)
    logit, y = logit[order], y[order]
    ones, zeros = y.sum(), len(y) - y.sum()
    if not ones or not zeros:
        return usual
    right = (ones - np.cumsum(y)) / ones + np.cumsum(y == 0) / zeros
    cut = np.flatnonzero(right[:-1] >= right[:-1].max() - 1e-9)
    gap = logit[cut + 1] - logit[cut]
    at = cut[np.argmax(gap)]
    return float((logit[at] + logit[at + 1]) / 2)


def _each(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words, np.ndarray]]:
    """Words and the two table rows of each."""
    buf, offsets = buffers(batch.column(column))
    for a, b in pieces(offsets):
        words = Words(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], plain_words(), ascii_lower())
        head = np.zeros(len(words.h), U)
        for j in range(4):
            inside = words.start + j < words.end
            head = head * U(257) + np.where(inside, words.buf[np.minimum(words.start + j, len(words.buf) - 1)].astype(U) + U(1), U(0))
        codes = np.stack([(words.h >> U(64 - BITS)).astype(np.int64), (mix(head) >> U(64 - HEAD_BITS)).astype(np.int64) + (1 << BITS)])
        yield a, b, words, codes


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, words, codes in _each(batch, 1):
            codes = codes.astype(np.uint32)
            blob = pa.array([codes[:, x:y].tobytes() for x, y in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), blob, pa.array(languages(words), pa.int32()), batch.column(2).slice(a, b - a), batch.column(3).slice(a, b - a)], ["doc_id", "words", "language", "y", "natural"]
            )


def train(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, *, most: int = 6000, most_of_class: int = 2500) -> Network:
    """A network for `label`, from at most most + 2 * most_of_class labelled rows for which `allowed` holds."""
    ship(docs.sparkSession)
    chosen = training_rows(docs, labels, label, allowed, most, most_of_class)
    rows = chosen.mapInArrow(_blobs, "doc_id long, words binary, language int, y int, natural boolean").collect()
    got = sorted((r["doc_id"], bytes(r["words"]), r["language"], r["y"], r["natural"]) for r in rows)
    got = [got[i] for i in np.random.default_rng(11).permutation(len(got)).tolist()]
    texts = [from_blob(x[1], np.uint32).astype(np.int64).reshape(2, -1) for x in got]
    return fit(texts, np.array([x[2] for x in got], np.int64), np.array([x[3] for x in got], np.int64), np.array([x[4] for x in got], bool))


def _score(network, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network.value
        for batch in batches:
            kept = [(i, x) for i, x in enumerate(batch.schema.names) if x in names]
            parts = []
            for _, _, words, codes in _each(batch, batch.schema.names.index("text")):
                logit = net.logits(codes, words.first)
                parts.append(sigmoid(net.slope * (logit - net.threshold[languages(words)])))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i, _ in kept], pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())], [*[x for _, x in kept], "score"])

    return run


def score(docs: DataFrame, network: Network, *, keep_text: bool = True) -> DataFrame:
    """docs with `score`: 0 to 1, higher where label 1 is likelier.  Only `text` is looked at.

    Without keep_text the result lacks that column, which spares its way back.

    A null text counts as empty; a text without words gets the network's answer
    to no response.  Rows are kept as they are, repeated ones too.  A column
    named score is replaced.
    """
    ship(docs.sparkSession)
    docs = docs.drop("score")
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]
    kind = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "score double"])
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(network), [f.name for f in fields]), kind)
