"""Quality classifier: a byte-level convolutional network in numpy.

A text is bytes; each byte is a symbol that also says whether its last four
bytes occurred up to ``LAGS`` bytes before (never in its first ``LAGS`` + 3 bytes).  Learned filters run over chunks of
16 bytes that overlap by half and cover the whole text; each filter's maximum
over the chunks goes through a small dense layer into one probability.

Training reads at most ``PER_CLASS`` documents of each label and ``TRAIN_BYTES``
bytes, half for each label (the fixed bounds of the sample); label counts are
those of all labelled documents and set the prior.  A label without a document
and a document labelled both ways teach nothing.  Scores depend on the text alone: null and empty texts get the
score of an empty text, equal texts equal scores.  Rows with one id are scored
one by one.  Without labels of both kinds every score is the share of label 1,
or 1 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import bytes_of, fresh, lean, small_batches, spans_of
from caseloom.llm.training import agreed, held_out, learnt, sample_ids, sample_texts

PER_CLASS = 1500
TRAIN_BYTES = 24 << 20
HALF = 8  # bytes between chunk starts; a chunk has two halves
DIM = 8
FILTERS = 24
HIDDEN = 16
LAGS = 24
STEPS = 600  # of training, over as many rounds as the sample needs
BATCH = 64
PAD = 512
THRESHOLD = 0.3


def symbols(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all rows, each row padded to whole halves and at least two; and the first half of each row."""
    again = np.zeros(len(data), bool)
    if len(data) > 4:
        four = data[:-3].astype(np.uint32)
        for i in (1, 2, 3):
            four |= data[i : len(data) - 3 + i].astype(np.uint32) << np.uint32(8 * i)
        hit = np.zeros(len(four), bool)
        for lag in range(1, min(LAGS, len(four) - 1) + 1):
            hit[lag:] |= four[lag:] == four[:-lag]
        again[3:] = hit
        for r in range(1, 4 + LAGS):  # a row's start looks back at no other row
            at = off[:-1] + r - 1
            again[at[at < np.minimum(off[1:], len(data))]] = False
    size = np.diff(off)
    halves = np.maximum(-(-size // HALF), 2)
    begin = np.zeros(len(size) + 1, np.int64)
    np.cumsum(halves, out=begin[1:])
    out = np.full(begin[-1] * HALF, PAD, np.int16)
    where = np.arange(len(data)) + np.repeat(begin[:-1] * HALF - off[:-1], size)
    out[where] = data.astype(np.int16) + again * np.int16(256)
    return out, begin


@dataclass
class Network:
    emb: np.ndarray  # PAD + 1, DIM
    filt: np.ndarray  # 2 * HALF * DIM, FILTERS
    bias: np.ndarray
    dense: np.ndarray  # FILTERS, HIDDEN
    dense_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    shift: float = 0.0
    constant: float | None = None

    def chunks(self, sym: np.ndarray) -> np.ndarray:
        """Filter values of each pair of neighbouring halves."""
        x = np.take(self.emb, sym, axis=0).reshape(-1, HALF * DIM)
        n = HALF * DIM
        v = x[:-1] @ self.filt[:n]
        v += x[1:] @ self.filt[n:]
        return v

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = np.maximum(pooled + self.bias, 0)
        h = np.tanh(a @ self.dense + self.dense_bias)
        return a, h, h @ self.out + self.out_bias

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        out = np.empty(n)
        for i, j in spans_of(off, 1 << 19):
            sym, begin = symbols(data[off[i] : off[j]], off[i : j + 1] - off[i])
            best = np.full((j - i, FILTERS), -np.inf, np.float32)
            # a long text is read in pieces that share one half
            step = 1 << 16
            for a in range(0, begin[-1] - 1, step):
                b = min(a + step + 1, int(begin[-1]))
                v = self.chunks(sym[a * HALF : b * HALF])
                ends = begin[1:-1] - 1  # the chunk over two rows counts for neither
                ends = ends[(ends >= a) & (ends < b - 1)]
                v[ends - a] = -np.inf
                lo, hi = np.searchsorted(begin, a, "right") - 1, np.searchsorted(begin, b - 1, "left")
                cuts = np.maximum(begin[lo:hi] - a, 0)
                part = np.maximum.reduceat(v, cuts, axis=0)
                np.maximum(best[lo:hi], part, out=best[lo:hi])
            logit = self.head(best)[2] + self.shift
            out[i:j] = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        return out


def _pooled(net: Network, sym: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = net.chunks(sym)
    best = np.empty((len(begin) - 1, FILTERS), np.float32)
    at = np.empty((len(begin) - 1, FILTERS), np.int64)
    cols = np.arange(FILTERS)
    for r in range(len(begin) - 1):
        part = v[begin[r] : begin[r + 1] - 1]
        k = part.argmax(0)
        at[r], best[r] = k + begin[r], part[k, cols]
    return best, at


def train(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> Network:
    """Adam on the logistic loss; the order of steps is fixed by the seed."""
    rng = np.random.default_rng(seed)
    f = np.float32
    net = Network(
        rng.normal(0, 0.5, (PAD + 1, DIM)).astype(f), rng.normal(0, 1 / np.sqrt(2 * HALF * DIM), (2 * HALF * DIM, FILTERS)).astype(f), np.zeros(FILTERS, f),
        rng.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)).astype(f), np.zeros(HIDDEN, f), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(f), np.zeros(1, f),
    )
    names = ["emb", "filt", "bias", "dense", "dense_bias", "out", "out_bias"]
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    step, n = 0, HALF * DIM
    epochs = -(-STEPS * BATCH // len(texts))
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = 0.004 * (1 - epoch / epochs) + 0.0005
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            off = np.zeros(len(pick) + 1, np.int64)
            np.cumsum([len(texts[k]) for k in pick], out=off[1:])
            sym, begin = symbols(np.frombuffer(b"".join(texts[k] for k in pick), np.uint8), off)
            pooled, at = _pooled(net, sym, begin)
            a, h, logit = net.head(pooled)
            y = labels[pick]
            g = ((1 / (1 + np.exp(-logit)) - y) / len(pick)).astype(f)
            grad = {"out": h.T @ g, "out_bias": g.sum(keepdims=True)}
            gh = np.outer(g, net.out) * (1 - h * h)
            grad["dense"], grad["dense_bias"] = a.T @ gh, gh.sum(0)
            ga = (gh @ net.dense.T) * (a > 0)
            grad["bias"] = ga.sum(0)
            span = sym.reshape(-1, HALF)
            win = np.concatenate([span[at], span[at + 1]], axis=2)  # row, filter, 16 symbols
            grad["filt"] = np.einsum("rf,rfx->xf", ga, net.emb[win].reshape(len(pick), FILTERS, 2 * n))
            ge = np.einsum("rf,xf->rfx", ga, net.filt).reshape(-1, DIM)
            grad["emb"] = np.stack([np.bincount(win.ravel(), ge[:, d], PAD + 1) for d in range(DIM)], 1).astype(f)
            step += 1
            for k in names:
                w, dw = getattr(net, k), grad[k] + f(1e-5) * getattr(net, k)
                m[k] = 0.9 * m[k] + 0.1 * dw
                v[k] = 0.999 * v[k] + 0.001 * dw * dw
                w -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(f)
    return net


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Learns from labelled documents that are not held out; labels other than 0 and 1 are ignored."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    rows = rows.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    picked, counts = sample_ids(agreed(rows, docs), PER_CLASS)
    data = learnt(sample_texts(docs.select("doc_id", "text"), picked, TRAIN_BYTES), counts, "a quality label")
    y = np.array([q for _, _, q in data], np.float32)
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 1.0
    if len(np.unique(y)) < 2:
        z = np.zeros(0, np.float32)
        return Network(z, z, z, z, z, z, z, constant=share)
    net = train([t.encode() for _, t, _ in data], y)
    net.shift = float(np.log(share / (1 - share)) - np.log(y.mean() / (1 - y.mean())))
    return net


def score(docs: DataFrame, net: Network, name: str = "quality_score") -> DataFrame:
    """The documents' columns, and the score as ``name``, which must be none of them; texts are read whole."""
    small_batches(docs.sparkSession)
    names = docs.columns
    if fresh(name, names) != name:
        raise ValueError(f"there is a column {name} already")
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(net.scores(*bytes_of(b.column(at))), pa.float64())], [*names, name])

    from pyspark.sql import types as T

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    net = fit(docs, labels)
    s = score(docs.select("doc_id", "text"), net)
    return s.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their columns, whatever their names."""
    name = fresh("quality_score", docs.columns)
    return score(docs, fit(docs, labels), name).filter(F.col(name) >= THRESHOLD).drop(name)
