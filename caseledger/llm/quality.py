"""Document quality from pooled random-indexing word vectors and a small network.

Word vectors: every word and every word shape (runs of capitals, small letters,
digits and each mark, with a flag for a word that repeats the one before) falls
into one of a fixed number of buckets. A bucket has a sparse ternary index
vector; its word vector is the sum of the index vectors of its neighbours, two
words to either side, over all texts of the corpus. These sums are integers, so
they don't depend on partitioning. The table's size is fixed, whatever the
corpus.

A document is the mean of its word vectors, and the spread, least and greatest
of the means of its stretches of 32 words, so that a bad passage in a long
document shows. Two layers in numpy turn this into a logit; a temperature fitted
on rows the network hasn't seen calibrates it.

Cases: null and empty texts have zero vectors and get the score the network
gives these. Copies among the training rows share the weight of one. Repeated
rows are scored each, equal texts alike, so ties stay ties. Texts of any length are
taken whole, in time linear in it. Columns named in ``keep`` come back whatever their
names, except one called like ``score``, which the caller may rename. Empty tables
give no rows. Without labelled rows of both kinds every score is the
share of label 1 among them (0.5 with none).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseledger.llm.common import free_names, held_out, labelled_sample, texts_of
from caseledger.llm.textvec import SPACE, Words, mix, span_hash, word_blocks

WORDS, SHAPES, DIM, WINDOW, STRETCH = 8192, 1024, 32, 2, 32
#: Expected bound on training documents of each label.
DOCS_PER_LABEL = 4000
THRESHOLD = 0.3
FEATURES = 4 * DIM + 1
_BLOCK = 1 << 19

_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91] = 65
_KIND[97:123] = 97
_KIND[128:] = 97
_KIND[48:58] = 48


def index_vectors(seed: int = 11) -> np.ndarray:
    """Four random +1/-1 entries for each bucket."""
    rng, n = np.random.default_rng(seed), WORDS + SHAPES
    out = np.zeros((n, DIM), np.int32)
    at = rng.random((n, DIM)).argsort(1)[:, :4]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int32), (n, 4)), 1)
    return out


def buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word of a block, and of its shape."""
    kind = _KIND[w.data]
    inside = ~SPACE[w.data]
    new = inside.copy()
    new[1:] &= kind[1:] != kind[:-1]
    new[w.start] = True
    place = np.r_[0, np.cumsum(new)]
    shape = span_hash(kind[new], place[w.start], place[w.end])
    again = np.zeros(len(w.hash), bool)
    again[1:] = (w.hash[1:] == w.hash[:-1]) & (w.row[1:] == w.row[:-1])
    shape = mix(shape + again.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (w.hash % np.uint64(WORDS)).astype(np.int64), (WORDS + shape % np.uint64(SHAPES)).astype(np.int64)


def _add_rows(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    at = at[order]
    head = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    table[at[head]] += np.add.reduceat(rows[order], head, axis=0)


def context_sums(batches) -> Iterator[pa.RecordBatch]:
    """One row for each bucket that a partition's texts hold: the summed index
    vectors of its neighbours."""
    index, table = index_vectors(), np.zeros((WORDS + SHAPES, DIM), np.int64)
    for b in batches:
        data, off = texts_of(b.column(0))
        for w in word_blocks(data, off, SPACE, _BLOCK):
            n = len(w.hash)
            if n < 2:
                continue
            word, shape = buckets(w)
            own = index[word] + index[shape]
            near = np.zeros_like(own)
            for k in range(1, WINDOW + 1):
                if n > k:
                    same = (w.row[k:] == w.row[:-k])[:, None]
                    near[k:] += own[:-k] * same
                    near[:-k] += own[k:] * same
            _add_rows(table, word, near)
            _add_rows(table, shape, near)
    used = np.flatnonzero(table.any(1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), *(pa.array(table[used, k]) for k in range(DIM))],
        ["bucket", *(f"c{k}" for k in range(DIM))])


def learn_word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit word vector of each bucket (float32), from all texts of ``docs``.
    Partitions send at most one row for each bucket."""
    cols = [f"c{k}" for k in range(DIM)]
    sums = (docs.select(text).mapInArrow(context_sums, "bucket int, " + ", ".join(f"{c} long" for c in cols))
            .groupBy("bucket").agg(*(F.sum(c).alias(c) for c in cols))).toArrow()
    out = np.zeros((WORDS + SHAPES, DIM))
    if sums.num_rows:
        out[sums["bucket"].to_numpy()] = np.stack([sums[c].to_numpy() for c in cols], 1)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(col: pa.Array, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each text, and its least hash of a word pair (copies mostly share it)."""
    data, off = texts_of(col)
    out = np.zeros((len(off) - 1, FEATURES), np.float32)
    least = np.full(len(off) - 1, 2**64 - 1, np.uint64)
    for w in word_blocks(data, off, SPACE, _BLOCK):
        if not len(w.hash):
            continue
        word, shape = buckets(w)
        v = vectors[word] + vectors[shape]
        head = np.flatnonzero(np.r_[True, w.row[1:] != w.row[:-1]])
        rows, many = w.row[head], np.diff(np.r_[head, len(word)])
        place = np.arange(len(word)) - np.repeat(head, many)
        # a last stretch of under half the length joins the one before
        joined = (place % STRETCH == 0) & ((np.repeat(many, many) - place >= STRETCH // 2) | (place == 0))
        cut = np.flatnonzero(joined)
        long = np.diff(np.r_[cut, len(word)])[:, None]
        sums = np.add.reduceat(v, cut, axis=0)
        first = np.searchsorted(cut, head)
        mean = np.add.reduceat(sums, first, axis=0) / many[:, None]
        stretch = sums / long
        at = w.first + rows
        out[at, :DIM] = mean
        out[at, DIM:2 * DIM] = np.minimum.reduceat(stretch, first, axis=0)
        out[at, 2 * DIM:3 * DIM] = np.maximum.reduceat(stretch, first, axis=0)
        spread = np.add.reduceat(np.square(stretch) * long, first, axis=0) / many[:, None] - np.square(mean)
        out[at, 3 * DIM:4 * DIM] = np.sqrt(np.maximum(spread, 0))
        out[at, 4 * DIM] = np.log1p(many)
        pair = mix(w.hash * np.uint64(3) + np.r_[w.hash[1:], w.hash[:1]])
        last = np.r_[head[1:], len(word)] - 1
        pair[last] = np.where(many > 1, np.uint64(2**64 - 1), pair[last])  # no pair across rows
        least[at] = np.minimum.reduceat(pair, head)
    return out, least


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float


def logits(net: Network, x: np.ndarray) -> np.ndarray:
    return np.tanh(((x - net.mean) / net.scale) @ net.w1 + net.b1) @ net.w2 + net.b2


def probabilities(net: Network, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits(net, x) / net.temperature, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    return float(((np.logaddexp(0, z) - y * z) * weight).sum() / weight.sum())


def train_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, apart: np.ndarray, hidden: int = 32,
                  epochs: int = 40, rate: float = 0.003, decay: float = 1e-4, seed: int = 5) -> Network:
    """Two layers by Adam on the rows not ``apart``; the temperature that gives
    the least loss on the rows ``apart``."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    p = {"w1": rng.normal(0, FEATURES ** -0.5, (x.shape[1], hidden)), "b1": np.zeros(hidden),
         "w2": rng.normal(0, hidden ** -0.5, hidden), "b2": np.zeros(1)}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    fit, step = np.flatnonzero(~apart), 0
    xs = ((x - mean) / scale).astype(np.float64)
    for epoch in range(epochs):
        for pick in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            h = np.tanh(xs[pick] @ p["w1"] + p["b1"])
            z = np.clip(h @ p["w2"] + p["b2"], -40, 40)
            g = (1 / (1 + np.exp(-z)) - y[pick]) * weight[pick] / weight[pick].sum()
            back = np.outer(g, p["w2"]) * (1 - h * h)
            grad = {"w1": xs[pick].T @ back, "b1": back.sum(0), "w2": h.T @ g, "b2": g.sum(keepdims=True)}
            step += 1
            for k, d in grad.items():
                m[k] += 0.1 * (d - m[k])
                s[k] += 0.001 * (d * d - s[k])
                pace = rate * (1 - epoch / epochs)
                p[k] -= pace * ((m[k] / (1 - 0.9 ** step)) / (np.sqrt(s[k] / (1 - 0.999 ** step)) + 1e-8) + decay * p[k])
    net = Network(mean, scale, p["w1"], p["b1"], p["w2"], float(p["b2"][0]), 1.0)
    if apart.any():
        z = logits(net, x[apart])
        temperatures = np.geomspace(0.25, 8, 61)
        net = net._replace(temperature=float(min(temperatures, key=lambda t: _loss(z / t, y[apart], weight[apart]))))
    return net


class Model(NamedTuple):
    vectors: np.ndarray
    net: Network | None
    prior: float


def train(docs: DataFrame, labels: DataFrame, per_label: int = DOCS_PER_LABEL) -> Model:
    """Word vectors from all texts; the network from a bounded sample of labelled
    rows outside the held-out fold, weighted back to the shares of the labels."""
    vectors = learn_word_vectors(docs)
    shares = {r["quality"]: r["n"] for r in labels.where(~held_out() & F.col("quality").isin(0, 1))
              .groupBy("quality").agg(F.count("*").alias("n")).collect()}
    total = sum(shares.values())
    prior = shares.get(1, 0) / total if total else 0.5
    sample = labelled_sample(docs, labels.where(F.col("quality").isin(0, 1)), "quality", per_label)

    def features(batches):
        for b in batches:
            x, least = pooled(b.column("text"), vectors)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("_label"), pa.array(least.view(np.int64)),
                 pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "least", "x"])

    kind = T.StructType([sample.schema["doc_id"], T.StructField("label", T.IntegerType()),
                         T.StructField("least", T.LongType()), T.StructField("x", T.BinaryType())])
    got = sample.mapInArrow(features, kind).toArrow().sort_by("doc_id")
    y = got["label"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(vectors, None, prior)
    x = np.frombuffer(b"".join(v.as_py() for v in got["x"]), np.float32).reshape(-1, FEATURES)
    least = got["least"].to_numpy()
    _, group, many = np.unique(least, return_inverse=True, return_counts=True)
    weight = 1 / many[group]
    for k in (0, 1):
        weight[y == k] *= shares[k] / total / weight[y == k].sum()
    apart = least.view(np.uint64) % np.uint64(5) == 0  # copies stay on one side
    return Model(vectors, train_network(x, y, weight, apart), prior)


def score_quality(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
                  score: str = "score") -> DataFrame:
    """``keep`` columns with the calibrated probability of label 1."""
    whole, = free_names(docs, "_quality_text")
    src = docs.select(F.col(text).alias(whole), *keep)
    kind = T.StructType([*(src.schema[c] for c in keep), T.StructField(score, T.DoubleType())])

    def run(batches):
        for b in batches:
            x, _ = pooled(b.column(0), model.vectors)
            p = probabilities(model.net, x) if model.net else np.full(len(x), model.prior)
            yield pa.RecordBatch.from_arrays([*(b.column(1 + i) for i in range(len(keep))), pa.array(p)],
                                             [*keep, score])

    return src.mapInArrow(run, kind)
