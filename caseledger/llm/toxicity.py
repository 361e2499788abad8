"""Toxicity by multiple-instance learning over sentences.

A document is a bag of sentences. A sentence's score is a logistic function of
the distinct words it holds (hashed); the document's score is their noisy-or,
``1 - prod(1 - p)``. Weights are trained from document labels alone, through
the noisy-or, and the trained sentence scores locate the offending sentences.

Cases: null and empty texts have no sentence and score 0. Repeated words count
once in a sentence. Repeated rows are judged each. Texts of any length are taken
whole, in time linear in it. Words that tie in weight or sentences that tie in score
keep the order of the text. Columns named in ``keep`` come back whatever their names,
except those called like ``score`` and ``spans``, which the caller may rename. With no labelled rows, or
labels of one kind only, every score is 0 or the prior bias of the sentences.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseledger.llm.common import labelled_sample, texts_of
from caseledger.llm.textvec import NOT_WORD, Words, mix, word_blocks

BITS = 18
#: Expected bound on training documents of each label.
DOCS_PER_LABEL = 4000
#: A word needs so many different training documents to get a weight.
MIN_DOCS = 6
THRESHOLD = 0.5
SENTENCE_THRESHOLD = 0.5
_MASK = np.uint64((1 << BITS) - 1)
_STOP = np.isin(np.arange(256), list(b".!?\n"))


class Model(NamedTuple):
    bias: float
    weights: np.ndarray  # float32, by hashed word


def sentences(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the words of a block: index of the sentence of each word; then row
    and first word of each sentence. A sentence ends at . ! ? or a line break."""
    stops = np.cumsum(_STOP[w.data])[w.start] if len(w.start) else np.zeros(0, np.int64)
    new = np.ones(len(w.start), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (w.row[1:] != w.row[:-1])
    first = np.flatnonzero(new)
    return np.cumsum(new) - 1, w.row[first], first


def distinct_features(w: Words, sentence: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """Sorted distinct (sentence << BITS | word) keys, of ``known`` words if given."""
    feature = w.hash & _MASK
    key = (sentence.astype(np.uint64) << np.uint64(BITS)) | feature
    if known is not None:
        key = key[known[feature]]
    key.sort()
    return key[np.r_[True, key[1:] != key[:-1]]] if len(key) else key


def sentence_scores(w: Words, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, probability) of each sentence of a block."""
    sentence, row, first = sentences(w)
    key = distinct_features(w, sentence, model.weights != 0)
    z = model.bias + np.bincount((key >> np.uint64(BITS)).astype(np.int64),
                                 model.weights[key & _MASK], len(first))
    return row, first, 1 / (1 + np.exp(-z))


def _copies(bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weight of each document, one over the number of documents with the same
    least sentence hash (exact and near copies mostly share it), and how many such
    groups hold each word."""
    none = np.uint64(2**64 - 1)
    least = np.full(len(bags), none, np.uint64)
    for d, b in enumerate(bags):
        if len(b):
            sentence = b >> np.uint64(BITS)
            head = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
            least[d] = mix(np.add.reduceat(mix((b & _MASK) + np.uint64(1)), head)).min()
    _, first, group, many = np.unique(least, return_index=True, return_inverse=True, return_counts=True)
    held = np.zeros(1 << BITS, np.int64)
    for d in first:
        held[np.unique(bags[d] & _MASK)] += 1
    return 1 / many[group], held


def train_bags(bags: list[np.ndarray], rows: np.ndarray, labels: np.ndarray,
               epochs: int = 60, rate: float = 0.1, l1: float = 0.1, seed: int = 3) -> Model:
    """Weights that maximise the likelihood of document labels under the
    noisy-or, by Adam with a falling rate and a proximal L1 step. ``bags``: per document the
    distinct (sentence, word) keys; ``rows``: number of sentences. Copies share
    the weight of one document, and rare words get no weight."""
    whole = np.zeros(1 << BITS, np.float32)
    bias, mb, vb = -6.0, 0.0, 0.0
    rng, n, step = np.random.default_rng(seed), len(bags), 0
    if not n or labels.min() == labels.max():
        return Model(bias, whole)
    share, held = _copies(bags)
    used = np.flatnonzero(held >= MIN_DOCS)
    place = np.full(1 << BITS, -1, np.int64)
    place[used] = np.arange(len(used))
    feats = [place[b & _MASK] for b in bags]
    sents = [(b >> np.uint64(BITS)).astype(np.int64)[f >= 0] for b, f in zip(bags, feats)]
    feats = [f[f >= 0] for f in feats]
    w, m, v = (np.zeros(len(used)) for _ in range(3))
    for epoch in range(epochs):
        order, pace = rng.permutation(n), rate * (1 - epoch / epochs)
        for i in range(0, n, 256):
            pick = order[i:i + 256]
            base = np.cumsum(np.r_[0, rows[pick]])
            sent = np.concatenate([sents[d] + b for d, b in zip(pick, base)])
            feat = np.concatenate([feats[d] for d in pick])
            doc = np.repeat(np.arange(len(pick)), rows[pick])
            z = np.clip(bias + np.bincount(sent, w[feat], base[-1]), -30, 30)
            p = 1 / (1 + np.exp(-z))
            none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-9)), len(pick))
            some = np.clip(-np.expm1(none), 1e-9, 1 - 1e-9)
            # d loglik / dz of a sentence: y (1 - P) / P * p - (1 - y) * p
            coef = np.where(labels[pick] == 1, (1 - some) / some, -1.0) * share[pick]
            g = -coef[doc] * p / share[pick].sum()
            step += 1
            grad, gb = np.bincount(feat, g[sent], len(used)), g.sum()
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            mb += 0.1 * (gb - mb)
            vb += 0.001 * (gb * gb - vb)
            c1, c2 = 1 - 0.9 ** step, 1 - 0.999 ** step
            # words only speak for toxicity: weights stay at zero or above
            w = np.maximum(w - pace * ((m / c1) / (np.sqrt(v / c2) + 1e-7) + l1), 0)
            bias -= pace * (mb / c1) / (np.sqrt(vb / c2) + 1e-7)
    w[w < 0.05] = 0
    whole[used] = w
    return Model(float(bias), whole)


def _bags(batches):
    for b in batches:
        data, off = texts_of(b.column("text"))
        keys, counts, labels = [], [], b.column("_label").to_numpy(zero_copy_only=False)
        for w in word_blocks(data, off, NOT_WORD):
            sentence, row, _ = sentences(w)
            n = w.last - w.first
            many = np.bincount(row, minlength=n)
            base = np.r_[0, np.cumsum(many)]
            key = distinct_features(w, sentence)
            of = (key >> np.uint64(BITS)).astype(np.int64)
            cut = np.searchsorted(of, base)
            for d in range(n):
                k = key[cut[d]:cut[d + 1]] - (np.uint64(base[d]) << np.uint64(BITS))
                keys.append(k.tobytes())
                counts.append(int(many[d]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(labels, pa.int32()),
             b.column("doc_id")], ["keys", "n", "label", "doc_id"])


def train(docs: DataFrame, labels: DataFrame, per_label: int = DOCS_PER_LABEL) -> Model:
    """Train on a bounded sample of labelled documents outside the held-out
    fold; the driver gets the hashed words of these documents only."""
    sample = labelled_sample(docs, labels, "toxic", per_label)
    kind = T.StructType([T.StructField("keys", T.BinaryType()), T.StructField("n", T.LongType()),
                         T.StructField("label", T.IntegerType()), sample.schema["doc_id"]])
    got = sample.mapInArrow(_bags, kind).toArrow().sort_by("doc_id")
    bags = [np.frombuffer(k.as_py(), np.uint64) for k in got["keys"]]
    return train_bags(bags, got["n"].to_numpy(), got["label"].to_numpy())


def _score(batch: pa.Array, model: Model, locate: bool):
    data, off = texts_of(batch)
    scores, spans = [], []
    for w in word_blocks(data, off, NOT_WORD):
        row, first, p = sentence_scores(w, model)
        n = w.last - w.first
        none = np.bincount(row, np.log1p(-np.minimum(p, 1 - 1e-12)), n)
        scores.append(np.clip(-np.expm1(none), 0, 1))
        if locate:
            found: list[list[dict]] = [[] for _ in range(n)]
            last = np.r_[first[1:], len(w.start)] - 1
            bad = np.flatnonzero(p >= SENTENCE_THRESHOLD)
            # code points before each byte, counted once for the block
            before = np.r_[0, np.cumsum((w.data & 0xC0) != 0x80)] if len(bad) else np.zeros(0, np.int64)
            for k in bad:
                r = row[k]
                base = before[w.offsets[r]]
                found[r].append({"start": int(before[w.start[first[k]]] - base),
                                 "end": int(before[w.end[last[k]]] - base), "score": float(p[k])})
            spans += found
    return np.concatenate(scores) if scores else np.zeros(0), spans


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
                                 T.StructField("score", T.DoubleType())]))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] | None = None,
                   score: str = "score", spans: str | None = "sentences") -> DataFrame:
    """``keep`` columns (all if None) with the document score and, unless
    ``spans`` is None, the offending sentences (code points, end exclusive)."""
    keep = tuple(docs.columns) if keep is None else keep
    src = docs.select(*keep, F.col(text).alias("_toxicity_text"))
    fields = [docs.schema[c] for c in keep] + [T.StructField(score, T.DoubleType())]
    names = [*keep, score]
    if spans:
        fields.append(T.StructField(spans, SPAN))
        names.append(spans)
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for b in batches:
            s, found = _score(b.column(len(keep)), model, bool(spans))
            out = [*(b.column(i) for i in range(len(keep))), pa.array(s, pa.float64())]
            yield pa.RecordBatch.from_arrays(out + ([pa.array(found, span_type)] if spans else []), names)

    return src.mapInArrow(run, T.StructType(fields))
