"""Text quality: supervised subword embeddings.

Every word, every run of 3 and 4 characters inside a word and every pair of neighbouring
words is hashed to a bucket; each bucket has a learned vector, a document is the average
of its vectors and a softmax over the labels reads it.  Training is stochastic gradient
descent in numpy on a sample of labelled rows: those with the smallest hash of their id,
``MAX_ROWS`` at most (a documented bound, so that one task can hold it).  After training
only the product of each bucket's vector with the output layer is kept: one number per bucket and
label, a table of fixed size that is broadcast.  All texts are scored whole.

Defined results: null text counts as empty; an empty text gets the share of each label
among the training rows; labels that are null teach nothing; with nothing to learn from, or
only one label, the score is that label's share (0.5 without any); repeated rows count each
time; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchgrid.llm.common import bare, chunks, texts, widened, with_columns
from merchgrid.llm.vec import codes, grams, mix, span_hashes, words

BUCKETS = 1 << 17
DIM = 16
EPOCHS = 8
#: Small training sets are gone through more often, until this many steps.
MIN_STEPS = 32768
RATE = 1.0
#: Labelled rows learned from, at most.
MAX_ROWS = 4096
WINDOW = 1 << 20
_SAME = np.uint64(0x5EED)


def _features(text: str, buckets: int) -> np.ndarray:
    x = codes(text)
    lo, hi = words(x)
    if not len(lo):
        return np.empty(0, np.int64)
    w = span_hashes(x, lo, hi)
    pair = mix(w[:-1] * np.uint64(31) + w[1:])
    pair[w[:-1] == w[1:]] = _SAME  # a word said again is the same event for every word
    found = [w, pair]
    space = (x == 32) | ((x >= 9) & (x <= 13))
    y = np.concatenate([[32], np.where(space, 32, x), [32]])
    gap = np.cumsum(y == 32)
    for n in (3, 4):
        g = grams(y, n)
        if len(g):
            inner = gap[n - 2 : len(y) - 1] - gap[: len(y) - n + 1]  # spaces between the first and the last character
            found.append(g[inner == 0])
    return (np.concatenate(found) % np.uint64(buckets)).astype(np.int64)


def features(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of a text, window by window; windows end at white space."""
    lo = 0
    while lo < len(text):
        hi = lo + WINDOW
        if hi < len(text):
            cut = max(text.rfind(c, lo, hi) for c in " \n\t")
            hi = cut if cut > lo else hi
        yield _features(text[lo:hi], buckets)
        lo = hi


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, buckets: int = BUCKETS, seed: int = 7) -> np.ndarray:
    """Folded weights (buckets + 1) x classes; the last row is the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (buckets, DIM)).astype(np.float32)
    out = np.zeros((classes, DIM), np.float32)
    share = np.bincount(labels, minlength=classes) + 0.5
    bias = np.log(share / share.sum()).astype(np.float32)
    epochs = max(EPOCHS, -(-MIN_STEPS // max(1, len(docs))))
    steps = max(1, epochs * len(docs))
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(len(docs)):
            at, n = docs[k]
            rate = RATE * (1 - step / steps)
            step += 1
            if not len(at):
                continue
            share_of = (n / n.sum()).astype(np.float32)
            rows = vectors[at]
            hidden = share_of @ rows
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = p @ out
            out -= rate * 0.1 * np.outer(p, hidden)
            # every part of the average learns as if it were the whole of it, damped by its share's root
            vectors[at] = rows - (rate * np.sqrt(share_of))[:, None] * back[None, :]
    return np.vstack([vectors @ out.T, bias]).astype(np.float32)


def fit(labelled: DataFrame, max_rows: int = MAX_ROWS, buckets: int = BUCKETS) -> tuple[np.ndarray, list[int]]:
    """Learn from ``(doc_id, text, label int)``; returns the folded weights and the labels."""
    rows = bare(labelled, "doc_id", "text", "label").where("label is not null")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, 4 << 20):
            at, n = [], []
            for t in texts(b, "text"):
                found = [f for f in features(t, buckets)]
                u, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
                at.append(u.astype(np.int32))
                n.append(c.astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column("label").cast(pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], names=["label", "at", "n"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, docs = [], []
        for b in batches:
            labels += b.column("label").to_pylist()
            docs += [(np.asarray(a.values), np.asarray(n.values)) for a, n in zip(b.column("at"), b.column("n"), strict=True)]
        if labels:
            known = sorted(set(labels))
            w = train(docs, np.searchsorted(known, labels), len(known), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(known, pa.int32()), pa.array([w[:, k].tobytes() for k in range(len(known))], pa.binary())], names=["label", "w"])

    counted = rows.mapInArrow(count, "label int, at array<int>, n array<float>")
    got = sorted(counted.repartition(1).mapInArrow(learn, "label int, w binary").toArrow().to_pylist(), key=lambda r: r["label"])
    if not got:
        return np.zeros((buckets + 1, 2), np.float32), [0, 1]
    return np.stack([np.frombuffer(r["w"], np.float32) for r in got], axis=1), [r["label"] for r in got]


def score(docs: DataFrame, model: tuple[np.ndarray, list[int]], wanted: int = 1) -> DataFrame:
    """``docs`` with ``score``: the probability of label ``wanted``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def one(w: np.ndarray, labels: list[int], text: str) -> float:
        total, n = np.zeros(w.shape[1]), 0
        for f in features(text, len(w) - 1):
            counts = np.bincount(f, minlength=len(w) - 1)
            at = np.flatnonzero(counts)
            total += counts[at] @ w[at]
            n += len(f)
        z = (total / n if n else total) + w[-1]
        p = np.exp(z - z.max())
        return float(p[labels.index(wanted)] / p.sum()) if wanted in labels else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, labels = sent.value
        for b in chunks(batches, 4 << 20):
            yield with_columns(b, {"score": pa.array([one(w, labels, t) for t in texts(b, "text")], pa.float64())})

    return docs.mapInArrow(run, widened(docs.schema, score="double"))
