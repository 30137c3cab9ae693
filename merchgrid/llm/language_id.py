"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of 1 to ``ORDERS`` letters of every training text, by
language; the counts of a task leave it as one row per language and bucket that occurred, and
Spark adds them up.  The log-probability matrix (languages x buckets) is the model: its size is
fixed by ``buckets`` and by ``MAX_LANGUAGES``, which is checked, so it can be broadcast.
Scoring sums matrix rows over the n-grams of whole texts, in numpy, window by window.

Defined results: a text that is null or has no letter is ``und`` with score 0; null labels
teach nothing; ties go to the language first in alphabetical order; with nothing to learn
from, every text is ``und``; repeated rows count as often as they occur; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchgrid.llm.common import bare, chunks, widened, with_columns
from merchgrid.llm.vec import codes, grams

ORDERS = 4
BUCKETS = 1 << 15
MAX_LANGUAGES = 1000
#: Characters looked at in one step; longer texts are taken window by window.
WINDOW = 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def buckets_of(text: str, orders: int = ORDERS, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the n-grams of a text, window by window, each n-gram once.  Runs of other characters are one gap."""
    table = _letters()
    carry, last = np.zeros(1, np.uint32), 0
    for lo in range(0, len(text), WINDOW):
        y = table[codes(text[lo : lo + WINDOW])]
        keep = y != 0
        keep[1:] |= y[:-1] != 0  # the first of a gap stays
        keep[0] |= last != 0
        last = y[-1]
        x = y[keep]
        if last and lo + WINDOW >= len(text):
            x = np.append(x, np.uint32(0))
        cur = np.concatenate([carry, x])
        found = [grams(x[x != 0], 1)] + [grams(cur[max(0, len(carry) - n + 1) :], n) for n in range(2, orders + 1)]
        carry = cur[-(orders - 1) :]
        yield (np.concatenate(found) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # buckets x languages

    def predict(self, text: str | None) -> tuple[str, float]:
        total, n = np.zeros(len(self.languages)), 0
        for b in buckets_of(text or "", buckets=len(self.logp)):
            counts = np.bincount(b, minlength=len(self.logp))
            at = np.flatnonzero(counts)
            total += counts[at] @ self.logp[at]
            n += len(b)
        if not n or not self.languages:
            return "und", 0.0
        # overlapping grams repeat evidence: each letter counts once
        z = (total - total.max()) / ORDERS
        p = np.exp(z)
        k = int(np.argmax(total))
        return self.languages[k], float(p[k] / p.sum())


def count_grams(labelled: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(lang, bucket, n)`` over all rows of ``(text, lang)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in chunks(batches, 4 << 20):
            for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                if lang not in seen:
                    if len(seen) >= MAX_LANGUAGES:
                        raise ValueError("too many languages")
                    seen[lang] = np.zeros(buckets, np.int64)
                for found in buckets_of(text or "", buckets=buckets):
                    seen[lang] += np.bincount(found, minlength=buckets)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])

    return labelled.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, buckets: int = BUCKETS, smooth: float = 0.5) -> Model:
    """Learn from all rows of ``(text, lang)`` with a language."""
    rows = count_grams(bare(labelled, "text", "lang").where("lang is not null"), buckets)
    per = rows.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))  # at most `buckets` entries a language
    got = sorted(per.limit(MAX_LANGUAGES + 1).toArrow().to_pylist(), key=lambda r: r["lang"])
    if len(got) > MAX_LANGUAGES:
        raise ValueError("too many languages for a broadcast model")
    logp = np.full((buckets, len(got)), float(smooth))
    for k, r in enumerate(got):
        logp[np.asarray(r["b"], np.int64), k] += np.asarray(r["n"], float)
    return Model([r["lang"] for r in got], np.log(logp / logp.sum(axis=0, keepdims=True)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in chunks(batches, 4 << 20):
            found = [m.predict(t) for t in b.column("text").to_pylist()]
            yield with_columns(b, {"lang_pred": pa.array([x for x, _ in found], pa.string()), "score": pa.array([x for _, x in found], pa.float64())})

    return docs.mapInArrow(run, widened(docs.schema, lang_pred="string", score="double"))
