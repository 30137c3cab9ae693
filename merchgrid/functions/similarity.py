"""Arrow functions for string similarity: the only per-row Python of the matching jobs.

The ratio is twice the number of characters in matching blocks over both lengths, where the longest common block
(the earliest in the first text, then in the second) splits both texts and each side is split again.  A
batch's distinct pairs are split together, level by level: one numpy sweep finds the longest block of every open
piece at once.  Where the second text has 200 characters or more, its frequent characters start no block
by definition; such pairs are measured one by one.
"""

from __future__ import annotations

import sys
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship the functions themselves, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: From this length on, frequent characters of the second text count as noise.
NOISY = 200
#: Cells (pieces times characters of the second text) that one sweep holds.
CELLS = 1 << 20


def ratio_of(a: str, b: str) -> float:
    """Ratcliff/Obershelp similarity; argument order matters for long strings."""
    return SequenceMatcher(None, a, b).ratio()


def _longest_blocks(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and starts of the longest common block of each row of ``a`` (length ``la``) and ``b``; other cells never match."""
    rows = np.arange(len(a))
    size, at_a, at_b = (np.zeros(len(a), np.int64) for _ in range(3))
    run = np.zeros((len(a), b.shape[1] + 1), np.int16)
    for i in range(a.shape[1]):
        run[:, 1:] = (run[:, :-1] + 1) * (b == a[:, i : i + 1])
        end = run.argmax(axis=1)  # the first of equal runs
        n = run[rows, end]
        longer = n > size
        size[longer], at_a[longer], at_b[longer] = n[longer], i + 1 - n[longer], end[longer] - n[longer]
    return size, at_a, at_b


def ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """The ratio of every pair."""
    out = [0.0] * len(pairs)
    short = []
    for k, (a, b) in enumerate(pairs):
        if len(b) >= NOISY or len(a) >= 4 * NOISY:
            out[k] = ratio_of(a, b)
        elif a and b:
            short.append(k)
        elif not a and not b:
            out[k] = 1.0
    short.sort(key=lambda k: len(pairs[k][1]))
    lo = 0
    while lo < len(short):
        hi = lo + 1
        while hi < len(short) and (hi - lo + 1) * len(pairs[short[hi]][1]) <= CELLS:
            hi += 1
        part = [pairs[k] for k in short[lo:hi]]
        for k, n in zip(short[lo:hi], _matched(part).tolist(), strict=True):
            out[k] = 2.0 * n / (len(pairs[k][0]) + len(pairs[k][1]))
        lo = hi
    return out


def _coded(texts: list[str], fill: int) -> np.ndarray:
    out = np.full((len(texts), max(map(len, texts))), fill, np.int32)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _matched(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Characters in matching blocks of each pair."""
    a, b = _coded([x for x, _ in pairs], -1), _coded([y for _, y in pairs], -2)
    total = np.zeros(len(pairs), np.int64)
    of = np.arange(len(pairs))
    a0, b0 = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    a1, b1 = (np.array([len(t) for t in side], np.int64) for side in zip(*pairs, strict=True))
    while len(of):
        la, lb = a1 - a0, b1 - b0
        i, j = np.arange(la.max()), np.arange(lb.max())
        x = np.where(i < la[:, None], a[of[:, None], np.minimum(a0[:, None] + i, a.shape[1] - 1)], -1)
        y = np.where(j < lb[:, None], b[of[:, None], np.minimum(b0[:, None] + j, b.shape[1] - 1)], -2)
        n, at_a, at_b = _longest_blocks(x, y, la, lb)
        np.add.at(total, of, n)
        left, right = (n > 0) & (at_a > 0) & (at_b > 0), (n > 0) & (at_a + n < la) & (at_b + n < lb)
        of, a0, a1, b0, b1 = (np.concatenate(z) for z in (
            (of[left], of[right]), (a0[left], (a0 + at_a + n)[right]), ((a0 + at_a)[left], a1[right]), (b0[left], (b0 + at_b + n)[right]), ((b0 + at_b)[left], b1[right])))
    return total


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    given = [None if x is None or y is None else (x, y) for x, y in zip(a, b)]
    distinct = list(dict.fromkeys(p for p in given if p is not None))
    known = dict(zip(distinct, ratios(distinct), strict=True))
    return pd.Series([None if p is None else known[p] for p in given], dtype="float64")


@F.pandas_udf(T.BooleanType())
def _any_homonym(foreign: pd.Series, missing: pd.Series) -> pd.Series:
    """Words of a row that differ and have a ratio of 0.55 or more; lengths too far apart can't reach it."""
    def close(fs, ms) -> list[tuple[str, str]]:
        return [(f, m) for f in fs for m in ms if f != m and 2 * min(len(f), len(m)) >= 0.55 * (len(f) + len(m))] if fs is not None and ms is not None else []

    rows = [close(f, m) for f, m in zip(foreign, missing)]
    distinct = list(dict.fromkeys(p for r in rows for p in r))
    near = {p for p, x in zip(distinct, ratios(distinct), strict=True) if x >= 0.55}
    return pd.Series([any(p in near for p in r) for r in rows], dtype="bool")


def sequence_ratio(a: Column, b: Column, needed: Column | None = None) -> Column:
    """U1; rows where ``needed`` is false are passed as nulls and cost nothing."""
    if needed is None:
        return _sequence_ratio(a, b)
    return _sequence_ratio(F.when(needed, a), F.when(needed, b))


def any_homonym(foreign: Column, missing: Column, needed: Column) -> Column:
    """Whether a foreign and a missing title word look alike."""
    return _any_homonym(F.when(needed, foreign), F.when(needed, missing))


def edit_ratio(a: Column, b: Column) -> Column:
    """JVM-side stand-in for the sequence ratio: 1 - edit distance / longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest.cast("double"))
