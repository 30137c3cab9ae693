"""Texts as numpy code points: rolling n-gram hashes and word hashes without a Python loop per character."""

from __future__ import annotations

import numpy as np

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_tables: dict[str, np.ndarray] = {}


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (splitmix64 finalizer)."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, kept and grown as needed."""
    if "up" not in _tables or len(_tables["up"]) < n:
        size = 1 << max(16, n.bit_length())
        for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            _tables[name] = np.cumprod(p)
    return _tables["up"], _tables["down"]


def grams(x: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of ``n`` neighbours of ``x`` (empty if there is none)."""
    if len(x) < n:
        return np.empty(0, np.uint64)
    x = x.astype(np.uint64)
    h = x[: len(x) - n + 1].copy()
    for k in range(1, n):
        h = h * np.uint64(_BASE) + x[k : len(x) - n + 1 + k]
    return mix(h + np.uint64(n))


def words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs free of ASCII white space."""
    inside = np.zeros(len(x) + 2, np.int8)
    inside[1:-1] = ~((x == 32) | ((x >= 9) & (x <= 13)))
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def span_hashes(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hash of every span ``x[lo:hi]``."""
    up, down = _powers(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * up[: len(x)], out=total[1:])
    return mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))
