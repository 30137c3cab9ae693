"""Benchmark decontamination by the q-gram lemma.

Texts are folded to lower-case letters and digits with one gap between words.  A passage of
``n`` characters that occurs with at most ``k`` edits shares ``n - q + 1 - k q`` of its
q-grams with its place in the text, on diagonals (text position minus passage position) that lie
within ``k`` of each other.  Shared q-grams are counted per passage in diagonal bands of at least twice
that width, each overlapping the next by half, so one band holds them all; bands that meet the
bound are regions that may hold the passage, and a banded alignment decides: it is a leak if
the whole passage aligns with at most ``k = EDITS * n`` edits.  Nothing within the budget is lost.

The passages' q-grams go to every task in blocks of ``BLOCK`` characters (a checked size); a
benchmark of any size is done block after block in one pass over the texts.  No shuffle.

Passages with fewer than ``MIN_CHARS`` folded characters leave no room for edits: they are leaks
where their words stand in a text as they are, found by the hash of as many neighbouring words and compared.

Long texts are searched in windows of ``WINDOW`` characters that reach beyond both ends; a window owns the places
that start in it.

Defined results: null texts count as empty, and passages without a letter or digit have no place; equal passages are all named; without passages nothing is
a leak; repeated rows are judged each; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchgrid.llm.common import bare, chunks, texts, widened, with_columns
from merchgrid.llm.vec import codes, grams, span_hashes

Q = 6
#: Edits allowed, as a share of the passage's characters.
EDITS = 0.1
MIN_CHARS = 24
#: Characters of passages sent to the tasks at once.
BLOCK = 1 << 20
WINDOW = 1 << 20
_BITS = 22
LEAKS = "array<struct<item_id:bigint,start:int,end:int,edits:int>>"


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """For each code point its lower-case letter or digit, or 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalnum():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def folded(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters (gaps are 0) and the position of each in the text."""
    x = _fold_table()[codes(text)]
    keep = x != 0
    if len(x) > 1:
        keep[1:] |= x[:-1] != 0
    at = np.flatnonzero(keep)
    x = x[at]
    if len(x) and x[-1] == 0:
        x, at = x[:-1], at[:-1]
    return x, at


@dataclass
class Passages:
    """q-gram index of one block of passages."""

    ids: list[int]
    texts: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    keys: np.ndarray  # distinct q-grams, sorted
    first: np.ndarray  # where each one's entries begin
    item: np.ndarray
    pos: np.ndarray
    seen: np.ndarray
    many: np.ndarray  # entries of each q-gram
    shift: np.ndarray  # half a band of each passage is two to this power wide, over its budget
    longest: int
    short: dict[int, dict[int, list[tuple[int, np.ndarray]]]]  # by number of words and hash: id and text


def word_spans(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a folded text."""
    gap = np.flatnonzero(x == 0)
    return np.append(0, gap + 1), np.append(gap, len(x))


def index(items: list[tuple[int, str]], q: int = Q, edits: float = EDITS) -> Passages:
    every = [(i, folded(t or "")[0].copy()) for i, t in items]
    every = [(i, x[1:] if x[0] == 0 else x) for i, x in every if x.any()]
    kept = [(i, x) for i, x in every if len(x) >= max(MIN_CHARS, q)]
    short: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
    for i, x in every:
        if len(x) < max(MIN_CHARS, q):
            h = int(span_hashes(x, np.array([0]), np.array([len(x)]))[0])
            short.setdefault(len(word_spans(x)[0]), {}).setdefault(h, []).append((i, x))
    n = np.array([len(x) for _, x in kept], np.int64)
    budget = np.minimum(np.floor(n * edits).astype(np.int64), (n - q) // q)  # the bound stays at 1 or more
    h = [grams(x, q) for _, x in kept]
    key = np.concatenate(h) if h else np.empty(0, np.uint64)
    item = np.repeat(np.arange(len(kept)), [len(x) for x in h])
    pos = np.concatenate([np.arange(len(x)) for x in h]) if h else np.empty(0, np.int64)
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    seen = np.zeros(1 << _BITS, bool)
    seen[(keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    shift = np.ceil(np.log2(budget + 1)).astype(np.int32)
    first = np.append(first, len(key)).astype(np.int32)
    return Passages([i for i, _ in kept], [x for _, x in kept], budget, n - q + 1 - budget * q, keys, first, item[order].astype(np.int32), pos[order].astype(np.int32), seen, np.diff(first), shift, int(n.max(initial=0)), short)


def _last_row(a: np.ndarray, b: np.ndarray, lo: int, hi: int, k: int) -> np.ndarray | None:
    """Edits that align all of ``a`` ending on each diagonal ``lo..hi`` of ``b``, from a free start; None once all exceed ``k``."""
    d = np.arange(lo, hi + 1)
    far = len(a) + len(b) + 1
    row = np.where((d >= 0) & (d <= len(b)), 0, far)
    slope = np.arange(len(d))
    pad = np.full(len(d) + len(a) + 1, 0xFFFFFFFF, np.uint32)
    start = max(0, -lo)
    take = b[max(0, lo) : max(0, lo) + len(pad) - start]
    pad[start : start + len(take)] = take  # pad[i + k] is b[i + lo + k]
    for i, c in enumerate(a):
        step = row + (pad[i : i + len(d)] != c)
        step[:-1] = np.minimum(step[:-1], row[1:] + 1)
        row = np.minimum.accumulate(step - slope) + slope
        if row.min() > k:
            return None
    return np.where((d + len(a) >= 0) & (d + len(a) <= len(b)), row, far)


def aligned(a: np.ndarray, b: np.ndarray, lo: int, hi: int, k: int) -> tuple[int, int, int] | None:
    """``(start, end, edits)`` of the best place of ``a`` in ``b`` near diagonals ``lo..hi``, within ``k`` edits."""
    row = _last_row(a, b, lo - k, hi + k, k)
    if row is None or row.min() > k:
        return None
    edits = int(row.min())
    end = int(np.argmin(row)) + lo - k + len(a)
    back = _last_row(a[::-1], b[:end][::-1], -edits, edits, edits)  # from the end, backwards
    start = end - len(a) if back is None else end - (int(np.argmin(back + np.abs(np.arange(-edits, edits + 1)) * 1e-6)) - edits + len(a))
    return max(0, start), end, edits


def leaks_in(x: np.ndarray, p: Passages, q: int = Q) -> list[tuple[int, int, int, int]]:
    """``(passage, start, end, edits)`` in one folded window."""
    h = grams(x, q)
    at = np.flatnonzero(p.seen[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
    if len(at) < (p.bound.min() if len(p.bound) else 1):
        return []
    k = np.searchsorted(p.keys, h[at])
    k[k == len(p.keys)] = 0
    hit = p.keys[k] == h[at]
    at, k = at[hit], k[hit]
    if not len(at):
        return []
    many = p.many[k]
    ends = np.cumsum(many)
    entry = np.repeat(p.first[k] - ends + many, many)
    entry += np.arange(ends[-1], dtype=np.int32)
    item = p.item[entry]
    diag = np.repeat(at.astype(np.int32), many) - p.pos[entry]
    # half bands, counted without telling equal q-grams apart: an upper bound of what two neighbours share
    low = int(p.longest)
    wide = ((len(x) + low) >> int(p.shift.min())) + 3
    key = item * np.int64(wide) + ((diag + low) >> p.shift[item])
    if wide * len(p.ids) <= 8 * len(key) + (1 << 20):
        halves = np.bincount(key, minlength=wide * len(p.ids))
        spots = np.flatnonzero(halves)
        counts, beside = halves[spots], halves[np.minimum(spots + 1, len(halves) - 1)]
    else:
        spots, counts = np.unique(key, return_counts=True)
        beside = np.where(np.append(spots[1:] == spots[:-1] + 1, False), np.append(counts[1:], 0), 0)
    bound = p.bound[spots // wide]
    bands = spots[counts + beside >= bound]
    out: list[tuple[int, int, int, int]] = []
    order = np.argsort(key, kind="stable") if len(bands) else None
    ranked = key[order] if len(bands) else None
    for spot in bands:
        i = int(spot // wide)
        w = 1 << int(p.shift[i])
        lo = int(spot % wide) * w - low
        mine = order[np.searchsorted(ranked, spot) : np.searchsorted(ranked, spot + 1, "right")]
        if len(np.unique(p.pos[entry[mine]])) < p.bound[i]:
            continue
        if out and out[-1][0] == i and lo <= out[-1][1] <= lo + w:
            continue  # the neighbouring band has found this place
        got = aligned(p.texts[i], x, lo, lo + 2 * w - 1, int(p.budget[i]))
        if got:
            out.append((i, *got))
    return out


def find(text: str, p: Passages, q: int = Q) -> list[tuple[int, int, int, int]]:
    """``(item_id, start, end, edits)`` of all leaks in a text, offsets in code points."""
    x, at = folded(text)
    reach = 2 * p.longest
    out = set()
    for lo in range(0, len(x), WINDOW) if p.longest else ():
        begin = max(0, lo - reach)
        for i, a, b, e in leaks_in(x[begin : lo + WINDOW + reach], p, q):
            if lo <= begin + a < lo + WINDOW:
                out.add((p.ids[i], int(at[begin + a]), int(at[begin + b - 1]) + 1, e))
    if p.short and len(x):
        starts, ends = word_spans(x)
        for n, wanted in p.short.items():
            first, last = starts[: len(starts) - n + 1], ends[n - 1 :]
            h = span_hashes(x, first, last) if len(first) else np.empty(0, np.uint64)
            for k in np.flatnonzero(np.isin(h, np.array(list(wanted), np.uint64))):
                for i, y in wanted[int(h[k])]:
                    if np.array_equal(y, x[first[k] : last[k]]):
                        out.add((i, int(at[first[k]]), int(at[last[k] - 1]) + 1, 0))
    return sorted(out, key=lambda r: (r[0] is not None, *[v or 0 for v in r]))


def blocks(benchmark: DataFrame, q: int = Q, edits: float = EDITS) -> Iterator[Passages]:
    """The passages, indexed block by block."""
    part: list[tuple[int, str]] = []
    size = 0
    for r in bare(benchmark, "item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        if part and size + len(r["text"]) > BLOCK:
            yield index(part, q, edits)
            part, size = [], 0
        part.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if part:
        yield index(part, q, edits)


def with_leaks(docs: DataFrame, benchmark: DataFrame, q: int = Q, edits: float = EDITS) -> DataFrame:
    """``docs`` with all leaks as column ``leaks``."""
    out = docs.drop("leaks").withColumn("leaks", F.array().cast(LEAKS))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
    for p in blocks(benchmark, q, edits):
        if not p.ids and not p.short:
            continue
        sent = docs.sparkSession.sparkContext.broadcast(p)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b in chunks(batches, 4 << 20):
                found = [
                    before + [{"item_id": i, "start": lo, "end": hi, "edits": e} for i, lo, hi, e in find(t, sent.value, q)]
                    for t, before in zip(texts(b, "text"), b.column("leaks").to_pylist(), strict=True)
                ]
                yield with_columns(b, {"leaks": pa.array(found, kind)})

        out = out.mapInArrow(run, widened(out.schema, leaks=LEAKS))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without those that hold a passage of ``benchmark``."""
    return with_leaks(docs.select(F.struct("*").alias("row"), "text"), benchmark).where(F.size("leaks") == 0).select("row.*")
