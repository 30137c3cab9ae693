"""Alignment of two tokenizers over the same texts, with an identity map as fast path.

A is a byte-level BPE (``tokenizers`` JSON), B a byte-fallback piece model (``sentencepiece``).  A
text is encoded by both behind one space, its bytes are cut where tokens of both end, and
the two tokens that end together at a cut are linked.

* **Identity map.**  An array gives for each id of A the id of B with the same bytes.  A group of one
  token on each side whose ids the array pairs is regular; regular groups are counted in a
  vector as long as A's vocabulary, one per task, and never shuffled as pairs.
* **Irregular groups** alone enter the pair shuffle, added up within each task first.  Two tokens that end together
  share their last bytes, so one is a suffix of the other: the pairs that can occur at all are
  enumerated from the two vocabularies (some hundred thousand, whatever the corpus), which
  bounds a task's counters, the shuffle and the table of counts that is sent back to the tasks.
* **Units.**  Neither tokenizer has a token across a space that follows another character than white space, so texts are cut there
  and each distinct unit is aligned once by a worker, which forgets all units when it holds ``MEMO``.

The first pass writes, per document, its groups' digest and its distinct links with their
numbers, and the counters of each task; the second adds up each document's links against the counts.
A lost executor repeats tasks of either pass; what the first one wrote stays.

Defined results: texts that are null, empty, or whose joined tokens of A or B give other bytes than space and text (the
piece model's own space sign, for one) have no tokens: zeros and the empty text.  Repeated rows count as
often as they occur; ties for a B id's highest count are all best; ids and other columns may be null;
columns with the names of added ones are replaced; an empty table gives an empty table.  Texts are treated whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from merchgrid.llm.bpe import byte_letters
from merchgrid.llm.common import chunks, stored

#: Units remembered by a worker, and the characters up to which a unit is.
MEMO = 1 << 19
MEMO_CHARS = 64
#: Units of texts that are aligned at a time.
SLICE = 1 << 16
ADDED = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "n_links": "bigint", "groups": "string", "groups_sha256": "string"}
#: A space behind white space: only other spaces start a unit.
_WIDE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")


class Aligned(NamedTuple):
    """One unit or text: its groups in writing, its links as places among all possible pairs (32-bit integers), its token numbers."""

    groups: str
    links: bytes
    n_a: int
    n_b: int


class Aligner:
    """Both tokenizers, the identity map and the pairs that can end together."""

    def __init__(self, a_spec: bytes, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_spec.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        back = {c: b for b, c in enumerate(byte_letters())}
        names = {i: s for s, i in self.a.get_vocab(with_added_tokens=True).items()}
        #: Bytes of every id.
        self.a_bytes = [bytes(back[c] for c in names[i]) if i in names and all(c in back for c in names[i]) else names.get(i, "").encode() for i in range(max(names) + 1)]
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.whole_only = any(re.search(r"[^▁\s]▁", self.b.id_to_piece(i)) for i in range(len(self.b_bytes)))
        self.size_a, self.size_b = len(self.a_bytes), len(self.b_bytes)
        first_a: dict[bytes, list[int]] = {}
        first_b: dict[bytes, list[int]] = {}
        for i, s in enumerate(self.a_bytes):
            first_a.setdefault(s, []).append(i)
        for i, s in enumerate(self.b_bytes):
            first_b.setdefault(s, []).append(i)
        #: Id of B with the same bytes for each id of A, or -1 (of several the last, which is no single byte's).
        self.same = [first_b[s][-1] if s in first_b else -1 for s in self.a_bytes]
        pairs = {a * self.size_b + b for s, ids in first_b.items() for b in ids for k in range(len(s)) for a in first_a.get(s[k:], ())}
        pairs.update(a * self.size_b + b for s, ids in first_a.items() for a in ids for k in range(len(s)) for b in first_b.get(s[k:], ()))
        #: All pairs that can end together, as ``a * size_b + b`` in order.
        self.pairs = array("q", sorted(pairs))
        self.pair_keys = np.frombuffer(self.pairs, np.int64)
        self.same_ids = np.array(self.same, np.int64)
        self.a_len, self.b_len = (np.array([len(s) for s in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Each id in writing, inside its group and at its side's end.
        self.signs = [f"{i}{sign}" for n, end in ((self.size_a, "|"), (self.size_b, ";")) for i in range(n) for sign in (",", end)]
        self.memo: dict[str, Aligned | None] = {}

    def _piece(self, i: int) -> bytes:
        if self.b.is_byte(i):
            return bytes([int(self.b.id_to_piece(i)[3:5], 16)])
        return self.b.id_to_piece(i).replace("▁", " ").encode("utf-8")

    def ids(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of space and text by A, of text by B, which adds the space (to an empty text, too)."""
        return self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text, num_threads=1) if text else [self.b.piece_to_id("▁")]

    def align(self, text: str) -> Aligned | None:
        """One text, whole; None where a side's bytes differ from space and text."""
        a, b = self.ids(text)
        whole = (" " + text).encode("utf-8")
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        out, links = [], []
        i = j = lo_a = lo_b = end_a = end_b = 0
        while i < len(a):
            end_a += len(self.a_bytes[a[i]])
            i += 1
            while end_b < end_a:
                end_b += len(self.b_bytes[b[j]])
                j += 1
            if end_a == end_b:
                x, y = a[i - 1], b[j - 1]
                regular = i - lo_a == 1 and j - lo_b == 1 and self.same[x] == y
                links.append(x if regular else self.size_a + bisect_left(self.pairs, x * self.size_b + y))
                out.append(f"{','.join(map(str, a[lo_a:i]))}|{','.join(map(str, b[lo_b:j]))}")
                lo_a, lo_b = i, j
        return Aligned(";".join(out), array("i", links).tobytes(), len(a), len(b))

    def units(self, texts: list[str]) -> list[Aligned]:
        """Distinct units that don't end in white space, encoded as one text and cut apart again.

        They don't meet in any token, so each is encoded as by itself.
        """
        raw = [(" " + u).encode("utf-8") for u in texts]
        a, b = (np.array(x, np.int64) for x in self.ids(" ".join(texts)))
        whole = b"".join(raw)
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != whole or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != whole:
            return [self.align(u) for u in texts]
        end_a, end_b = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        to_a, to_b = np.searchsorted(end_a, cuts, "right"), np.searchsorted(end_b, cuts, "right")
        x, y = a[to_a - 1], b[to_b - 1]
        alone = (np.diff(to_a, prepend=0) == 1) & (np.diff(to_b, prepend=0) == 1)
        links = np.where(alone & (self.same_ids[x] == y), x, self.size_a + np.searchsorted(self.pair_keys, x * self.size_b + y)).astype(np.int32)
        # both sides' tokens in the order of writing, each with the sign behind it
        of_a, of_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        written = np.empty(len(a) + len(b), np.int64)
        written[np.arange(len(a)) + np.concatenate([[0], to_b])[of_a]] = 2 * a + np.isin(end_a, cuts, assume_unique=True)
        written[np.arange(len(b)) + to_a[of_b]] = 2 * (self.size_a + b) + np.isin(end_b, cuts, assume_unique=True)
        signs = list(map(self.signs.__getitem__, written.tolist()))
        ends = np.cumsum([len(r) for r in raw])
        group, tok_a, tok_b = (np.searchsorted(z, ends, "right") for z in (cuts, end_a, end_b))
        out, g0, a0, b0 = [], 0, 0, 0
        for g1, a1, b1 in zip(group.tolist(), tok_a.tolist(), tok_b.tolist(), strict=True):
            out.append(Aligned("".join(signs[a0 + b0 : a1 + b1])[:-1], links[g0:g1].tobytes(), a1 - a0, b1 - b0))
            g0, a0, b0 = g1, a1, b1
        return out

    def fill(self, units: set[str]) -> None:
        """All of the units are remembered afterwards."""
        new = units - self.memo.keys()
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = units
        apart = {u for u in new if not u or u[-1].isspace() or "▁" in u}
        self.memo.update((u, self.align(u)) for u in apart)
        new = list(new - apart)
        if new:
            self.memo.update(zip(new, self.units(new), strict=True))

    def texts(self, texts: list[str]) -> list[Aligned | None]:
        """As ``align`` of each text, by units; None also for the empty text."""
        if self.whole_only:
            return [self.align(t) if t else None for t in texts]
        pieces: list[tuple[int, list[str]]] = []
        for k, t in enumerate(texts):
            if t:
                units = [u[1:] for u in _CUT.split(" " + t)] if _WIDE.search(" " + t) else t.split(" ")
                pieces += [(k, units[lo : lo + SLICE]) for lo in range(0, len(units), SLICE)]
        parts: list[list[Aligned | None]] = [[] for _ in texts]
        lo = 0
        while lo < len(pieces):
            hi, n = lo, 0
            while hi < len(pieces) and (hi == lo or n + len(pieces[hi][1]) <= SLICE):
                n += len(pieces[hi][1])
                hi += 1
            met = set(chain.from_iterable(units for _, units in pieces[lo:hi]))
            self.fill(met)
            for k, units in pieces[lo:hi]:
                got = list(map(self.memo.__getitem__, units))
                parts[k].append(None if None in got else joined(got))
            for u in met:
                if len(u) > MEMO_CHARS:
                    del self.memo[u]
            lo = hi
        # bytes of a unit differ: the whole text decides
        return [None if not p else self.align(t) if None in p else joined(p) for t, p in zip(texts, parts, strict=True)]


def joined(parts: list[Aligned]) -> Aligned:
    if len(parts) == 1:
        return parts[0]
    groups, links, n_a, n_b = zip(*parts, strict=True)
    return Aligned(";".join(groups), b"".join(links), sum(n_a), sum(n_b))


@lru_cache(maxsize=1)
def _aligner(a_spec: bytes, b_model: bytes) -> Aligner:
    return Aligner(a_spec, b_model)


def _rows(schema: StructType, n: int, **cols: pa.Array) -> pa.RecordBatch:
    """A batch of ``n`` rows; columns left out are null."""
    return pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, to_arrow_type(f.dataType)) for f in schema.fields], names=schema.names)


def first_pass(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep_groups: bool = False) -> DataFrame:
    """Documents (``row`` is set) with groups and links, and the counters of each task (``counts`` is set).

    A counter row without ``keys`` is a vector over A's ids; one with them counts pairs.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast(tuple(open(p, "rb").read() for p in (a_path, b_path)))
    rows = docs.select(F.struct("*").alias("row"))
    schema = StructType().add("row", rows.schema["row"].dataType)  # null in counter rows
    for name, kind in [*ADDED.items(), ("links", "array<int>"), ("times", "array<int>"), ("keys", "array<bigint>"), ("counts", "array<bigint>")]:
        schema.add(name, DataType.fromDDL(kind))
    many = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _aligner(*files.value)
        regular = np.zeros(al.size_a, np.int64)
        other = np.zeros(len(al.pairs), np.int64)
        for b in chunks(batches):
            got = al.texts([t or "" for t in b.column("row").field(text).to_pylist()])
            links = [np.frombuffer(g.links if g else b"", np.int32) for g in got]
            seen = np.bincount(np.concatenate(links), minlength=al.size_a + len(other))
            regular += seen[: al.size_a]
            other += seen[al.size_a :]
            distinct = [np.unique(x, return_counts=True) for x in links]
            digests = [hashlib.sha256(g.groups.encode()).hexdigest() if g else "" for g in got]
            sums = {"n_a": [g.n_a if g else 0 for g in got], "n_b": [g.n_b if g else 0 for g in got], "n_groups": list(map(len, links)), "n_links": list(map(len, links))}
            yield _rows(schema, b.num_rows, row=b.column("row"), **{k: pa.array(v, pa.int64()) for k, v in sums.items()},
                groups=pa.array([g.groups if g else "" for g in got] if keep_groups else [None] * len(got), pa.string()), groups_sha256=pa.array(digests, pa.string()),
                links=pa.array([x for x, _ in distinct], many), times=pa.array([n.astype(np.int32) for _, n in distinct], many))
        where = np.flatnonzero(other)
        longs = pa.list_(pa.int64())
        if regular.any():
            yield _rows(schema, 1, counts=pa.array([regular], longs))
        if len(where):
            yield _rows(schema, 1, keys=pa.array([al.pair_keys[where]], longs), counts=pa.array([other[where]], longs))

    return rows.mapInArrow(run, schema)


def pair_counts(passed: DataFrame, same: list[int], size_b: int) -> DataFrame:
    """Corpus-wide links of every id pair: ``a``, ``b``, ``n``, and ``best`` where no other A id has more links with that B id."""
    vectors = passed.where("counts is not null and keys is null").select(F.posexplode("counts").alias("a", "n")).where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    to_b = passed.sparkSession.createDataFrame([(a, b) for a, b in enumerate(same) if b >= 0], "a int, b int")
    regular = vectors.join(to_b, "a").select("a", "b", "n")
    pairs = passed.where("keys is not null").select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).select((F.col("x.keys") / size_b).cast("int").alias("a"), (F.col("x.keys") % size_b).cast("int").alias("b"), F.col("x.counts").alias("n"))
    every = regular.unionByName(pairs.groupBy("a", "b").agg(F.sum("n").alias("n")))
    top = every.groupBy(F.col("b").alias("top_b")).agg(F.max("n").alias("top"))
    return every.join(top, F.col("b") == F.col("top_b")).select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, text: str = "text", keep_groups: bool = False) -> DataFrame:
    """``docs`` with ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``groups_sha256``, ``n_best``, ``count_sum``, and ``groups`` if kept."""
    spark = docs.sparkSession
    al = _aligner(*(open(p, "rb").read() for p in (a_path, b_path)))
    passed = stored(first_pass(docs, a_path, b_path, text, keep_groups))
    # at most as many rows as the vocabularies have pairs that can end together
    table = pair_counts(passed, al.same, al.size_b).toArrow()
    a, b, n, best = (table.column(c).to_numpy() for c in ("a", "b", "n", "best"))
    same = np.array(al.same)
    place = np.where(same[a] == b, a, al.size_a + np.searchsorted(al.pair_keys, a.astype(np.int64) * al.size_b + b))
    count = np.zeros(al.size_a + len(al.pairs), np.int64)
    is_best = np.zeros(len(count), bool)
    count[place], is_best[place] = n, best
    sent = spark.sparkContext.broadcast((count, is_best))
    added = [c for c in ADDED if c != "groups" or keep_groups]
    rows = passed.where("row is not null").select("row", *added, "links", "times")
    schema = StructType(rows.schema.fields[:-2]).add("n_best", "long").add("count_sum", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, is_best = sent.value
        for batch in batches:
            links, times = batch.column("links"), batch.column("times")
            flat, k = links.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(batch.num_rows), links.value_lengths().fill_null(0).to_numpy())
            sums = []
            for weight in (k * is_best[flat], k * count[flat]):  # whole numbers, exact beyond 2^53
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, of, weight)
                sums.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *sums], names=schema.names)

    out = rows.mapInArrow(run, schema)
    names = [*added, "n_best", "count_sum"]
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() not in names], *names)
