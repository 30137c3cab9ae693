"""Byte-level BPE by backtracking over longest token matches, and decoding by an offset table.

A piece (what the splitting pattern yields) is encoded from left to right.  An Aho-Corasick
automaton gives the tokens that start at each position; the longest is tried first.  A token may follow
its predecessor only if the two are compatible, that is if merging their bytes as BPE does
gives these two tokens again; answers fill a pair table.  Where no token fits, the last
one is taken back and its next shorter match tried; a position given up is never tried again.
So every position is entered once and the time is linear in the piece, however long; the
result is exactly that of merging by rank.

Decoding lays all token bytes in one array; the bytes of a sequence are gathered by offset
and length in one numpy operation.

The vocabulary file is read on the driver and broadcast: its size is that of the file, which
does not grow with the data.  Results per distinct piece are remembered in a table that is
emptied at ``MEMO`` entries.

Defined results: null text counts as empty; an empty text has no tokens; extra columns are
ignored by ``encode`` and kept by ``with_tokens``.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from merchgrid.llm.common import bare, chunks, texts, widened, with_columns

#: The splitting pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words remembered by a worker (and a quarter of it, distinct pieces).
MEMO = 1 << 19
#: Characters up to which a piece is remembered.
MEMO_CHARS = 64


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in kept}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(kept))
    return [out[b] for b in range(256)]


class Bpe:
    """Encoder and decoder of one byte-level vocabulary (``tokenizers`` JSON)."""

    def __init__(self, spec: bytes):
        data = json.loads(spec)
        model = data["model"]
        vocab = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        for t in data.get("added_tokens", []):
            if t.get("lstrip") or t.get("rstrip") or t.get("single_word"):
                raise ValueError("added tokens that take in their surroundings are not supported")
        vocab.update(self.special)
        self.letters = byte_letters()
        self.to_letters = {b: ord(c) for b, c in enumerate(self.letters)}
        self.token = {i: s for s, i in vocab.items()}
        #: Id of a pair's merge, its rank, and the pair and rank of each merged token.
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            whole = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = (rank, whole)
            self.parts.setdefault(whole, (vocab[a], vocab[b]))
            self.rank.setdefault(whole, rank)
        self.automaton = ahocorasick.Automaton()
        for i in {*self.parts, *(vocab[c] for c in self.letters if c in vocab)}:
            self.automaton.add_word(self.token[i], (len(self.token[i]), i))
        self.automaton.make_automaton()
        #: For each token, which tokens may follow it; filled as pairs are met.
        self.pairs: list[dict[int, bool]] = [{} for _ in range(max(self.token) + 1)]
        self.whole = {self.token[i]: i for i in {*self.parts, *(vocab[c] for c in self.letters if c in vocab)}}
        #: Length of each token in byte letters, and the longest token that is a proper prefix of it.
        self.size = [0] * (max(self.token) + 1)
        self.shorter = [-1] * (max(self.token) + 1)
        for t, i in self.whole.items():
            self.size[i] = len(t)
            self.shorter[i] = next((self.whole[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.whole), -1)
        self.memo: dict[str, list[int]] = {}
        self.units: dict[str, list[int]] = {}
        self.wide = regex.compile(r"\s \s")
        self.split = regex.compile(PATTERN)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        back = {c: b for b, c in enumerate(self.letters)}
        size = max(self.token) + 1
        pieces = [bytes(back[c] for c in self.token[i]) if i in self.token and all(c in back for c in self.token[i]) else self.token.get(i, "").encode() for i in range(size)]
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.offset = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` apart when they stand side by side.

        Merges run by rank, so ``a`` and ``b`` come to be step by step.  Undoing the later one
        of the two last steps along their common border shows every pair that ever met there;
        they stay apart if no such pair had a merge of lower rank than the step that came next.
        """
        x, y, ahead, left_next = a, b, 1 << 60, True
        while True:
            m = self.merge.get((x, y))
            # a merge of equal rank runs from the left: the pair's own step at its left comes first
            if m is not None and (m[0] < ahead or (m[0] == ahead and not left_next)):
                return False
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx >= ry:  # equal ranks: the left one was made first, so undo the right one first
                if rx == ry:
                    ahead, left_next, y = ry, False, self.parts[y][0]
                else:
                    ahead, left_next, x = rx, True, self.parts[x][1]
            else:
                ahead, left_next, y = ry, False, self.parts[y][0]

    def lettered(self, piece: str) -> str:
        """A piece in byte letters."""
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", self.letters[32])
        return piece.encode("utf-8").decode("latin-1").translate(self.to_letters)

    def piece(self, letters: str) -> list[int]:
        """Token ids of one piece, given in byte letters."""
        n = len(letters)
        whole = self.whole.get(letters)
        if whole is not None:  # every token of the table encodes to itself
            return [whole]
        longest = [-1] * n
        for end, (size, i) in self.automaton.iter(letters):
            longest[end + 1 - size] = i  # ends grow, so the longest comes last
        sizes, shorter, pairs = self.size, self.shorter, self.pairs
        out: list[int] = []
        dead = bytearray(n + 1)
        pos, i, row = 0, longest[0], None
        while True:
            while i >= 0:
                if not dead[pos + sizes[i]]:
                    if row is None:
                        break
                    fits = row.get(i)
                    if fits is None:
                        fits = row[i] = self.compatible(out[-1], i)
                    if fits:
                        break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                pos += sizes[i]
                if pos == n:
                    return out
                row = pairs[i]
                i = longest[pos]
            elif out:
                dead[pos] = 1
                i = out.pop()
                pos -= sizes[i]
                i = shorter[i]
                row = pairs[out[-1]] if out else None
            else:
                raise ValueError("the text has a byte without a token")

    def plain(self, text: str) -> list[int]:
        """Ids of a text, or part of one, by the splitting pattern; pieces are remembered."""
        out: list[int] = []
        memo = self.memo
        for p in self.split.findall(text):
            ids = memo.get(p)
            if ids is None:
                ids = self.piece(self.lettered(p))
                if len(p) <= MEMO_CHARS:
                    if len(memo) >= MEMO // 4:
                        memo.clear()
                    memo[p] = ids
            out += ids
        return out

    def encode(self, text: str) -> list[int]:
        """Ids as without special tokens added; special tokens written in the text are found.

        The pattern never joins what stands on the two sides of a space with a word behind it,
        so a text is first cut at its spaces and whole words are remembered.  Where three
        or more white-space characters meet around a space that is not so; such texts are not cut.
        """
        if self.apart and self.apart.search(text):
            return [i for part in self.apart.split(text) if part for i in ([self.special[part]] if part in self.special else self.encode(part))]
        if self.wide.search(text):
            return self.plain(text)
        first, *rest = text.split(" ")
        out = self.plain(first)
        units = self.units
        for u in rest:
            ids = units.get(u)
            if ids is None:
                ids = self.piece(self.lettered(" " + u)) if u.isalpha() else self.plain(" " + u)  # a word of letters is one piece
                if len(u) <= MEMO_CHARS:
                    if len(units) >= MEMO:
                        units.clear()
                    units[u] = ids
            out += ids
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, special tokens kept; bytes that are no UTF-8 become replacement characters."""
        if not len(ids):
            return ""
        lo = self.offset[ids]
        size = self.offset[ids + 1] - lo
        ends = np.cumsum(size)
        at = np.repeat(lo - (ends - size), size) + np.arange(ends[-1])
        return self.blob[at].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _loaded(spec: bytes) -> Bpe:
    return Bpe(spec)


def _spec(spark, path: str):
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def with_tokens(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of ``text`` as ``ids array<int>``."""
    spec = _spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for b in chunks(batches, 4 << 20):
            col = pa.array([bpe.encode(t) for t in texts(b, text)], pa.list_(pa.int32()))
            yield with_columns(b, {ids: col})

    return docs.mapInArrow(run, widened(docs.schema, **{ids: "array<int>"}))


def decoded(tokens: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``tokens`` with the text of the ids as column ``text``."""
    spec = _spec(tokens.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for b in chunks(batches, 4 << 20):
            col = pa.array([bpe.decode(np.asarray(x or [], np.int64)) for x in b.column(ids).to_pylist()], pa.string())
            yield with_columns(b, {text: col})

    return tokens.mapInArrow(run, widened(tokens.schema, **{text: "string"}))


def round_trip(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: encode and decode every text in one pass; with ``token_ids`` if asked for."""
    spec = _spec(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(spec.value)
        for b in chunks(batches, 4 << 20):
            n, a, d, kept = [], [], [], []
            for t in texts(b, "text"):
                ids = np.asarray(bpe.encode(t), np.int64)
                n.append(len(ids))
                if keep_ids:
                    kept.append(ids.astype(np.int32))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                d.append(hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest())
            cols = {"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(d, pa.string())}
            if keep_ids:
                cols["token_ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    docs = bare(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * keep_ids)
