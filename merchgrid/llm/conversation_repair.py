"""Repair of conversation structure: grammar-compressed dynamic programming over role and fault sequences.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles.  Rows are kept (0), given another role
(3), deleted (4; the only edit for blank and repeated rows) or inserted (3); a cut-off row that is not deleted costs 3
more.  Each conversation gets the cheapest edits, of equal ones the ASCII-least audit.

* **Symbols.**  A row is one of nine symbols: to be deleted, or its role class with or without a cut-off.
* **Re-Pair.**  Rounds of distributed pair counts over all sequences name the most frequent neighbours by rules,
  ``ROUNDS * RULES`` at most; they only shorten the work, results don't depend on them.
* **One matrix per rule.**  A symbol's transfer matrix holds, for every state before and after it (nothing yet, system, user,
  assistant), the cheapest cost and its audit as a rope.  The min-plus product of two matrices is the rule's,
  evaluated once bottom-up and shared by all conversations; ropes share their parts and are compared by skipping equal ones.
  The least of equal costs is well defined under products: two audits of one cost between the same states are never prefixes of each other,
  as only inserts take no row and no audit of a matrix ends in one.
* **Blocks.**  Rows are dealt by range on conversation, turn, role and text digest, so one conversation may span any
  number of tasks.  Whole conversations within a task are finished there; of the others each block of ``ROWS`` rows becomes one matrix,
  the matrices of a conversation meet in one row each, and their path cuts the audit back into pieces for the blocks.
  The digest of a conversation is fed piece by piece.

What is written between the steps lies in the shared folder; a lost executor repeats tasks.

Defined results: rows are ordered by turn (nulls first), role, SHA-256 of the text; equal rows are interchangeable.  A null
conversation id is one conversation; null turn, role or text read as one space, so such a text is blank; a role of another
initial can't be kept; a conversation without rows has zeros, an empty audit and the empty text's digest;
an empty table gives an empty table; other columns are ignored; texts are treated whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from merchgrid.llm.common import bare, stored

#: Rows of a block, and characters after which one is closed.
ROWS = 1024
CHARS = 1 << 21
#: Rounds of pair counts, and rules named in each.
ROUNDS = 3
RULES = 64
#: Sequences remembered by a worker.
MEMO = 1 << 16
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
_CLASS = {"s": 0, "u": 1, "a": 2}
#: State after a row of each class that is kept, from each state (-1: can't be kept), and after an inserted or renamed row.
_KEPT = {START: (SYSTEM, USER, -1), SYSTEM: (-1, USER, -1), USER: (-1, -1, ASSISTANT), ASSISTANT: (-1, USER, -1)}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
#: Inserts that complete a conversation that ends in a state.
_TAIL = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_PRIME = (1 << 61) - 1
_BASE = 1_000_003
BLOCK = "conv_id bigint, part int, blk int, closed boolean, n int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, turns bigint, lo bigint, hi bigint, seq binary, roles array<string>, texts array<string>, digests array<string>"
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


class Rope:
    """A text that shares its halves with others; ``size`` and ``code`` tell equal ones."""

    __slots__ = ("code", "left", "right", "size", "text")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is not None:
            self.size, self.code = len(text), 0
            for c in text:
                self.code = (self.code * _BASE + ord(c)) % _PRIME
        else:
            self.size = left.size + right.size
            self.code = (left.code * pow(_BASE, right.size, _PRIME) + right.code) % _PRIME

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return self if self.size else other
        if self.text is not None and other.text is not None and self.size + other.size <= 64:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or (x.size == y.size and x.code == y.code):
                continue
            if x.text is not None and y.text is not None:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text[:n] < y.text[:n]
                if x.size > n:
                    a.append(Rope(x.text[n:]))
                if y.size > n:
                    b.append(Rope(y.text[n:]))
                continue
            # the longer side is taken apart
            if y.text is not None or (x.text is None and x.size >= y.size):
                a += [x.right, x.left]
                b.append(y)
            else:
                b += [y.right, y.left]
                a.append(x)
        return bool(b)

    def __str__(self) -> str:
        out, rest = [], [self]
        while rest:
            x = rest.pop()
            if x.text is not None:
                out.append(x.text)
            else:
                rest += [x.right, x.left]
        return "".join(out)


#: Cost and audit, by state before and after.
Matrix = list[list[tuple[int, Rope] | None]]


def _better(new: tuple[int, Rope], old: tuple[int, Rope] | None) -> bool:
    return old is None or new[0] < old[0] or (new[0] == old[0] and new[1] < old[1])


def symbol_matrix(symbol: int) -> Matrix:
    """0: to be deleted; else 1 + 2 * role class + cut-off."""
    out: Matrix = [[None] * 4 for _ in range(4)]

    def offer(i: int, j: int, cost: int, audit: str) -> None:
        if _better((cost, Rope(audit)), out[i][j]):
            out[i][j] = cost, Rope(audit)

    for i in range(4):
        state = i
        for inserts in range(3):  # a third one would only come back to a state
            cost, audit = 3 * inserts, "I" * inserts
            offer(i, state, cost + 4, audit + "D")
            if symbol:
                role, cut = divmod(symbol - 1, 2)
                kept = _KEPT[state][role] if role < 3 else -1
                if kept >= 0:
                    offer(i, kept, cost + 3 * cut, audit + "K")
                offer(i, _NEXT[state], cost + 3 + 3 * cut, audit + "R")
            state = _NEXT[state]
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return [vector(row, b) for row in a]


def vector(v: list[tuple[int, Rope] | None], m: Matrix) -> list[tuple[int, Rope] | None]:
    out: list[tuple[int, Rope] | None] = [None] * 4
    for k, x in enumerate(v):
        if x is not None:
            for j, y in enumerate(m[k]):
                if y is not None and (out[j] is None or x[0] + y[0] <= out[j][0]):
                    new = x[0] + y[0], x[1] + y[1]
                    if _better(new, out[j]):
                        out[j] = new
    return out


IDENTITY: Matrix = [[(0, Rope("")) if i == j else None for j in range(4)] for i in range(4)]


def finish(v: list[tuple[int, Rope] | None]) -> tuple[int, str]:
    """Cheapest cost and audit after the closing inserts."""
    return min((x[0] + 3 * len(_TAIL[i]), str(x[1]) + _TAIL[i]) for i, x in enumerate(v) if x is not None)


class Grammar:
    """Rules ``(left, right)`` that name symbols from 9 on, and the matrix of each."""

    def __init__(self, rules: tuple[tuple[int, int], ...]):
        self.rules = [(bytes(r), bytes([9 + k])) for k, r in enumerate(rules)]
        self.matrix = [symbol_matrix(s) for s in range(9)]
        for x, y in rules:
            self.matrix.append(product(self.matrix[x], self.matrix[y]))
        self.memo: dict[bytes, tuple[int, str]] = {}

    def packed(self, seq: bytes) -> bytes:
        for pair, name in self.rules:
            if len(seq) < 2:
                break
            seq = seq.replace(pair, name)
        return seq

    def block(self, seq: bytes) -> Matrix:
        out = IDENTITY
        for s in self.packed(seq):
            out = product(out, self.matrix[s])
        return out

    def whole(self, seq: bytes) -> tuple[int, str]:
        """Cheapest cost and audit of a conversation."""
        got = self.memo.get(seq)
        if got is None:
            v: list[tuple[int, Rope] | None] = [(0, Rope("")), None, None, None]
            for s in self.packed(seq):
                v = vector(v, self.matrix[s])
            got = finish(v)
            if len(seq) <= 64:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[seq] = got
        return got


@lru_cache(maxsize=2)
def _grammar(rules: tuple[tuple[int, int], ...]) -> Grammar:
    return Grammar(rules)


def edited(audit: str, roles: list[str], texts: list[str], state: int = START) -> tuple[list[str], int]:
    """The lines ``role:text`` that an audit leaves of rows, and the state behind them."""
    out, k = [], 0
    for edit in audit:
        if edit == "I":
            state = _NEXT[state]
            out.append("user:" if state == USER else "assistant:")
            continue
        if edit == "K":
            state = _KEPT[state][_CLASS[roles[k][:1]]]
            out.append(f"{roles[k]}:{texts[k]}")
        elif edit == "R":
            state = _NEXT[state]
            out.append(("user:" if state == USER else "assistant:") + texts[k])
        k += 1
    return out, state


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by ``crc32(conv_id:turn) % 20``; ``gone`` marks dropped ones, which tell that their conversation exists."""
    c = bare(conversations, "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    spoken = [F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn")]
    c = c.withColumn("act", (F.crc32(F.concat(spoken[0], F.lit(":"), spoken[1])) % 20).cast("int"))
    text = F.when(F.col("act") <= 1, "").when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("act") == 3, 2).otherwise(1)))
    return c.select("conv_id", "turn", F.when(F.col("act") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("act") == 0).alias("gone"), copies.alias("copy")).drop("copy")


class _Run:
    """Rows of one block while it grows."""

    def __init__(self, conv, part: int, blk: int):
        self.conv, self.part, self.blk = conv, part, blk
        self.roles, self.texts, self.digests, self.turns = [], [], [], []
        self.seq = bytearray()
        self.seen: set[tuple[str, str]] = set()
        self.count = [0, 0, 0, 0]
        self.chars = 0

    def add(self, turn, role: str, text: str, digest: str) -> None:
        bare_text = text.strip(SPACE)
        again = (role, digest) in self.seen
        cut = bool(bare_text) and bare_text[-1] not in ".!?"
        if self.roles and (self.roles[-1][:1], role[:1]) not in _LEGAL:
            self.count[3] += 1
        if not bare_text or again:
            self.count[0 if not bare_text else 1] += 1
            self.seq.append(0)
        else:
            self.count[2] += cut
            self.seq.append(1 + 2 * _CLASS.get(role[:1], 3) + cut)
            self.seen.add((role, digest))
        self.roles.append(role)
        self.texts.append(text)
        self.digests.append(digest if self.seq[-1] else None)  # none of rows that go anyway
        self.turns.append(turn)
        self.chars += len(text)

    def row(self, closed: bool) -> tuple:
        known = [t for t in self.turns if t is not None]
        head, tail = (self.roles[0][:1], self.roles[-1][:1]) if self.roles else (None, None)
        return (self.conv, self.part, self.blk, closed, len(self.roles), *self.count, head, tail, len(set(known)), known[0] if known else None, known[-1] if known else None, bytes(self.seq), self.roles, self.texts, None if closed else self.digests)


def blocks(rows: DataFrame) -> DataFrame:
    """Rows in order, as one row per block; ``closed`` blocks hold a whole conversation."""
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", "role", "text", gone.alias("gone"), F.sha2("text", 256).alias("digest"), F.rand(7).alias("salt"))
    order = ["conv_id", "turn", "role", "digest", "salt"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    schema = StructType.fromDDL(BLOCK)
    kind = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        done: list[tuple] = []
        size = blk = 0
        now: _Run | None = None
        whole = False  # the block began with its conversation, and not at the task's edge

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), kind, strict=True)], schema=kind)

        for b in batches:
            for conv, turn, role, text, out, digest in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if now is None or now.conv != conv or len(now.roles) >= ROWS or now.chars >= CHARS:
                    if now is not None:
                        done.append(now.row(whole and now.conv != conv))
                        size += now.chars + 64
                    whole = now is not None and now.conv != conv
                    now = _Run(conv, part, blk)
                    blk += 1
                    if size > 4 << 20:
                        yield batch()
                        done, size = [], 0
                if not out:
                    now.add(turn, role, text, digest)
        if now is not None:
            done.append(now.row(False))
            yield batch()

    return dealt.mapInArrow(run, schema)


def learn(seqs: DataFrame) -> tuple[tuple[int, int], ...]:
    """Re-Pair in rounds: the most frequent neighbours of all sequences so far, counted by task and added up."""
    rules: tuple[tuple[int, int], ...] = ()
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], rules=rules) -> Iterator[pa.RecordBatch]:
            g = _grammar(rules)
            total = np.zeros(1 << 16, np.int64)
            for b in batches:
                x = np.frombuffer(b"\xff".join(map(g.packed, b.column(0).to_pylist())), np.uint8).astype(np.int64)
                if len(x) > 1:
                    free = (x[:-1] < 255) & (x[1:] < 255)
                    total += np.bincount((x[:-1] * 256 + x[1:])[free], minlength=1 << 16)
            met = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(met // 256), pa.array(met % 256), pa.array(total[met])], names=["x", "y", "n"])

        counts = seqs.mapInArrow(run, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
        top = counts.where("n > 1").orderBy(F.desc("n"), "x", "y").limit(RULES).collect()
        if not top:
            break
        rules += tuple((r.x, r.y) for r in top)
    return rules


def _repaired_closed(b: DataFrame, rules: tuple[tuple[int, int], ...]) -> DataFrame:
    schema = StructType.fromDDL(RESULT + ", repaired_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _grammar(rules)
        for b in batches:
            c = {n: b.column(n) for n in b.schema.names}
            got = [g.whole(s) for s in c["seq"].to_pylist()]
            digests = [hashlib.sha256("\n".join(edited(a, r, t)[0]).encode()).hexdigest() for (_, a), r, t in zip(got, c["roles"].to_pylist(), c["texts"].to_pylist(), strict=True)]
            gaps = [0 if lo is None else hi - lo + 1 - n for lo, hi, n in zip(*(c[k].to_pylist() for k in ("lo", "hi", "turns")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [c["conv_id"], pa.array(gaps, pa.int64()), *(c[k] for k in ("blank", "duplicate", "truncated", "illegal")), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.string()), pa.array(digests, pa.string())],
                names=schema.names)

    return b.select("conv_id", "blank", "duplicate", "truncated", "illegal", "lo", "hi", "turns", "seq", "roles", "texts").mapInArrow(run, schema)


def _matrices(opened: DataFrame, rules: tuple[tuple[int, int], ...]) -> DataFrame:
    """Per block of an open conversation, its counts and matrix, with repeats of earlier blocks found.

    A text comes once per block to the window, so its rows there are 1 / ``ROWS`` of the conversation's at most.
    """
    each = opened.select("conv_id", "part", "blk", F.posexplode(F.arrays_zip("roles", "digests")).alias("at", "x"))
    alive = each.where("x.digests is not null").select("part", "blk", "at", F.row_number().over(Window.partitionBy("conv_id", "x.roles", "x.digests").orderBy("part", "blk")).alias("nth"))
    again = alive.where("nth > 1").groupBy(F.col("part").alias("p"), F.col("blk").alias("k")).agg(F.collect_list("at").alias("again"))
    rows = opened.drop("roles", "texts", "digests", "closed").join(again, (F.col("part") == F.col("p")) & (F.col("blk") == F.col("k")), "left").drop("p", "k")
    schema = StructType(list(rows.drop("seq", "again").schema.fields)).add("cost", ArrayType(LongType())).add("audit", ArrayType(StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = _grammar(rules)
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in b.schema.names}
            for i, found in enumerate(c["again"]):
                seq = bytearray(c["seq"][i])
                for at in found or []:
                    c["duplicate"][i] += 1
                    c["truncated"][i] -= (seq[at] - 1) % 2
                    seq[at] = 0
                c["seq"][i] = g.block(bytes(seq))
            entries = [[x for row in m for x in row] for m in c["seq"]]
            c["cost"] = [[None if x is None else x[0] for x in e] for e in entries]
            c["audit"] = [[None if x is None else str(x[1]) for x in e] for e in entries]
            yield pa.RecordBatch.from_arrays([pa.array(c[f.name], to_arrow_type(f.dataType)) for f in schema.fields], names=schema.names)

    return rows.mapInArrow(run, schema)


def _combined(matrices: DataFrame) -> DataFrame:
    """One row per open conversation; ``cuts`` gives each block its part of the audit and the state before it."""
    ddl = RESULT + ", cuts array<struct<part:int,blk:int,state:int,audit:string>>"
    kind = to_arrow_schema(StructType.fromDDL(ddl))

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["part"], r["blk"]))
        v: list[tuple[int, Rope] | None] = [(0, Rope("")), None, None, None]
        back: list[list[int | None]] = []  # the state before each block, by the state after it
        steps = []
        for r in rows:
            m = [[None if r["cost"][4 * i + j] is None else (r["cost"][4 * i + j], Rope(r["audit"][4 * i + j])) for j in range(4)] for i in range(4)]
            new, came = [None] * 4, [None] * 4
            for k, x in enumerate(v):
                for j in range(4):
                    if x is not None and m[k][j] is not None:
                        y = x[0] + m[k][j][0], x[1] + m[k][j][1]
                        if _better(y, new[j]):
                            new[j], came[j] = y, k
            v = new
            back.append(came)
            steps.append(m)
        cost, audit = finish(v)
        state = min((x[0] + 3 * len(_TAIL[i]), str(x[1]) + _TAIL[i], i) for i, x in enumerate(v) if x is not None)[2]
        cuts, tail = [], _TAIL[state]
        for r, came, m in zip(reversed(rows), reversed(back), reversed(steps), strict=True):
            before = came[state]
            cuts.append({"part": r["part"], "blk": r["blk"], "state": before, "audit": str(m[before][state][1]) + tail})
            state, tail = before, ""
        filled = [r for r in rows if r["n"]]
        illegal = sum(r["illegal"] for r in rows) + sum((x["tail"], y["head"]) not in _LEGAL for x, y in zip(filled, filled[1:], strict=False))
        timed = [r for r in rows if r["lo"] is not None]
        distinct = sum(r["turns"] for r in timed) - sum(x["hi"] == y["lo"] for x, y in zip(timed, timed[1:], strict=False))
        gaps = timed[-1]["hi"] - timed[0]["lo"] + 1 - distinct if timed else 0
        one = {"conv_id": rows[0]["conv_id"], "gaps": gaps, **{k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": cost, "audit": audit, "cuts": cuts}
        return pa.Table.from_pylist([one], schema=kind)

    return matrices.groupBy("conv_id").applyInArrow(run, ddl)


def _pieces(opened: DataFrame, combined: DataFrame) -> DataFrame:
    """The repaired lines of each block, null where it has none: ``conv_id, part, blk, piece``."""
    cuts = combined.select(F.explode("cuts").alias("c")).select(F.col("c.part").alias("p"), F.col("c.blk").alias("k"), F.col("c.state").alias("state"), F.col("c.audit").alias("edits"))
    rows = opened.select("conv_id", "part", "blk", "roles", "texts").join(cuts, (F.col("part") == F.col("p")) & (F.col("blk") == F.col("k"))).drop("p", "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lines = [edited(a, r, t, s)[0] for r, t, s, a in zip(*(b.column(k).to_pylist() for k in ("roles", "texts", "state", "edits")), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(["\n".join(x) if x else None for x in lines], pa.string())], names=["conv_id", "part", "blk", "piece"])

    return rows.mapInArrow(run, "conv_id bigint, part int, blk int, piece string")


def _digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's pieces in order, fed one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, h, any_line, begun = None, hashlib.sha256(), False, False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([h.hexdigest()])], names=["of", "repaired_sha256"])

        for b in batches:
            for c, piece in zip(b.column("conv_id").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if not begun or c != conv:
                    if begun:
                        yield row()
                    conv, h, any_line, begun = c, hashlib.sha256(), False, True
                if piece is not None:
                    h.update(("\n" if any_line else "").encode() + piece.encode())
                    any_line = True
        if begun:
            yield row()

    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "blk").mapInArrow(run, "of bigint, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``gaps``, counts of first faults, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    ``rows`` has ``conv_id, turn, role, text``; those marked ``gone``, if it has that column, only name their conversation.
    """
    b = stored(blocks(rows))
    rules = learn(b.select("seq"))
    opened = b.where("not closed")
    combined = stored(_combined(_matrices(opened, rules)))
    digests = _digests(_pieces(opened, combined))
    late = combined.drop("cuts").join(digests, F.col("conv_id").eqNullSafe(F.col("of")), "left").drop("of")
    return _repaired_closed(b.where("closed"), rules).unionByName(late)


def _oracle() -> str:
    """The contract as SQL: CRC-32 by folds, then one recursive step per row over the four states."""
    crc = "xor(list_reduce([4294967295] || list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT), lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

    def then(v: str, cost: str, letters: str, line: str, when: str = "true") -> str:
        return f"CASE WHEN {v} IS NOT NULL AND {when} THEN struct_pack(c := {v}.c + {cost}, a := {v}.a || '{letters}', t := {v}.t || {line}) END"

    nl, user, both = "chr(10)", "(chr(10) || 'user:')", "(chr(10) || 'user:' || chr(10) || 'assistant:')"
    kept = f"{nl} || r.role || ':' || r.text"

    def moves(v: list[str], role: str, name: str) -> list[str]:
        return [x for w in v for x in (then(w, "3 * r.cut", "K", kept, f"NOT r.kill AND left(r.role, 1) = '{role}'"), then(w, "3 + 3 * r.cut", "R", f"{nl} || '{name}:' || r.text", "NOT r.kill"))]

    def least(options: list[str]) -> str:
        return f"list_min([{', '.join(options)}])"

    ready = [
        "v0",
        "v1",
        least(["v2", *(then(v, "3", "I", user) for v in ("v0", "v1", "v3"))]),
        least(["v3", then("v2", "3", "I", f"({nl} || 'assistant:')"), *(then(v, "6", "II", both) for v in ("v0", "v1"))]),
    ]
    acted = [
        then("w0", "4", "D", "''"),
        least([then("w1", "4", "D", "''"), then("w0", "3 * r.cut", "K", kept, "NOT r.kill AND left(r.role, 1) = 's'")]),
        least([then("w2", "4", "D", "''"), *moves(["w0", "w1", "w3"], "u", "user")]),
        least([then("w3", "4", "D", "''"), *moves(["w2"], "a", "assistant")]),
    ]
    tail = [("v0", "''"), ("v1", both), ("v2", f"({nl} || 'assistant:')"), ("v3", "''")]
    ends = least([then(v, str(3 * n), "I" * n, line) for (v, line), n in zip(tail, (0, 2, 1, 0), strict=True)])
    nothing = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR))"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
acts AS (SELECT conv_id, turn, role, text, ({crc}) % 20 AS act FROM k),
rows_after AS (
  SELECT conv_id, turn, CASE WHEN act = 4 THEN 'user' ELSE role END AS role, CASE WHEN act = 1 THEN '' WHEN act = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN act = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM acts WHERE act <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM rows_after),
judged AS (
  SELECT *, rtrim(text, {space}) = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, right(rtrim(text, {space}), 1) NOT IN ('.', '!', '?') AS open,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) || '>' || left(role, 1) AS step FROM placed),
r AS MATERIALIZED (SELECT conv_id, turn, role, text, pos, blank, again AND NOT blank AS dup, open AND NOT again AND NOT blank AS trunc, blank OR again AS kill, (open AND NOT again AND NOT blank)::INT AS cut, step FROM judged),
convs AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (
  SELECT conv_id, 0::BIGINT AS pos, struct_pack(c := 0::BIGINT, a := '', t := '') AS v0, {nothing} AS v1, {nothing} AS v2, {nothing} AS v3 FROM convs
  UNION ALL
  SELECT w.conv_id, w.pos + 1, {", ".join(acted)} FROM (SELECT conv_id, pos, {", ".join(f"{x} AS w{i}" for i, x in enumerate(ready))} FROM dp) w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1),
final AS (SELECT conv_id, arg_max({ends}, pos) AS e FROM dp GROUP BY conv_id),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE trunc) AS truncated,
    count(*) FILTER (WHERE step NOT IN ('s>u', 'u>a', 'a>u')) AS illegal FROM r GROUP BY conv_id)
SELECT f.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  e.c AS cost, e.a AS audit, sha256(substr(e.t, 2)) AS repaired_sha256
FROM final f LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM f.conv_id"""


ORACLE = _oracle()
