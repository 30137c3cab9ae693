"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

Tokens are words with A-Z in lower case and one end per text.  Counting covers every training
text: tasks add up their tokens in memory, flushing a full table, and Spark sums the rest.

The model.  A token is reached over three choices of ``WIDE`` classes each, P(token) =
P(c1 | h) P(c2 | c1, h) P(c3 | c1, c2, h).  The ``LEAVES - WIDE * WIDE`` most frequent tokens
have a leaf of their own; the others share the leaves of the last first-level class, dealt by
the hash of their ending, and within a leaf have their smoothed share of the leaf's count.
Each of the three is a softmax over a bias, which starts at the training counts and is trained, and hashed
features of the history: the word before (bigram), the word before that (skip), and both (trigram).
The tables have a fixed size.  Histories are leaves, so a word without a leaf of its own is known by its ending
both as what comes next and as what came before: n-grams over such words are not learned as words, and
what the features hold stops growing with the corpus, while the counts grow on.

Training.  Texts are dealt to ``ROUNDS`` rounds by hash, so each training text is used once.  In a
round every task starts from the broadcast weights, takes mini-batch gradient steps over its texts,
and returns the rows that it changed; Spark averages them by how often each was used.

Scoring runs in numpy over whole texts.  Counts of the ``FREQUENT`` most frequent tokens are broadcast (a
fixed number); every rarer token of a text is joined with the stored counts, which grow with the
corpus and are never collected.

Defined results: null text counts as empty and has just its end; a token unknown to
training has count 0; without training texts N and V are 0 and every score is 0; repeated rows
count each time; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchgrid.llm.common import bare, chunks, stored, texts

WIDE = 16
LEAVES = WIDE**3
OWN = LEAVES - WIDE * WIDE
#: Tokens whose counts are broadcast.
FREQUENT = 1 << 17
#: Distinct tokens that a task counts before it hands them on.
FLUSH = 1 << 18
#: Rows of the weight table of each (level, feature); a power of two.
ROWS = 1 << 13
ROUNDS = 3
BATCH = 1 << 15
RATE = 2.0
#: History features of each level: word before, the one before it, both.
FEATURES = (("prev", "skip", "both"),) * 3
#: Tokens scored in one numpy step.
PIECE = 1 << 15
END = b""


def tokens(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case, and the end; both by ASCII rules only."""
    out = text.encode("utf-8", "surrogatepass").lower().split()
    out.append(END)
    return out


def leaf_of(token: bytes) -> int:
    """Leaf of a token without one of its own: by its ending."""
    return OWN + (zlib.crc32(token[-3:]) & (LEAVES - OWN - 1))


def count_tokens(docs: DataFrame) -> DataFrame:
    """``(token, leaf, c)`` over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["token", "c"])

        seen: Counter = Counter()
        for b in chunks(batches, 4 << 20):
            for t in texts(b, "text"):
                seen.update(tokens(t))
            if len(seen) >= FLUSH:
                yield out(seen)
                seen = Counter()
        if seen:
            yield out(seen)

    return docs.select("text").mapInArrow(run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """What every task knows of the counts; all of bounded size."""

    total: int
    distinct: int
    count: dict[bytes, int]  # the most frequent tokens
    own: dict[bytes, int]  # their leaves, for those that have one
    leaf_count: np.ndarray  # tokens and distinct tokens of the shared leaves
    leaf_distinct: np.ndarray

    @cached_property
    def place(self) -> dict[bytes, int]:
        """Row of each frequent token in the two arrays below."""
        return {t: i for i, t in enumerate(self.count)}

    @cached_property
    def leaves(self) -> np.ndarray:
        return np.array([self.own[t] if t in self.own else leaf_of(t) for t in self.count], np.int64)

    @cached_property
    def log_counts(self) -> np.ndarray:
        return np.log10(np.fromiter(self.count.values(), float, len(self.count)) + 1)


def lexicon(counts: DataFrame) -> Lexicon:
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    # the most frequent ones are those from some count on: found from a histogram of fixed size, not by sorting
    step = F.floor(F.log2("c") * 16).cast("int")
    bins = sorted(counts.groupBy(step.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True)
    least, held = 1 << 30, 0
    for r in bins:
        held += r["n"]
        if held > FREQUENT:
            break
        least = r["bin"]
    top = counts.where((step >= least) | (F.col("token") == F.lit(END))).toArrow().to_pylist()  # FREQUENT + 1 rows at most
    known = {bytes(r["token"]): r["c"] for r in sorted(top, key=lambda r: (-r["c"], r["token"]))}
    words = [w for w in known if w != END][: OWN - 1]
    own = {w: i for i, w in enumerate([END, *words])}
    rest = counts.where("token <> X''")
    if words:  # tokens behind the last one with a leaf of its own
        last = known[words[-1]]
        rest = rest.where((F.col("c") < last) | (F.col("c") == last) & (F.col("token") > F.lit(words[-1])))
    # the end of a binary as its last three bytes, as leaf_of takes it
    ending = F.when(F.octet_length("token") <= 3, F.col("token")).otherwise(F.expr("substring(token, octet_length(token) - 2, 3)"))
    leaf = (F.crc32(ending).bitwiseAND(F.lit(LEAVES - OWN - 1))).cast("int")
    got = rest.groupBy(leaf.alias("leaf")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()  # one row per shared leaf
    leaf_count, leaf_distinct = np.zeros(LEAVES - OWN), np.zeros(LEAVES - OWN)
    for r in got:
        leaf_count[r["leaf"]], leaf_distinct[r["leaf"]] = r["c"], r["v"]
    return Lexicon(total or 0, distinct, known, own, leaf_count, leaf_distinct)


def offsets() -> list[list[int]]:
    """Where the rows of each (level, feature) begin; the biases come first."""
    at, out = 1 + WIDE + WIDE * WIDE, []
    for level in FEATURES:
        out.append([])
        for _ in level:
            out[-1].append(at)
            at += ROWS
    return out


N_ROWS = 1 + WIDE + WIDE * WIDE + ROWS * sum(map(len, FEATURES))


def start_weights(lex: Lexicon) -> np.ndarray:
    """Biases are the logarithms of the training shares, features are zero."""
    mass = np.full(LEAVES, 0.5)
    for w, i in lex.own.items():
        mass[i] += lex.count.get(w, 0)
    mass[OWN:] += lex.leaf_count + 1
    w = np.zeros((N_ROWS, WIDE), np.float32)
    cube = mass.reshape(WIDE, WIDE, WIDE)
    for k, x in enumerate((cube.sum((1, 2))[None, :], cube.sum(2), cube.reshape(-1, WIDE))):
        lo = (0, 1, 1 + WIDE)[k]
        w[lo : lo + len(x)] = np.log(x / x.sum(1, keepdims=True))
    return w


OFFSETS = offsets()


def _rows(leaf: np.ndarray, prev: np.ndarray, skip: np.ndarray) -> list[tuple[np.ndarray, list[np.ndarray]]]:
    """For each level the class chosen, and the weight rows in use: the bias, then the features."""
    c1, c2, c3 = leaf >> 8, leaf >> 4, leaf & 15
    p, s, u = prev.astype(np.uint32), skip.astype(np.uint32), np.uint32  # hashes are taken modulo 2 ** 32
    history = {"prev": p * u(40503), "skip": s * u(52711) + u(7), "both": p * u(92821) + s * u(68917) + u(3)}
    out = []
    for level, (node, bias, chosen) in enumerate(((None, np.zeros_like(leaf), c1), (c1 + 1, 1 + c1, c2 & 15), (c2 + 17, 1 + WIDE + c2, c3))):
        rows = [bias]
        salt = u(0) if node is None else node.astype(np.uint32) * u(7919)
        for name, lo in zip(FEATURES[level], OFFSETS[level], strict=True):
            h = history[name] + salt
            h ^= h >> u(15)
            h *= u(0x2C1B3C6D)
            h ^= h >> u(12)
            h *= u(0x297A2D39)
            h ^= h >> u(15)
            h &= u(ROWS - 1)
            h += u(lo)
            rows.append(h.astype(np.intp))
        out.append((chosen, rows))
    return out


def _logits(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = w.take(rows[0], axis=0)
    for r in rows[1:]:
        z += w.take(r, axis=0)
    return z


#: Adds up the classes of each row; a product with ones takes a fraction of a sum along so short an axis.
ONES = np.ones(WIDE, np.float32)


def log_leaf(w: np.ndarray, leaf: np.ndarray, prev: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Natural logarithm of the probability of each leaf given its history."""
    out = np.zeros(len(leaf))
    at = np.arange(len(leaf)) * WIDE
    for chosen, rows in _rows(leaf, prev, skip):
        z = _logits(w, rows)
        out += z.ravel().take(at + chosen)
        out -= np.log(np.exp(z, out=z) @ ONES)
    return out


def gradient_step(w: np.ndarray, used: np.ndarray, leaf: np.ndarray, prev: np.ndarray, skip: np.ndarray, rate: float = RATE) -> None:
    """One mini-batch: every row moves by the mean gradient of its events, damped where they are few."""
    at = np.arange(len(leaf)) * WIDE
    for chosen, rows in _rows(leaf, prev, skip):
        p = _logits(w, rows)
        np.exp(p, out=p)
        p /= -(p @ ONES)[:, None]
        p.ravel()[at + chosen] += 1
        for r in rows:
            order = np.argsort((r & 0xFFFF).astype(np.uint16) if ROWS <= 1 << 16 else r, kind="stable")  # rows of one table differ in these bits
            sorted_rows = r.take(order)
            starts = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
            n = np.diff(np.append(starts, len(r)))
            row = sorted_rows[starts]
            used[row] += n
            w[row] += (rate * np.add.reduceat(p.take(order, axis=0), starts, axis=0) / np.sqrt(used[row] * n + 4.0)[:, None]).astype(np.float32)


@dataclass
class Encoded:
    """Tokens of several texts, one after the other."""

    words: list[bytes]
    size: np.ndarray  # tokens of each text
    place: np.ndarray  # row of each frequent token, -1 for the others
    leaf: np.ndarray
    prev: np.ndarray
    skip: np.ndarray


def encoded(lex: Lexicon, several: list[str]) -> Encoded:
    words: list[bytes] = []
    size = []
    for t in several:
        before = len(words)
        words += tokens(t)
        size.append(len(words) - before)
    size = np.array(size, np.int64)
    place = np.array(list(map(lex.place.get, words, repeat(-1))), np.int64)
    leaf = lex.leaves[place] if len(lex.leaves) else np.zeros(len(words), np.int64)
    for i in np.flatnonzero(place < 0):
        leaf[i] = lex.own[words[i]] if words[i] in lex.own else leaf_of(words[i])
    # before the start of a text stands the end, as it does behind the text before
    prev, skip = np.zeros_like(leaf), np.zeros_like(leaf)
    prev[1:], skip[2:] = leaf[:-1], leaf[:-2]
    starts = np.cumsum(size) - size
    prev[starts] = 0
    skip[starts] = 0
    return Encoded(words, size, place, leaf, prev, skip)


def train(docs: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after one pass over all rows of ``docs``, dealt to ``rounds`` rounds."""
    spark = docs.sparkSession
    w = start_weights(lex)
    lexed = spark.sparkContext.broadcast(lex)
    dealt = docs.select("text", F.pmod(F.xxhash64("text"), F.lit(rounds)).alias("round"))
    for k in range(rounds):
        sent = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            first = sent.value
            mine, used = first.copy(), np.zeros(len(first))
            known = lexed.value
            for b in chunks(batches, 1 << 20):
                e = encoded(known, texts(b, "text"))
                for lo in range(0, len(e.leaf), BATCH):
                    gradient_step(mine, used, e.leaf[lo : lo + BATCH], e.prev[lo : lo + BATCH], e.skip[lo : lo + BATCH])
            rows = np.flatnonzero(used)
            moved = (mine[rows] - first[rows]) * used[rows, None]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(used[rows]), *(pa.array(moved[:, j].astype(np.float32)) for j in range(WIDE))], names=["row", "used", *(f"g{j}" for j in range(WIDE))])

        part = dealt.where(F.col("round") == k).select("text").mapInArrow(run, "row int, used double, " + ", ".join(f"g{j} float" for j in range(WIDE)))
        got = part.groupBy("row").agg(F.sum("used").alias("used"), *[F.sum(f"g{j}").alias(f"g{j}") for j in range(WIDE)]).toArrow()  # N_ROWS rows at most
        rows = got.column("row").to_numpy()
        w = w.copy()
        w[rows] += np.stack([got.column(f"g{j}").to_numpy() for j in range(WIDE)], axis=1) / got.column("used").to_numpy()[:, None]
        sent.destroy()
    return w


def score(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``, learning from the rows of ``learn``."""
    spark = docs.sparkSession
    learn = bare(learn, "text").select(F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(count_tokens(learn))
    lex = lexicon(counts)
    w = train(learn, lex) if lex.total else start_weights(lex)
    lexed, sent = spark.sparkContext.broadcast(lex), spark.sparkContext.broadcast(w)
    kind = bare(docs, "doc_id").schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights = lexed.value, sent.value
        in_leaf = np.log10(known.leaf_count + known.leaf_distinct + 1)
        norm = math.log10(known.total + known.distinct + 1)
        for b in chunks(batches, 1 << 20):
            e = encoded(known, texts(b, "text"))
            logs = np.concatenate([log_leaf(weights, e.leaf[k : k + PIECE], e.prev[k : k + PIECE], e.skip[k : k + PIECE]) for k in range(0, len(e.leaf), PIECE)]) / math.log(10)
            frequent = e.place >= 0
            have = np.where(frequent, known.log_counts[e.place], 0.0) if len(known.log_counts) else np.zeros(len(e.leaf))
            # a shared leaf gives its tokens their smoothed share of its count; rare ones get theirs by the join
            shared = e.leaf >= OWN
            logs[shared] += have[shared] - in_leaf[e.leaf[shared] - OWN]
            ends = np.cumsum(e.size)
            starts = ends - e.size
            n_tokens = e.size
            n_known = np.add.reduceat(frequent.astype(np.int64), starts)
            base = np.add.reduceat(have, starts) - e.size * norm
            model = np.add.reduceat(logs, starts) if known.total else np.zeros(len(e.size))
            spots = np.flatnonzero(~frequent)
            cut = np.searchsorted(spots, np.append(starts, len(e.leaf)))
            rare = [[e.words[i] for i in spots[cut[k] : cut[k + 1]]] for k in range(len(e.size))]
            cols = [b.column("doc_id"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(model, pa.float64()), pa.array(rare, pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "n_known", "base", "model", "rare"])

    part = bare(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, base double, model double, rare array<binary>")
    part = stored(part.withColumn("rid", F.monotonically_increasing_id()))
    rare = part.select("rid", F.explode("rare").alias("token")).groupBy("rid", "token").agg(F.count(F.lit(1)).alias("m"))
    found = rare.join(counts, "token").groupBy("rid").agg(F.sum("m").alias("known"), F.sum(F.col("m") * F.log10(F.col("c") + 1)).alias("extra"))
    out = part.drop("rare").join(found, "rid", "left").na.fill(0, ["known", "extra"])
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(lex.total).cast("long").alias("train_tokens"), (F.col("base") + F.col("extra")).alias("base_score"), (F.col("model") + F.col("extra")).alias("score"))
