"""N-gram Jaccard join by MinHash banding.

Every text becomes the set of its runs of ``N`` words (64-bit hashes).  Rows of equal sets are one
node.  ``choose_bands`` takes the most rows per band, within ``MAX_HASHES``, that still let two sets
at the threshold meet in a band with probability ``RECALL``; band hashes are shuffled and nodes
that share one are candidates.  Candidates are verified on their full n-gram sets.

A bucket may hold a third of all nodes, so pairs are never listed:

* Every node looks up to a hub, the smallest node of its buckets, and on to that node's own hub.  Members of a hub are cut
  into blocks of about ``BLOCK_NODES`` and compared with the hub's set.  A node within half the
  allowed distance of the hub is near; by the triangle inequality of set differences all near
  members of a hub are linked with each other, which is counted, not listed.
* What remains is verified by pairs of blocks that share a bucket: the sets of both blocks
  travel once, intersections are a matrix product, and only sums per node leave the task.  Blocks of
  near members of one hub aren't paired with each other.  A group of m texts that are neither copies nor near
  the hub costs (m / ``BLOCK_NODES``) squared block pairs: its links may be as many as its pairs.

Classes are the connected components of the links, found by rounds of smallest labels with
pointer jumping over stored tables.  Groups of any size are looked up by ``attach``.

Defined results: null text counts as empty; a text of fewer than ``N`` words is one n-gram of
all its words; a text without words has no set, links with nothing and is a class of its own; repeated
rows are copies; ``n_links`` counts the other rows of similarity >= the threshold, copies included;
of each class the row with the smallest doc_id is kept (null ids last, then the first row);
an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from merchgrid.llm.common import attach, bare, chunks, stored, texts
from merchgrid.llm.vec import codes, grams, mix, span_hashes, words

N = 5
#: The similarity, as a fraction so that it is compared exactly.
THRESHOLD = (4, 5)
RECALL = 0.9999
MAX_HASHES = 300
#: Times that a node's hub gives way to the hub's own; any number gives the same links, more gathers a group around fewer hubs.
HUB_STEPS = 3
#: Nodes of a block, and the n-grams that they may have together on average.
BLOCK_NODES, BLOCK_GRAMS = 512, 1 << 20
#: Columns of the incidence matrix multiplied at once.
COLUMNS = 1 << 13


def choose_bands(threshold: float, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """``(bands, rows)``: the most selective choice that meets ``recall`` at ``threshold``."""
    best = None
    for rows in range(1, 33):
        p = threshold**rows
        bands = 1 if p >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows <= most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no choice of bands meets the recall within the hashes allowed")
    return best


def ngrams(text: str, n: int = N) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    x = codes(text)
    lo, hi = words(x)
    if not len(lo):
        return np.empty(0, np.uint64)
    return np.unique(grams(span_hashes(x, lo, hi), min(n, len(lo))))


def _constants(count: int, seed: int = 20) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 1 << 63, count, np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def band_hashes(s: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int, rows: int) -> np.ndarray:
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 2048):
        low = np.minimum(low, (s[k : k + 2048, None] * a + b).min(axis=0))
    m = (low >> np.uint64(20)).reshape(bands, rows)
    h = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        h = mix(h * np.uint64(31) + m[:, k])
    return h.view(np.int64)


def set_key(s: np.ndarray) -> str | None:
    return hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``(rid, doc_id, text_key, set_key, size, bands)`` per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _constants(bands * rows)
        for batch in chunks(batches, 4 << 20):
            sets = [ngrams(t, n) for t in texts(batch, "text")]
            cols = [*(batch.column(c) for c in ("rid", "doc_id", "text_key")), pa.array([set_key(s) for s in sets], pa.string()), pa.array([len(s) for s in sets], pa.int64()), pa.array([band_hashes(s, a, b, bands, rows) if len(s) else [] for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "doc_id", "text_key", "set_key", "size", "bands"])

    kind = bare(docs, "doc_id").schema["doc_id"].dataType.simpleString()
    rows_ = bare(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    return rows_.mapInArrow(run, f"rid long, doc_id {kind}, text_key long, set_key string, size long, bands array<long>")


def gram_sets(docs: DataFrame, n: int) -> DataFrame:
    """``(set_key, grams binary)`` of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4 << 20):
            sets = [ngrams(t, n) for t in texts(batch, "text")]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.string()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["set_key", "grams"])

    return docs.select("text").mapInArrow(run, "set_key string, grams binary")


def _near(threshold: tuple[int, int]):
    num, den = threshold

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hub = next((np.frombuffer(g, np.uint64) for g, p in zip(pdf["grams"], pdf["pivot"], strict=True) if p), None)
        rows = pdf[~pdf["pivot"]]
        near = []
        for g in rows["grams"]:
            s = np.frombuffer(g, np.uint64)
            apart = len(s) + len(hub) - 2 * len(np.intersect1d(s, hub, assume_unique=True)) if hub is not None else 1 << 60
            near.append(apart * (den + num) <= len(s) * (den - num))
        return pd.DataFrame({"node": rows["node"].to_numpy(), "near": near})

    return run


def linked(sets: list[np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    """Which of the sets are similar: intersections as a product of incidence matrices."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(sets), len(sets)))
    for lo in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[a:b], column[a:b] - lo] = 1
        both += m @ m.T
    num, den = threshold
    out = both * den >= num * (size[:, None] + size[None, :] - both)
    np.fill_diagonal(out, False)
    return out


def _pair_links(threshold: tuple[int, int]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        side, node, w = pdf["side"].to_numpy(), pdf["node"].to_numpy(), pdf["w"].to_numpy()
        out = linked([np.frombuffer(g, np.uint64) for g in pdf["grams"]], threshold)
        if (side != 0).any():  # two blocks: only links across
            out &= side[:, None] != side[None, :]
        links = out @ w
        root = np.arange(len(node))
        for i in range(len(node)):  # within a block pair: smallest reachable node
            if root[i] == i:
                todo = [i]
                while todo:
                    for k in np.flatnonzero(out[todo.pop()]):
                        if root[k] == k and k != i and k > i:
                            root[k] = i
                            todo.append(int(k))
        has = links > 0
        return pd.DataFrame({"node": node[has], "links": links[has], "root": node[root[has]]})

    return run


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, label)``: the smallest node that each node is connected with."""
    both = stored(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    total = both.count()
    labels = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node")
    labels = stored(labels)
    count = labels.count()
    while count:
        seen = attach(both, labels.select(F.col("node").alias("b"), "n", "label"), ["b"], total, F.struct("a", "b")).groupBy("a").agg(F.min("label").alias("around"))
        lower = labels.join(seen, labels["node"] == seen["a"], "left").select("node", "n", F.col("label").alias("old"), F.least("label", "around").alias("label"))
        lower = stored(lower)
        weight = lower.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        target = weight.join(lower.select(F.col("node").alias("label"), F.col("label").alias("top")), "label")
        jumped = attach(lower.select("node", F.col("n").alias("degree"), "old", "label"), target, ["label"], count, F.col("node"))
        labels = stored(jumped.select("node", F.col("degree").alias("n"), "old", F.least("label", F.coalesce("top", "label")).alias("label")))
        if not labels.where("old <> label").limit(1).count():
            break
        labels = labels.drop("old")
    return nodes.select("node").join(labels.select("node", "label"), "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def jaccard_classes(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``(rid, doc_id, text_key, class_id, n_links, set_id, kept)`` per row of ``docs``."""
    bands, rows = choose_bands(threshold[0] / threshold[1], recall)
    sig = stored(signatures(docs, n, bands, rows))
    some = sig.where("set_key is not null")
    nodes = stored(some.groupBy("set_key").agg(F.min("rid").alias("node"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size")))
    members = sig.join(nodes.select("node"), sig["rid"] == F.col("node")).select("node", "doc_id", F.explode("bands").alias("band"))

    # candidates: nodes that share a band
    buckets = members.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("leader")).where("n > 1")
    n_nodes = nodes.count()
    met = stored(attach(members, buckets, ["band"], n_nodes * bands, F.struct("node", "band")).where("leader is not null").select("node", "doc_id", "band", "leader"))
    homes = met.groupBy("node").agg(F.min("leader").alias("hub"), F.first("doc_id").alias("doc_id"))
    for _ in range(HUB_STEPS):
        homes = stored(homes)
        above = homes.select(F.col("node").alias("hub"), F.col("hub").alias("top"))
        targets = homes.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).join(above, "hub")
        homes = attach(homes, targets, ["hub"], n_nodes, F.col("node")).select("node", "doc_id", F.coalesce("top", "hub").alias("hub"))
    homes = homes.join(nodes.select("node", "size", "set_key", F.col("n").alias("w")), "node")
    crowd = homes.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("volume"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("volume") / BLOCK_GRAMS))
    wanted = attach(homes, crowd, ["hub"], n_nodes, F.col("node")).withColumn("blocks", parts).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("blocks")))

    # their full sets
    texts_ = bare(docs, "doc_id", "text").join(wanted.select(F.col("doc_id").alias("_id")), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    full = gram_sets(texts_, n).groupBy("set_key").agg(F.min("grams").alias("grams"))
    sets = stored(wanted.join(full, "set_key").select("node", "w", "hub", "blk", "blocks", "grams"))

    # near their hub
    at_hub = sets.select("node", "hub", "blk", F.lit(False).alias("pivot"), "grams")
    hubs = sets.groupBy("hub").agg(F.max("blocks").alias("blocks")).join(sets.select(F.col("node").alias("hub"), "grams"), "hub")
    pivots = hubs.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("blk"), F.lit(True).alias("pivot"), "grams")
    near = at_hub.unionByName(pivots).groupBy("hub", "blk").applyInPandas(_near(threshold), "node long, near boolean")
    placed = stored(sets.drop("grams", "blocks").join(near, "node").withColumn("block", F.concat_ws(":", "hub", F.col("near").cast("int"), "blk")))

    # pairs of blocks that share a bucket
    spots = met.select("node", "band").join(placed.select("node", "block", "hub", "near"), "node").select("band", "block", "hub", "near").distinct()
    other = spots.select("band", *[F.col(c).alias(f"_{c}") for c in ("block", "hub", "near")])
    clique = (F.col("hub") == F.col("_hub")) & F.col("near") & F.col("_near")
    pairs = spots.join(other, (spots["band"] == other["band"]) & (F.col("block") <= F.col("_block")) & ~clique).select("block", "_block").distinct()
    alone = placed.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where("size = 1").select(F.col("block").alias("b1"))
    pairs = stored(pairs.join(alone, (F.col("block") == F.col("b1")) & (F.col("block") == F.col("_block")), "left_anti").withColumn("pair", F.concat_ws("|", "block", "_block")))
    sides = pairs.select("pair", F.lit(0).alias("side"), "block").union(pairs.where("block <> _block").select("pair", F.lit(1).alias("side"), F.col("_block").alias("block")))
    bodies = placed.select("node", "block", "w").join(sets.select("node", "grams"), "node")
    across = stored(sides.join(bodies, "block").select("pair", "side", "node", "w", "grams").groupBy("pair").applyInPandas(_pair_links(threshold), "node long, links long, root long"))

    # classes
    cliques = placed.where("near").groupBy("hub").agg(F.min("node").alias("first"), F.sum("w").alias("clique_w"), F.count(F.lit(1)).alias("n"))
    in_clique = stored(attach(placed.where("near").select("node", "hub", "w"), cliques, ["hub"], n_nodes, F.col("node")).select("node", "first", (F.col("clique_w") - F.col("w")).alias("links")))
    edges = in_clique.select(F.col("node").alias("a"), F.col("first").alias("b")).union(across.select(F.col("node").alias("a"), F.col("root").alias("b")))
    labels = components(nodes, edges)
    links = in_clique.select("node", "links").union(across.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    info = nodes.join(labels, "node").join(links, "node", "left").select("set_key", "n", "node", "label", F.coalesce("links", F.lit(0)).alias("links"))
    out = stored(attach(some.select("rid", "doc_id", "text_key", "set_key"), info, ["set_key"], some.count(), F.col("rid")).select("rid", "doc_id", "text_key", "n", "node", "label", "links"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))).alias("first")
    classes = out.groupBy("label").agg(first, F.count(F.lit(1)).alias("n"))
    sets_first = out.groupBy("node").agg(F.min("doc_id").alias("set_id"), F.count(F.lit(1)).alias("n"))
    total = out.count()
    out = attach(out.withColumnRenamed("n", "copies"), classes, ["label"], total, F.col("rid")).drop("n")
    out = attach(out, sets_first, ["node"], total, F.col("rid"))
    done = out.select("rid", "doc_id", "text_key", F.col("first.id").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), "set_id", (F.col("rid") == F.col("first.rid")).alias("kept"))
    bare_rows = sig.where("set_key is null").select("rid", "doc_id", "text_key", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("set_id"), F.lit(True).alias("kept"))
    return done.unionByName(bare_rows)


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class, all columns as they were."""
    table = stored(jaccard_classes(docs).select("doc_id", "text_key", "kept"))
    kept = table.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
    out = keyed.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_key") == F.col("_kept_key")), "left_semi")
    if table.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():  # rows repeated with their id
        out = out.dropDuplicates(["_id", "_key"])
    return out.select("row.*")
