"""Exact duplicates by deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of ``BLOCK`` characters.  The distinct blocks are sorted and
numbered; a text is then a row of integers.  Adjacent integers are named in pairs, the
distinct pairs again sorted and numbered, until one integer is left.  Two texts are equal
exactly when they need the same number of rounds and end with the same integer: a number
stands for one block or one pair and for no other, so there is no collision to fear.

Scale: block texts are shuffled once, and equal blocks are merged before that shuffle.  The
numbers find their way back over a 64-bit key of the block; keys that two different blocks
share are looked for, and if there is one the texts themselves are joined.  Only texts
of more than one block take part in the rounds.  Groups of any size are counted map-side and looked
up by ``attach``, so a group with a third of all rows meets no single task.

Defined results: null text counts as empty; empty texts are equal to each other; of equal
texts the row with the smallest doc_id stays (null ids last, then the first row met); a
repeated row is a copy like any other; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.llm.common import attach, bare, stored

#: Characters of a block.
BLOCK = 4096
#: What one space replaces; single spaces, which stay, are not matched.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def _blocks(norm: Column, block: int) -> Column:
    """The blocks of a text in one linear pass; an empty text has one empty block."""
    cut = F.regexp_extract_all(norm, F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    return F.when(norm == "", F.array(F.lit(""))).otherwise(cut)


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows (keys, n), sorted within their partitions and numbered once and for all."""
    return stored(distinct.sortWithinPartitions(*keys).select(*[c for c in keys if c != "block"], "n", F.monotonically_increasing_id().alias("name")))


def identities(docs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, int]:
    """``(rid, doc_id, text_sha256, rounds, name)`` per row; equal texts have equal ``(rounds, name)``."""
    docs = bare(docs, "doc_id", "text")
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    pieces = norm.select(F.explode(_blocks(F.col("norm"), block)).alias("block")).select(F.xxhash64("block").alias("h"), "block")
    distinct = pieces.groupBy("h", "block").agg(F.count(F.lit(1)).alias("n"))
    names = _named(distinct, ["h", "block"])
    clash = names.groupBy("h").count().where("count > 1").limit(1).count() > 0
    rows = norm.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.sha2("norm", 256).alias("sha"), _blocks(F.col("norm"), block).alias("b"))
    rows = rows.select("rid", "doc_id", "sha", F.size("b").alias("left"), F.posexplode("b").alias("pos", "block"))
    rows = rows.select("rid", F.when(F.col("pos") == 0, F.col("doc_id")).alias("doc_id"), F.when(F.col("pos") == 0, F.col("sha")).alias("sha"), "left", "pos", F.xxhash64("block").alias("h"), *(["block"] if clash else []))
    if clash:  # two blocks share a key: carry the texts
        names = stored(distinct.sortWithinPartitions("h", "block").select("h", "block", "n", F.monotonically_increasing_id().alias("name")))
    total = int(names.agg(F.sum("n")).first()[0] or 0)
    rows = stored(attach(rows, names, ["h", "block"] if clash else ["h"], total, F.struct("rid", "pos")).select("rid", "doc_id", "sha", "left", "pos", "name"))

    heads = rows.where("pos = 0").select("rid", "doc_id", "sha")
    most = rows.agg(F.max("left")).first()[0] or 1
    done = rows.where(F.col("left") == 1).select("rid", F.lit(0).alias("rounds"), "name")
    cur = rows.where(F.col("left") > 1).select("rid", "left", "pos", "name")
    level = 0
    while most > 1:
        level += 1
        most = (most + 1) // 2
        even = F.col("pos") % 2 == 0
        pairs = cur.groupBy("rid", F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(
            F.max(F.floor((F.col("left") + 1) / 2)).cast("int").alias("left"), F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = stored(pairs)
        names = _named(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), ["a", "b"])
        cur = attach(pairs, names, ["a", "b"], pairs.count(), F.struct("rid", "pos")).select("rid", "left", "pos", "name")
        cur = stored(cur)
        done = done.unionByName(cur.where(F.col("left") == 1).select("rid", F.lit(level).alias("rounds"), "name"))
        cur = cur.where(F.col("left") > 1)
    if level:
        return heads.join(done, "rid"), level
    return rows.where("pos = 0").select("rid", "doc_id", "sha", F.lit(0).alias("rounds"), "name"), 0


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` per row of ``docs``."""
    named = stored(identities(docs, block)[0])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("rid").alias("rid"))).alias("first")
    groups = named.groupBy("rounds", "name").agg(F.count(F.lit(1)).alias("n"), first)
    out = attach(named, groups, ["rounds", "name"], named.count(), F.col("rid"))
    return out.select("doc_id", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("rid") == F.col("first.rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were."""
    table = stored(exact_dedup(docs, block))
    kept = table.where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), F.sha2(normalised(F.col("text")), 256).alias("_sha"))
    out = keyed.join(kept, F.col("_id").eqNullSafe(F.col("_kept_id")) & (F.col("_sha") == F.col("_kept_sha")), "left_semi")
    if table.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count():  # rows repeated with their id
        out = out.dropDuplicates(["_id", "_sha"])
    return out.select("row.*")


ORACLE = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM t JOIN g USING (norm)
"""
