"""Exact set-similarity blocking of the title join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def set_id(words: Column) -> Column:
    """Digest that stands for a sorted word set, so joins carry 64 letters and not the words."""
    return F.sha2(F.array_join(words, " "), 256)


def token_frequency(sets: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Number of sets of a block that hold a token."""
    return sets.select(*keys, F.explode(col).alias("w")).groupBy(*keys, "w").agg(F.count(F.lit(1)).alias("df"))


def prefixes(sets: DataFrame, keys: list[str], sid: str, col: str, threshold: float, freq: DataFrame) -> DataFrame:
    """Rarest tokens of every set that an exact threshold join has to look at.

    Two sets with Jaccard > t share more than ``t * |set|`` tokens of either side.  In
    one global token order they therefore meet in the first ``|set| - floor(t * |set|)``
    tokens of both, and frequent tokens stay out of the join.  No pair is lost.
    Returns ``(keys, sid, size, w, pos)``, ``pos`` being the token's place in that order.
    """
    toks = sets.select(*keys, sid, F.explode(col).alias("w")).join(freq, [*keys, "w"], "left")
    ordered = toks.groupBy(*keys, sid).agg(F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w"))).alias("o"))
    size = F.size("o")
    keep = size - F.floor(F.lit(threshold) * size).cast("int")
    return ordered.select(*keys, sid, size.alias("size"), F.posexplode(F.slice("o", F.lit(1), keep)).alias("pos", "p")).select(*keys, sid, "size", F.col("p.w").alias("w"), "pos")


def blocked(left: DataFrame, right: DataFrame, keys: list[str], lid: str, rid: str, block: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with columns ``bl, br``: a key with many rows is cut into blocks of about ``block`` rows a side.

    A left row of such a key goes to every block of the right side and a right row to every block of the left, so
    each pair of rows meets once and no (key, bl, br) has more than two blocks' rows.
    Only keys with more than ``block`` rows on a side are looked up.
    """
    n = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("nl")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("nr")), keys)
    parts = lambda c: F.ceil(F.col(c) / block).cast("int")
    hot = n.where((F.col("nl") > block) | (F.col("nr") > block)).select(*[F.col(k).alias(f"_{k}") for k in keys], parts("nl").alias("_l"), parts("nr").alias("_r"))

    def side(rows: DataFrame, sid: str, own: str, other: str, names: tuple[str, str]) -> DataFrame:
        met = rows.join(hot, [F.col(k) == F.col(f"_{k}") for k in keys], "left")
        mine = F.when(F.col(own).isNull(), 0).otherwise(F.pmod(F.xxhash64(sid), F.coalesce(own, F.lit(1))).cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return met.withColumn(names[0], mine).withColumn(names[1], every).select(*rows.columns, "bl", "br")

    return side(left, lid, "_l", "_r", ("bl", "br")), side(right, rid, "_r", "_l", ("br", "bl"))
