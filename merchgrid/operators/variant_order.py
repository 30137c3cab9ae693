"""Variant order check: colours in blocks, sizes in canonical order inside a block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchgrid.functions.common import lookup, merged, strip, text
from merchgrid.functions.ranking import distributed_rank
from merchgrid.session import written

# Fixed value: canonical rank of letter sizes.
SIZE_RANK = {
    "xxs": 0, "xs": 1, "s": 2, "sm": 2, "small": 2, "s/m": 3, "m": 4, "med": 4, "medium": 4, "m/l": 5, "l": 6, "lg": 6,
    "large": 6, "xl": 7, "xxl": 8, "2xl": 8, "xxxl": 9, "3xl": 9, "one size": -1, "os": -1,
}


def size_key(size: Column) -> Column:
    """Sort key (class, number, text): letter sizes, then numbers, then other text."""
    low = F.lower(strip(text(size)))
    rank, num = lookup(low, SIZE_RANK), low.try_cast("double")
    return F.struct(
        F.when(rank.isNotNull(), 0).when(num.isNotNull(), 1).otherwise(2).alias("cls"),
        F.coalesce(rank.cast("double"), num, F.lit(0.0)).alias("num"),
        F.when(rank.isNull() & num.isNull(), low).otherwise(F.lit("")).alias("txt"),
    )


def variant_label(v1: Column, v2: Column, v3: Column, sku: Column, vid: Column) -> Column:
    """'a / b / c' of the options, else the SKU, else the id (F32)."""
    blank = lambda c: F.nullif(text(c), F.lit(""))
    return F.coalesce(blank(F.concat_ws(" / ", blank(v1), blank(v2), blank(v3))), blank(sku), vid.cast("string"))


#: Variants of a product that one task orders; the places of larger products are found over many tasks.
LARGE = 1 << 16


def _counts() -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "placed": F.count("position"), "has_color": F.bool_or(F.lower(text(F.col("option1_name"))) == "color")}


def _facts(counted: DataFrame, *more: str) -> DataFrame:
    """Label, position, block and size of the variants of products with more than one."""
    v = counted.where("n > 1").withColumn(
        "label", variant_label(F.col("option1_value"), F.col("option2_value"), F.lit(""), F.col("sku"), F.col("variant_id"))
    )
    unknown = F.when(text(F.col("option1_value")) == "", "Unknown").otherwise(F.col("option1_value"))
    size = F.coalesce(F.nullif(text(F.col("option2_value")), F.lit("")), F.col("option1_value"))
    return v.select(
        "product_id", "variant_id", "label", "placed", F.coalesce("position", F.lit(0)).alias("pos"),
        F.when(F.col("has_color"), unknown).otherwise(F.lit("")).alias("block"),
        F.when(F.col("has_color"), size_key(size)).otherwise(size_key(F.col("label"))).alias("size"), *more,
    )


def _keyed(variants: DataFrame) -> DataFrame:
    stats = variants.groupBy("product_id").agg(*[c.alias(k) for k, c in _counts().items()])
    return _facts(variants.join(merged(stats), "product_id"))


def _steps(variants: DataFrame) -> DataFrame:
    """(block, size) spans of a product in the order expected, with the block's start; ``bad`` where the one before ends behind.

    Variants are first combined to (block, size) spans, so the windows see the few distinct
    combinations of a product and never its variants.
    """
    at = F.struct("pos", "variant_id")
    spans = _keyed(variants).groupBy("product_id", "block", "size").agg(
        F.min(at).alias("lo"), F.max(at).alias("hi"), F.max("placed").alias("placed")
    )
    w = Window.partitionBy("product_id").orderBy("start", "size")
    return spans.repartition("product_id").withColumn("start", F.min("lo").over(Window.partitionBy("product_id", "block"))).withColumn("bad", F.lag("hi").over(w) > F.col("lo"))


def _verdict() -> Column:
    return F.when(F.max("placed") == 0, "no_position_data").when(F.bool_or(F.coalesce("bad", F.lit(False))), "violation").otherwise("sorted")


def order_check(variants: DataFrame) -> DataFrame:
    """Verdict per product with more than one variant.

    The order is right exactly when every (block, size) ends before the next one begins.
    """
    return _steps(variants).groupBy("product_id").agg(_verdict().alias("verdict"))


def _places(variants: DataFrame) -> DataFrame:
    """``order_rows`` of products that one task holds: the variants are shuffled once, by product, and sorted there."""
    bare = (text(F.col("option1_value")) == "") & (text(F.col("option2_value")) == "")
    slim = variants.where("product_id is not null").select(
        "product_id", "variant_id", "position", F.when(F.lower(text(F.col("option1_name"))) == "color", "color").alias("option1_name"),
        "option1_value", "option2_value", F.when(bare, F.col("sku")).alias("sku"),
    )
    whole, at = Window.partitionBy("product_id"), F.struct("pos", "variant_id")
    seen = slim.withColumn("actual_place", F.row_number().over(whole.orderBy(F.coalesce("position", F.lit(0)), "variant_id")))
    v = _facts(seen.withColumns({k: c.over(whole) for k, c in _counts().items()}), "actual_place")
    v = v.where("placed > 0").withColumn("start", F.min(at).over(Window.partitionBy("product_id", "block")))
    # in the order expected each (block, size) is one run, sorted inside: only where one follows another can a variant come too early
    v = v.withColumn("bad", F.coalesce(F.lag(at).over(whole.orderBy("start", "size", "block", "pos", "variant_id")) > at, F.lit(False)))
    v = v.withColumn("violation", F.bool_or("bad").over(whole)).where("violation")
    expected = F.row_number().over(whole.orderBy("start", "size", "pos", "variant_id"))
    return v.select("product_id", "variant_id", "label", F.col("actual_place").cast("bigint").alias("actual_place"), expected.cast("bigint").alias("expected_place"))


def _far_places(variants: DataFrame) -> DataFrame:
    """The same for products of any size."""
    blocks = _steps(variants).groupBy("product_id").agg(_verdict().alias("verdict"), F.collect_set(F.struct("block", "start")).alias("blocks"))
    start = blocks.where("verdict = 'violation'").select("product_id", F.explode("blocks").alias("b")).select("product_id", "b.*")
    keyed = _keyed(variants).join(merged(start), ["product_id", "block"]).select("product_id", "variant_id", "label", "pos", "start", "size")
    actual = distributed_rank(keyed, ["product_id"], [F.col("pos"), F.col("variant_id")], "actual_place", written)
    both = distributed_rank(actual, ["product_id"], [F.col("start"), F.col("size"), F.col("pos"), F.col("variant_id")], "expected_place", written)
    return both.select("product_id", "variant_id", "label", "actual_place", "expected_place")


def order_rows(variants: DataFrame) -> DataFrame:
    """Actual and expected place of every variant of the violating products.

    Products with more than ``LARGE`` variants are ranked over many tasks; there is at most one for so many rows, so
    their ids go to every task.
    """
    large = written(variants.where("product_id is not null").groupBy("product_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("product_id"))
    if large.isEmpty():
        return _places(variants)
    few = F.broadcast(large)
    return _places(variants.join(few, "product_id", "left_anti")).unionByName(_far_places(variants.join(few, "product_id", "left_semi")))


def order_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("products"))
