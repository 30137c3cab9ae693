"""Shipping audit: zero weights, weight mismatches and shipping cost against price."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.functions.common import half_up, lookup, ratio
from merchgrid.rules import catalog as rules

MARKUP = 1.20


def type_weight_grams(product_type: Column) -> Column:
    """Expected weight of the product type in whole grams, null when unknown."""
    grams = {t: int(lb * rules.LB_TO_GRAMS + 0.5) for t, lb in rules.TYPE_WEIGHT_LB.items()}
    return lookup(product_type, grams)


def carrier_cost(pounds: Column) -> Column:
    """Carrier rate of the first tier that holds the weight; the last rate beyond."""
    out = F.lit(float(rules.SHIPPING_TIERS[-1][1]))
    for limit, rate in reversed(rules.SHIPPING_TIERS):
        out = F.when(pounds <= limit, F.lit(float(rate))).otherwise(out)
    return F.when(pounds <= 0, F.lit(0.0)).otherwise(out)


def shipping_issues(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Issue rows: the first weight issue and the ratio of the first variant per product."""
    expected = F.col("expected_g")
    v = variants.join(products.select("product_id", type_weight_grams(F.col("product_type")).alias("expected_g")), "product_id")
    grams, price = F.coalesce("grams", F.lit(0.0)), F.coalesce("price", F.lit(0.0))
    share = ratio(grams, expected)
    kind = F.when(F.coalesce("requires_shipping", F.lit(True)), F.when(grams == 0, "zero_weight").when(
        expected.isNotNull() & (grams > 0) & ((share < 0.5) | (share > 2.0)), "weight_mismatch"))
    at = F.struct("position", "variant_id")
    first_bad = F.min_by(F.struct(kind.alias("kind"), grams.alias("grams"), price.alias("price")), F.when(kind.isNotNull(), at))
    per = v.groupBy("product_id").agg(
        first_bad.alias("bad"),
        F.min_by(F.struct(price.alias("price"), grams.alias("grams")), at).alias("rep"),
        F.count(F.lit(1)).alias("variant_count"),
        F.max(expected).alias("expected_g"),
    )
    info = products.select("product_id", "handle", "title", "vendor", "product_type").join(per, "product_id")
    ids = ["product_id", "handle", "title", "vendor", "product_type", "variant_count"]
    exp = F.coalesce("expected_g", F.lit(0)).cast("double")

    weight = info.where("bad.kind is not null").select(
        *ids,
        F.col("bad.kind").alias("issue_type"),
        F.when(F.col("bad.kind") == "zero_weight", "critical").otherwise("warning").alias("severity"),
        F.col("bad.grams").alias("weight_g"), exp.alias("expected_g"), F.col("bad.price").alias("price"),
        F.lit(0.0).alias("est_shipping"), F.lit(0.0).alias("shipping_pct"),
    )
    cost = carrier_cost(F.col("rep.grams") / F.lit(rules.LB_TO_GRAMS)) * MARKUP
    pct = ratio(cost, F.col("rep.price")) * 100.0
    costly = info.where((F.col("rep.price") > 0) & (F.col("rep.grams") > 0)).withColumn("est_shipping", cost).withColumn(
        "shipping_pct", pct
    ).where("shipping_pct > 25").select(
        *ids,
        F.lit("high_shipping_ratio").alias("issue_type"),
        F.when(F.col("shipping_pct") > 40, "warning").otherwise("info").alias("severity"),
        F.col("rep.grams").alias("weight_g"), F.lit(0.0).alias("expected_g"), F.col("rep.price").alias("price"),
        "est_shipping", "shipping_pct",
    )
    return weight.unionByName(costly).withColumn("details", issue_details())


def issue_details() -> Column:
    """Readable explanation of an issue row."""
    text = lambda c: F.format_string("%.0f", c)
    times = half_up(ratio(F.col("weight_g"), F.col("expected_g")), 1)
    return (
        F.when(F.col("issue_type") == "zero_weight", F.lit("Shippable variant has 0g weight - checkout shows wrong shipping rates"))
        .when(
            F.col("issue_type") == "weight_mismatch",
            F.concat(text(F.col("weight_g")), F.lit("g is "), times.cast("string"), F.lit("x the expected "), text(F.col("expected_g")),
                     F.when(times > 1, F.lit("g: undercharging shipping")).otherwise(F.lit("g: overcharging shipping"))),
        )
        .otherwise(F.concat(F.lit("Shipping $"), text(F.floor(F.col("est_shipping") + 0.5)), F.lit(" is "),
                            text(F.floor(F.col("shipping_pct") + 0.5)), F.lit("% of the price")))
    )


def ordered_issues(issues: DataFrame) -> DataFrame:
    """Critical first, then by shipping share."""
    rank = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return issues.orderBy(rank, F.desc("shipping_pct"), "product_id", "issue_type")
