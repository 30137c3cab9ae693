"""Traffic signals: landing sessions, online sales, listing performance and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.functions.common import merged, ratio, strip


def opportunity_gap(sessions: Column, conversion: Column) -> Column:
    """Many sessions with few purchases, 0..1."""
    return F.when(sessions == 0, F.lit(0.0)).otherwise((1.0 - conversion) * F.least(sessions / F.lit(100.0), F.lit(1.0)))


def discovery_gap(impressions: Column, ctr: Column) -> Column:
    return F.when(impressions == 0, F.lit(0.0)).otherwise((1.0 - ctr) * F.least(impressions / F.lit(1000.0), F.lit(1.0)))


def lenient_double(c: Column) -> Column:
    """Number from report text: ``$``, ``,`` and ``%`` dropped, anything unreadable is 0."""
    return F.coalesce(strip(F.regexp_replace(c, "[$,%]", "")).try_cast("double"), F.lit(0.0))


def lenient_int(c: Column) -> Column:
    return lenient_double(c).cast("bigint")


def handle_from_path(path: Column) -> Column:
    """Product handle of a landing path; '' for other pages."""
    return F.regexp_replace(F.regexp_extract(path, r"^/products/([^?#]*)", 1), "^/+|/+$", "")


def sessions_by_handle(paths: DataFrame) -> DataFrame:
    """One row per handle; of several paths with one handle the last (by path) wins."""
    return (
        paths.withColumn("handle", handle_from_path(F.col("path")))
        .where(F.col("handle") != "")
        .groupBy("handle")
        .agg(F.max_by(F.struct("sessions", "conversion_rate"), "path").alias("s"))
        .select("handle", "s.sessions", "s.conversion_rate")
    )


def merge_online_signals(paths: DataFrame, sales: DataFrame, products: DataFrame) -> DataFrame:
    """Sales by title full-outer sessions by handle through the title/handle map.

    A title that names several products maps to the last of them, so sessions of the
    other handles find no title and drop out, as sessions without a product do.
    """
    title_handle = products.groupBy("title").agg(F.max_by("handle", "product_id").alias("handle"))
    sess = sessions_by_handle(paths).join(merged(title_handle.where("title <> ''")), "handle").drop("handle")
    rows = sales.join(sess, "title", "full_outer").select(
        "title",
        F.coalesce("sessions", F.lit(0)).alias("sessions"),
        F.coalesce("conversion_rate", F.lit(0.0)).alias("conversion_rate"),
        F.coalesce("total_sales", F.lit(0.0)).alias("online_revenue"),
        F.coalesce("orders", F.lit(0)).alias("orders"),
        F.coalesce("quantity_ordered", F.lit(0)).alias("quantity_ordered"),
    )
    return rows.withColumn("opportunity_gap", opportunity_gap(F.col("sessions"), F.col("conversion_rate")))


def listing_performance(daily: DataFrame) -> DataFrame:
    """Per-offer totals over the dates of the report."""
    return daily.where(F.coalesce("offer_id", F.lit("")) != "").groupBy("offer_id").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")
    )


def listing_issue_list(items: Column) -> Column:
    """One resolution per reporting context that has disapproved countries."""
    return F.flatten(
        F.transform(
            items,
            lambda i: F.transform(F.filter(i["contexts"], lambda c: F.size(c["countries"]) > 0), lambda c: i["resolution"]),
        )
    )


def listing_status(landed: DataFrame) -> DataFrame:
    """Latest landed status per offer with the disapproval flag and its issues."""
    last = landed.groupBy("offer_id").agg(F.max_by(F.struct("status", "item_issues"), "ord").alias("s"))
    return last.select(
        "offer_id",
        F.upper(F.coalesce("s.status", F.lit(""))).contains("DISAPPROVED").alias("disapproved"),
        listing_issue_list(F.col("s.item_issues")).alias("issues"),
    )


def merge_listing(perf: DataFrame, status: DataFrame) -> DataFrame:
    """Performance full-outer status; the status side decides disapproval and issues."""
    return perf.join(status, "offer_id", "full_outer").select(
        "offer_id",
        F.coalesce("clicks", F.lit(0)).alias("clicks"),
        F.coalesce("impressions", F.lit(0)).alias("impressions"),
        F.coalesce("disapproved", F.lit(False)).alias("disapproved"),
        F.coalesce("issues", F.array().cast("array<string>")).alias("issues"),
    )


def resolve_offers(listing: DataFrame, variants: DataFrame) -> DataFrame:
    """Offer id to product id: three parts name a variant, four or more name the product."""
    parts = F.split("offer_id", "_")
    tagged = listing.withColumn("_n", F.size(parts)).withColumn("_key", F.get(parts, F.lit(2)).try_cast("bigint")).where(
        (F.lower(F.get(parts, F.lit(0))) == "shopify") & (F.col("_n") >= 3) & F.col("_key").isNotNull()
    )
    by_variant = tagged.where("_n = 3").join(
        merged(variants.select(F.col("variant_id").alias("_key"), "product_id")), "_key"
    )
    by_product = tagged.where("_n >= 4").withColumn("product_id", F.col("_key"))
    return by_variant.unionByName(by_product).drop("_n", "_key")


def listing_by_product(listing: DataFrame, variants: DataFrame) -> DataFrame:
    """Listing signals per product.

    Issues stay whole as (issue, count) pairs: the count is aggregated before the
    list is built, so a product with very many offers still yields a short list.
    """
    offers = resolve_offers(listing, variants)
    totals = offers.groupBy("product_id").agg(
        F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.bool_or("disapproved").alias("disapproved")
    )
    issues = (
        offers.select("product_id", F.explode("issues").alias("issue"))
        .groupBy("product_id", "issue").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("issue", "n"))).alias("issues"))
    )
    ctr = ratio(F.col("clicks"), F.col("impressions"))
    return (
        totals.join(merged(issues), "product_id", "left")
        .withColumn("ctr", ctr)
        .withColumn("discovery_gap", discovery_gap(F.col("impressions"), F.col("ctr")))
    )


def report_value(row: Column, columns: Column, name: str) -> Column:
    """Positional report cell by column name; null when the column is absent."""
    return F.get(row, F.array_position(columns, name).cast("int") - 1)


