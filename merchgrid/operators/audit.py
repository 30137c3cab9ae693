"""Content audit: gap flags, gap weights and priority per product."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.functions.common import add_all, labels, merged, ratio, strip, text
from merchgrid.rules import catalog as rules

MIN_DESCRIPTION = 100  # characters of plain text a complete description has

# Fixed value: range of every tunable weight.
WEIGHT_BOUNDS = {
    "gap_image": (0.0, 3.0), "gap_variant_images": (0.0, 3.0), "gap_description": (0.0, 3.0),
    "gap_type": (0.0, 2.0), "gap_tags": (0.0, 2.0), "session_scale": (10.0, 1000.0),
    "impression_scale": (100.0, 10000.0), "disapproval_boost": (0.0, 2.0),
}


@dataclass(frozen=True)
class Weights:
    """Priority weights; the defaults are the audit's own formula."""

    gap_image: float = 1.0
    gap_variant_images: float = 1.0
    gap_description: float = 1.0
    gap_type: float = 0.5
    gap_tags: float = 0.5
    session_scale: float = 100.0
    impression_scale: float = 1000.0
    disapproval_boost: float = 0.5
    inventory_transform: str = "linear"

    def clamped(self) -> Weights:
        vals = asdict(self)
        for name, (lo, hi) in WEIGHT_BOUNDS.items():
            vals[name] = min(max(vals[name], lo), hi)
        return Weights(**vals)

    def columns(self) -> dict[str, Column]:
        return {k: F.lit(v) for k, v in asdict(self).items()}


def active_products(products: DataFrame, vendor: str | None = None) -> DataFrame:
    """Active products outside the house vendors."""
    out = products.where(F.col("status") == "active")
    if vendor:
        out = out.where(F.col("vendor") == vendor)
    return out.where(~F.lower(text(F.col("vendor"))).isin([v.lower() for v in rules.HOUSE_VENDORS]))


def variant_stats(variants: DataFrame) -> DataFrame:
    """Counts, averages and the first variant's identifiers per product (A3)."""
    has_image = strip(text(F.col("image_src"))) != ""
    first = F.min_by(F.struct("barcode", "sku"), F.struct("position", "variant_id"))
    return variants.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("variant_count"),
        F.bool_or(has_image).alias("any_image"),
        F.avg(F.coalesce("price", F.lit(0.0))).alias("price"),
        F.avg(F.coalesce("cost", F.lit(0.0))).alias("cost"),
        first.alias("_first"),
    ).select("*", text(F.col("_first.barcode")).alias("barcode"), text(F.col("_first.sku")).alias("sku")).drop("_first")


def variant_rollup(variants: DataFrame) -> DataFrame:
    """Variant statistics and stock totals from rows that carry ``qty`` and ``on_sale``.

    Both come out of one aggregation, so the variants are shuffled once (A1, A3).
    """
    value = F.col("qty") * F.col("cost")
    has_image = strip(text(F.col("image_src"))) != ""
    first = F.min_by(F.struct("barcode", "sku"), F.struct("position", "variant_id"))
    return variants.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("variant_count"), F.bool_or(has_image).alias("any_image"), F.avg(F.coalesce("price", F.lit(0.0))).alias("price"),
        F.avg(F.coalesce("cost", F.lit(0.0))).alias("cost"), first.alias("_first"), F.sum("qty").alias("total"), F.sum(value).alias("value"),
        F.sum(F.when(~F.col("on_sale"), value).otherwise(F.lit(0.0))).alias("full_price_value"),
    ).select("*", text(F.col("_first.barcode")).alias("barcode"), text(F.col("_first.sku")).alias("sku")).drop("_first")


def gap_flags(products: DataFrame, stats: DataFrame, inventory: DataFrame | None = None) -> DataFrame:
    """Products with their five completeness flags, stock values and identifiers."""
    plain = F.length(strip(F.regexp_replace(text(F.col("body_html")), "<[^>]+>", "")))
    count = F.coalesce("variant_count", F.lit(0))
    any_image = F.coalesce("any_image", F.lit(False))
    # A variant counts as missing only when no variant of the product has an image.
    missing = F.when(any_image, F.lit(0)).otherwise(count)
    base = products.select(
        "product_id", "handle", "title", "vendor", "product_type",
        plain.alias("description_length"),
        (strip(text(F.col("product_type"))) != "").alias("has_product_type"),
        (strip(text(F.col("tags"))) != "").alias("has_tags"),
    )
    joined = base.join(merged(stats), "product_id", "left")
    if inventory is not None:
        joined = joined.join(merged(inventory.select("product_id", "total", "value", "full_price_value")), "product_id", "left")
    return (
        joined.select(
            "product_id", "handle", "title", "vendor", "product_type", "description_length", "has_product_type", "has_tags",
            any_image.alias("has_product_image"),
            (missing == 0).alias("has_all_variant_images"),
            (F.col("description_length") >= MIN_DESCRIPTION).alias("has_description"),
            count.alias("variant_count"),
            missing.alias("variants_missing_images"),
            text(F.col("barcode")).alias("barcode"),
            text(F.col("sku")).alias("sku"),
            F.coalesce("price", F.lit(0.0)).alias("price"),
            F.coalesce("cost", F.lit(0.0)).alias("cost"),
            F.coalesce("total", F.lit(0)).alias("total_inventory"),
            F.coalesce("value", F.lit(0.0)).alias("inventory_value"),
            F.coalesce("full_price_value", F.lit(0.0)).alias("full_price_inventory_value"),
        )
    )


def add_signals(scores: DataFrame, online: DataFrame, listing: DataFrame) -> DataFrame:
    """Left-join online signals by title and listing signals by product."""
    o = online.select(
        "title", F.col("sessions").alias("online_sessions"), F.col("conversion_rate").alias("online_conversion_rate"),
        "online_revenue", F.col("orders").alias("online_orders"), "opportunity_gap",
    )
    g = listing.select(
        "product_id", F.col("clicks").alias("listing_clicks"), F.col("impressions").alias("listing_impressions"),
        F.col("ctr").alias("listing_ctr"), F.col("disapproved").alias("listing_disapproved"),
        F.col("issues").alias("listing_issues"), "discovery_gap",
    )
    zero_int = ["online_sessions", "online_orders", "listing_clicks", "listing_impressions"]
    zero_dbl = ["online_conversion_rate", "online_revenue", "opportunity_gap", "listing_ctr", "discovery_gap"]
    out = scores.join(merged(o), "title", "left").join(merged(g), "product_id", "left")
    fill = {c: 0 for c in zero_int} | {c: 0.0 for c in zero_dbl} | {"listing_disapproved": False}
    return out.fillna(fill)


def gap_count(w: dict[str, Column]) -> Column:
    share = F.col("variants_missing_images") / F.greatest(F.col("variant_count"), F.lit(1)).cast("double")
    miss = lambda ok, weight: F.when(~F.col(ok), weight).otherwise(F.lit(0.0))
    return add_all(
        miss("has_product_image", w["gap_image"]),
        miss("has_all_variant_images", w["gap_variant_images"] * share),
        miss("has_description", w["gap_description"]),
        miss("has_product_type", w["gap_type"]),
        miss("has_tags", w["gap_tags"]),
    )


def gap_labels() -> Column:
    n, total, length = (F.col(c).cast("string") for c in ("variants_missing_images", "variant_count", "description_length"))
    no_desc = ~F.col("has_description")
    return labels(
        (~F.col("has_product_image"), "Missing product image"),
        (~F.col("has_all_variant_images"), F.concat(F.lit("Missing variant images ("), n, F.lit("/"), total, F.lit(")"))),
        (no_desc & (F.col("description_length") == 0), "Missing description"),
        (no_desc & (F.col("description_length") > 0), F.concat(F.lit("Short description ("), length, F.lit(" chars)"))),
        (~F.col("has_product_type"), "Missing product type"),
        (~F.col("has_tags"), "No tags"),
    )


def gap_suggestions() -> Column:
    return labels(
        (~F.col("has_product_image"), "Add at least one product-level image"),
        (~F.col("has_all_variant_images"), "Add images for each color variant"),
        (~F.col("has_description"), f"Add description (minimum {MIN_DESCRIPTION} characters)"),
        (~F.col("has_product_type"), "Set product type for better categorization"),
        (~F.col("has_tags"), "Add relevant tags for search and filtering"),
    )


def priority(w: dict[str, Column]) -> Column:
    """Priority under a weight vector given as literals or as joined columns (M2)."""
    inv = F.col("inventory_value")
    stock = (
        F.when(w["inventory_transform"] == "log", F.log1p(inv))
        .when(w["inventory_transform"] == "sqrt", F.sqrt(inv))
        .otherwise(inv)
    )
    full = F.col("full_price_inventory_value")
    multiplier = F.when((full > 0) & (inv > 0), 1.0 + ratio(full, inv)).otherwise(F.lit(1.0))

    def traffic(n: str, gap: str, scale: Column) -> Column:
        weight = F.log1p(F.col(n).cast("double")) / F.log1p(scale)
        return F.when(F.col(n) > 0, F.col(gap) * weight).otherwise(F.lit(0.0))

    boost = add_all(
        F.lit(1.0),
        traffic("online_sessions", "opportunity_gap", w["session_scale"]),
        traffic("listing_impressions", "discovery_gap", w["impression_scale"]),
        F.when(F.col("listing_disapproved"), w["disapproval_boost"]).otherwise(F.lit(0.0)),
    )
    gaps = gap_count(w)
    return F.when(gaps == 0, F.lit(0.0)).otherwise(stock * gaps * multiplier * boost)


def audit(products, variants, levels_rollup, online, listing, vendor: str | None = None, weights: Weights = Weights()) -> DataFrame:
    """The audit table: one row per active product with gaps and priority (M1).

    Without ``levels_rollup`` the stock figures come from the variant rows themselves.
    """
    stats = variant_stats(variants) if levels_rollup is not None else variant_rollup(variants)
    scores = gap_flags(active_products(products, vendor), stats, levels_rollup)
    w = weights.columns()
    return add_signals(scores, online, listing).select(
        "*",
        gap_count(w).alias("gap_count"),
        gap_labels().alias("gaps"),
        gap_suggestions().alias("suggestions"),
        priority(w).alias("priority_score"),
        completeness().alias("completeness_pct"),
    )


def completeness() -> Column:
    """Share of the five checks that hold, in percent."""
    flags = ["has_product_image", "has_all_variant_images", "has_description", "has_product_type", "has_tags"]
    return add_all(*[F.col(f).cast("int") for f in flags]) * F.lit(20.0)


def priority_items(scores: DataFrame, limit: int | None = None) -> DataFrame:
    """Products with gaps, best first; ``limit`` becomes TakeOrdered."""
    out = scores.where(F.col("gap_count") > 0).orderBy(F.desc("priority_score"), "product_id")
    return out.limit(limit) if limit else out


def audit_summary(scores: DataFrame) -> DataFrame:
    """One row of counts and the stock value behind gaps (A5)."""
    gap = F.col("gap_count") > 0
    n, k = F.count(F.lit(1)), F.count_if(gap)
    miss = lambda c: F.count_if(~F.col(c))
    return scores.agg(
        n.alias("total_products"), k.alias("products_with_gaps"), (n - k).alias("products_complete"),
        F.when(n > 0, ratio(n - k, n) * 100.0).otherwise(F.lit(100.0)).alias("completion_pct"),
        miss("has_product_image").alias("missing_images"),
        miss("has_all_variant_images").alias("missing_variant_images"),
        miss("has_description").alias("missing_description"),
        miss("has_product_type").alias("missing_product_type"),
        miss("has_tags").alias("missing_tags"),
        F.coalesce(F.sum(F.when(gap, F.col("inventory_value"))), F.lit(0.0)).alias("value_at_risk"),
    )


def vendor_completion(scores: DataFrame) -> DataFrame:
    """Products and complete products per vendor."""
    return scores.groupBy("vendor").agg(
        F.count(F.lit(1)).alias("products"), F.count_if(F.col("gap_count") == 0).alias("complete")
    )

