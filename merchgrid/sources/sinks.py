"""CSV, JSON and parquet sinks. Sorted outputs keep their order across part files; nothing is coalesced to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.functions.common import half_up, strip, text
from merchgrid.operators.ranking import notes

# Fixed value: column order of a product-import CSV.
IMPORT_COLUMNS = [
    "Handle", "Title", "Body (HTML)", "Vendor", "Type", "Tags", "Published", "Option1 Name", "Option1 Value", "Option2 Name", "Option2 Value",
    "Option3 Name", "Option3 Value", "Variant SKU", "Variant Grams", "Variant Inventory Tracker", "Variant Inventory Qty", "Variant Inventory Policy",
    "Variant Fulfillment Service", "Variant Price", "Variant Compare At Price", "Variant Requires Shipping", "Variant Taxable", "Variant Barcode",
    "Image Src", "Image Position", "Image Alt Text", "Gift Card", "SEO Title", "SEO Description", "Variant Image", "Variant Weight Unit",
]
#: Rows of a CSV file; a task that writes more goes on with the next file.
FILE_ROWS = 200_000
ADMIN_LINK = "https://admin.example.com/products/"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files of at most ``FILE_ROWS`` rows: quoted fields may hold line breaks, so a plain reader takes a file as a whole."""
    df.write.mode("overwrite").option("maxRecordsPerFile", FILE_ROWS).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def blank_unless(cond: Column, value: Column) -> Column:
    return F.when(cond, value.cast("string")).otherwise(F.lit(""))


def yes(c: str) -> Column:
    return F.when(F.col(c), "True").otherwise("False")


def percent(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def dollars(c: Column) -> Column:
    return F.format_string("$%.2f", c)


def priority_rows(scores: DataFrame) -> DataFrame:
    """Priority CSV rows, best first (K1)."""
    seen, shown = F.col("online_sessions") > 0, F.col("listing_impressions") > 0
    s = scores.where("gap_count > 0").orderBy(F.desc("priority_score"), "product_id")
    return s.select(
        F.col("handle").alias("Product Handle"), F.col("vendor").alias("Vendor"), F.col("title").alias("Title"), F.col("barcode").alias("Barcode"), F.col("sku").alias("SKU"),
        yes("has_product_image").alias("Has Image"), yes("has_all_variant_images").alias("Has Variant Images"), yes("has_description").alias("Has Description"),
        yes("has_product_type").alias("Has Product Type"), yes("has_tags").alias("Has Tags"), F.array_join("gaps", ", ").alias("Gaps"), F.array_join("suggestions", "; ").alias("Suggestions"),
        half_up(F.col("priority_score"), 2).alias("Priority Score"), blank_unless(seen, F.col("online_sessions")).alias("Sessions"),
        blank_unless(seen, percent(F.col("online_conversion_rate"))).alias("Conversion Rate"), blank_unless(F.col("online_revenue") != 0, dollars(F.col("online_revenue"))).alias("Online Revenue"),
        blank_unless(seen, half_up(F.col("opportunity_gap"), 3)).alias("Opportunity Gap"), blank_unless(F.col("listing_clicks") > 0, F.col("listing_clicks")).alias("Listing Clicks"),
        blank_unless(shown, F.col("listing_impressions")).alias("Listing Impressions"), blank_unless(shown, percent(F.col("listing_ctr"))).alias("Listing CTR"),
        F.when(F.col("listing_disapproved"), "Yes").otherwise("").alias("Listing Disapproved"), blank_unless(shown, half_up(F.col("discovery_gap"), 3)).alias("Discovery Gap"),
        F.concat(F.lit(ADMIN_LINK), F.col("product_id").cast("string")).alias("Admin Link"))


def audit_rows(scores: DataFrame) -> DataFrame:
    """Full audit CSV rows (K2)."""
    return scores.select(
        F.col("handle").alias("Product Handle"), F.col("title").alias("Title"), F.col("vendor").alias("Vendor"), F.col("product_type").alias("Product Type"),
        yes("has_product_image").alias("Has Image"), yes("has_all_variant_images").alias("Has Variant Images"), yes("has_description").alias("Has Description"),
        yes("has_product_type").alias("Has Product Type"), yes("has_tags").alias("Has Tags"), F.col("variant_count").alias("Variant Count"),
        F.col("variants_missing_images").alias("Variants Missing Images"), F.col("description_length").alias("Description Length"), half_up(F.col("gap_count"), 1).alias("Gap Count"),
        half_up(F.col("priority_score"), 2).alias("Priority Score"), half_up(F.col("completeness_pct"), 1).alias("Completeness %"), F.col("total_inventory").alias("Total Inventory"),
        half_up(F.col("inventory_value"), 2).alias("Inventory Value"), half_up(F.col("full_price_inventory_value"), 2).alias("Full Price Inventory Value"),
        F.array_join("gaps", ", ").alias("Gaps"), F.array_join("suggestions", "; ").alias("Suggestions"))


def shipping_rows(issues: DataFrame) -> DataFrame:
    """Shipping CSV rows (K3); order them with ``ordered_issues``."""
    some = lambda c, v: blank_unless(F.col(c) != 0, v)
    return issues.select(
        F.col("handle").alias("Handle"), F.col("title").alias("Title"), F.col("vendor").alias("Vendor"), F.col("product_type").alias("Product Type"), F.col("issue_type").alias("Issue Type"),
        F.col("severity").alias("Severity"), F.col("details").alias("Details"), some("weight_g", F.col("weight_g")).alias("Weight (g)"), some("expected_g", F.col("expected_g")).alias("Estimated Weight (g)"),
        some("price", dollars(F.col("price"))).alias("Price"), some("est_shipping", dollars(F.col("est_shipping"))).alias("Est. Shipping"),
        some("shipping_pct", F.format_string("%.0f%%", F.col("shipping_pct"))).alias("Shipping/Price %"))


def ranking_rows(ranked: DataFrame, top: int | None = None) -> DataFrame:
    """Ranking rows with notes (K4); ``top`` gives the short list."""
    out = ranked.orderBy("collection", "rank", "product_id").select("collection", "rank", "handle", "title", "weekly_units", "margin_pct", "total_inventory", "total_score", notes().alias("notes"))
    return out.where(F.col("rank") <= top) if top else out


def import_rows(outputs: DataFrame, include_body: bool = True, include_images: bool = True) -> DataFrame:
    """Product-import rows (K5): the primary row with the first image, then one row per further image.

    ``outputs(handle, body_html, images array<struct<src, position, alt>>)``.
    """
    images = F.col("images") if include_images else F.filter("images", lambda i: F.lit(False))
    rows = outputs.select("handle", "body_html", F.posexplode_outer(images).alias("n", "i"))
    n = F.coalesce("n", F.lit(0))
    body = F.when((n == 0) & F.lit(include_body), text(F.col("body_html"))).otherwise("")
    filled = {"Handle": F.col("handle"), "Body (HTML)": body, "Image Src": text(F.col("i.src")), "Image Position": text(F.col("i.position").cast("string")), "Image Alt Text": text(F.col("i.alt"))}
    return rows.select(n.alias("_n"), *[filled.get(c, F.lit("")).alias(c) for c in IMPORT_COLUMNS]).orderBy("Handle", "_n").drop("_n")


def assignment_rows(expanded: DataFrame) -> DataFrame:
    """Variant-image-assignment rows (K6)."""
    return expanded.select(
        F.col("sku").alias("Variant SKU"), blank_unless(F.col("variant_id") != 0, F.col("variant_id")).alias("Variant ID"), F.col("handle").alias("Handle"),
        F.col("option_name").alias("Option Name"), F.col("option_value").alias("Option Value"), F.col("image").alias("Variant Image"),
        F.col("confidence").alias("Confidence"), F.col("warning").alias("Warning"))


def bulk_image_rows(marked: DataFrame) -> DataFrame:
    """Bulk-edit image rows from ``merge_marker`` (K7)."""
    return marked.orderBy("product_id", "ord").select(
        F.col("product_id").alias("ID"), F.col("handle").alias("Handle"), F.col("command").alias("Command"), F.col("variant_id").alias("Variant ID"),
        F.lit("MERGE").alias("Variant Command"), F.col("image_url").alias("Variant Image"))


def bulk_description_rows(backfill: DataFrame) -> DataFrame:
    return backfill.select(F.col("product_id").alias("ID"), F.col("handle").alias("Handle"), F.lit("MERGE").alias("Command"), F.col("description").alias("Body HTML"))


def bulky_rows(bulky: DataFrame) -> DataFrame:
    """Bulky-item rows, dearest first (K9)."""
    return bulky.orderBy(F.desc("price"), "variant_id").select("handle", "title", "vendor", "product_type", F.col("sku").alias("variant_sku"), F.col("suggested_g").alias("suggested_weight_g"), "price")


def replace_queue(queue: DataFrame, path: str) -> None:
    """Replace this source's rows of the update queue, others stay."""
    queue.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def append_decisions(decisions: DataFrame, path: str, run_id: str) -> None:
    """Decision records of a run as JSON lines (K12); a repeated run replaces its own records only."""
    write_run_json(decisions.withColumn("run_id", F.lit(run_id)), path)


def write_run_json(df: DataFrame, path: str, run_column: str = "run_id") -> None:
    """Feedback, manifests, scores and artifacts by run (K13): the partitions of the runs in ``df`` are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run_column).json(path)


def run_report(results: DataFrame) -> DataFrame:
    """Run-report rows (K6)."""
    return results.select(
        F.col("handle").alias("Product Handle"), F.col("vendor").alias("Vendor"), F.col("status").alias("Status"), F.col("confidence").alias("Confidence"),
        F.array_join("warnings", "; ").alias("Warnings"), strip(text(F.col("source_url"))).alias("Source URL"))
