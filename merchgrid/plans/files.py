"""Queries over the file readers and sinks: what a sink wrote is read back and compared as whole rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merchgrid.bind import Tables
from merchgrid.functions.common import half_up, text
from merchgrid.functions.urls import image_reject_reason, widest_source
from merchgrid.operators import images as I
from merchgrid.operators import matching as M
from merchgrid.operators import quality as Q
from merchgrid.operators import review as R
from merchgrid.operators import signals as G
from merchgrid.plans.core import _GAPS, _SUGG, scores
from merchgrid.plans.sql import r, with_tables
from merchgrid.session import scratch
from merchgrid.sources import readers, sinks


def _written(df: DataFrame) -> str:
    path = scratch(df.sparkSession)
    sinks.write_csv(df, path)
    return path


def export_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Import rows of whole texts as an export file with continuation rows, read in splits."""
    d = F.col("doc_id")
    images = F.transform(F.sequence(F.lit(1), F.greatest(d % 3, F.lit(1))), lambda k: F.struct(
        F.when(d % 3 > 0, F.concat(F.lit("https://i/"), d.cast("string"), F.lit("/"), k.cast("string"))).alias("src"), F.when(d % 3 > 0, k).alias("position"), F.lit('say "x", y').alias("alt")))
    rows = sinks.import_rows(Tables(spark, sf).raw("documents").select(F.concat(F.lit("doc-"), d.cast("string")).alias("handle"), F.col("text").alias("body_html"), images.alias("images")))
    own = F.when(F.col("Image Position").isin("", "1"), F.col("Handle")).otherwise("")
    path = _written(rows.repartition("Handle").sortWithinPartitions("Handle", "Image Position").withColumn("Handle", own))
    e = readers.read_export(spark, path)
    return e.select(F.col("Handle").alias("handle"), text(F.col("Body (HTML)")).alias("body"), text(F.col("Image Src")).alias("src"), text(F.col("Image Position")).alias("position"), text(F.col("Image Alt Text")).alias("alt"))


def _priority_file(spark, sf) -> str:
    return _written(sinks.priority_rows(scores(Tables(spark, sf))))


def input_round_trip(spark, sf):
    """The priority file as work input."""
    i = readers.read_input(spark, _priority_file(spark, sf))
    return i.select("handle", "vendor", "has_image", "has_variant_images", "has_description", "has_product_type", "has_tags", "gaps", "admin_link", "priority_score",
                    *[text(F.col(c)).alias(c) for c in ("suggestions", "title", "barcode", "sku")])


def input_vendors(spark, sf):
    return readers.vendor_counts(readers.read_input(spark, _priority_file(spark, sf)))


def payoff_rows(spark, sf):
    p = R.payoff_rows(spark.read.csv(_priority_file(spark, sf), header=True, multiLine=True, escape='"'))
    return p.select("handle", "vendor", text(F.col("title")).alias("title"), "priority", "has_image", "has_variant_images", "has_description", "has_product_type", "has_tags",
                    F.array_join("gaps", ", ").alias("gaps"), text(F.col("suggestions")).alias("suggestions"), text(F.col("sessions")).alias("sessions"))


def audit_file(spark, sf):
    """The audit file's cells as numbers and words again."""
    a = spark.read.csv(_written(sinks.audit_rows(scores(Tables(spark, sf)))), header=True, multiLine=True, escape='"')
    words = {"Product Handle": "handle", "Title": "title", "Vendor": "vendor", "Product Type": "product_type", "Has Image": "has_image", "Has Variant Images": "has_variant_images", "Has Description": "has_description", "Has Product Type": "has_product_type", "Has Tags": "has_tags", "Gaps": "gaps", "Suggestions": "suggestions"}
    counts = {"Variant Count": "variant_count", "Variants Missing Images": "missing", "Description Length": "description_length", "Total Inventory": "total_inventory"}
    sums = {"Gap Count": "gap_count", "Priority Score": "priority", "Completeness %": "completeness", "Inventory Value": "inventory_value", "Full Price Inventory Value": "full_price_value"}
    return a.select(*[text(F.col(f"`{c}`")).alias(n) for c, n in words.items()], *[F.col(f"`{c}`").cast("bigint").alias(n) for c, n in counts.items()], *[F.col(f"`{c}`").cast("double").alias(n) for c, n in sums.items()])


def assignment_file(spark, sf):
    v = Tables(spark, sf).variants()
    rows = v.select("sku", F.when(F.col("position") % 7 == 0, 0).otherwise(F.col("variant_id")).alias("variant_id"), F.col("product_id").cast("string").alias("handle"), F.col("option1_name").alias("option_name"),
                    F.col("option1_value").alias("option_value"), F.col("image_src").alias("image"), (F.col("product_id") % 101).alias("confidence"), F.when(F.col("image_src") == "", "NO_IMAGE").otherwise("").alias("warning"))
    a = spark.read.csv(_written(sinks.assignment_rows(rows)), header=True, multiLine=True, escape='"')
    return a.select(*[text(F.col(f"`{c}`")).alias(c.lower().replace(" ", "_")) for c in a.columns])


def decision_log(spark, sf):
    """Decisions of two runs as JSON lines, one run repeated; whole texts as catalog titles."""
    d, n = Tables(spark, sf).raw("documents"), F.col("doc_id")
    tried = F.transform(F.sequence(F.lit(0), n % 3), lambda k: F.struct(F.concat(F.lit("https://s/"), k.cast("string")).alias("url"), F.when(k == n % 3, "accepted").otherwise("rejected").alias("action"), (k * 1.5).alias("pre_scrape_confidence")))
    rows = d.select(F.concat(F.lit("doc-"), n.cast("string")).alias("handle"), F.coalesce("lang", F.lit("")).alias("vendor"), F.coalesce("text", F.lit("")).alias("catalog_title"), F.lit("enriched").alias("outcome"), tried.alias("candidates_tried"), (n % 2).alias("half"))
    path = scratch(spark)
    for run, half in (("a", 0), ("b", 1), ("a", 0)):
        sinks.append_decisions(rows.where(F.col("half") == half).drop("half"), path, run)
    got = readers.read_decisions(spark, path, strict=True)
    tries = F.transform("candidates_tried", lambda c: F.concat_ws(" ", c["url"], c["outcome"], c["resolver_confidence"].cast("string")))
    return got.select("handle", "vendor", "catalog_title", "outcome", F.array_join(tries, "; ").alias("tried"))


def snapshot_versions(spark, sf):
    """Two versions of a snapshot in one folder: the first lacks a column, the second has one that nobody asks for."""
    s = scores(Tables(spark, sf)).select("product_id", "vendor", half_up(F.col("priority_score"), 3).alias("priority_score"), F.col("total_inventory").cast("bigint").alias("total_inventory"), F.lit("raw").alias("variants_raw"))
    path = scratch(spark)
    readers.save_snapshot(s.where("product_id % 2 = 0").drop("total_inventory"), f"{path}/version=1")
    readers.save_snapshot(s.where("product_id % 2 = 1").withColumn("extra", F.lit(1)), f"{path}/version=2")
    schema = s.select("product_id", "vendor", "priority_score", "total_inventory").withColumn("note", F.lit(None).cast("string")).schema
    return readers.load_snapshot(spark, path, schema, {"total_inventory": -1, "note": "none"})


def appended_images(spark, sf):
    """Image lists at the end of whole texts without images."""
    d = Tables(spark, sf).raw("documents")
    urls = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("https://i/"), F.col("doc_id").cast("string")), F.lit("https://i/b")))
    return d.select("doc_id", readers.append_images(F.coalesce("text", F.lit("")), urls).alias("text"))


def landed_prices(spark, sf):
    """Positional report rows, numbers in report spelling, and prices of facts."""
    o = Tables(spark, sf).raw("orders")
    k = F.col("o_orderkey")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint")
    row = F.array(F.concat(F.lit("$"), F.format_number((cents / 100).cast("decimal(20,2)"), 2)), k.cast("string"), F.when(k % 5 == 0, "n/a").otherwise((k % 100).cast("string")))
    landed = o.select(k.alias("id"), row.alias("row"), F.when(k % 2 == 0, F.array(F.lit("price"), F.lit("id"), F.lit("share"))).otherwise(F.array(F.lit("price"), F.lit("id"))).alias("columns"))
    rows = readers.report_rows(landed, ["id", "price", "share"])
    specs = F.create_map(F.when(F.col("id").cast("bigint") % 3 == 0, "Color").otherwise("Price"), F.col("price"))
    return rows.select(F.col("id").cast("bigint").alias("id"), G.lenient_double(F.col("price")).alias("price"), G.lenient_int(text(F.col("share"))).alias("share"),
                       M.facts_price(specs, F.when(F.col("id").cast("bigint") % 6 == 0, F.lit("9.5"))).alias("fact"))


def image_checks(spark, sf):
    """Importable images and widest sources of the variants' images."""
    v = Tables(spark, sf).variants().where("image_src <> ''")
    k, bare = F.col("position"), F.substring_index("image_src", "?", 1)
    url = F.when(k % 5 == 1, F.concat(bare, F.lit(".svg?x=1"))).when(k % 5 == 2, F.concat(bare, F.lit("/Logo.png"))).when(k % 5 == 3, F.concat(F.lit("data:"), bare)).otherwise(F.col("image_src"))
    srcset = F.concat(bare, F.lit(" 300w, "), F.lit("https://w/"), k.cast("string"), F.lit(" "), (k % 7 * 100).cast("string"), F.lit("w, https://z"))
    return v.select("variant_id", text(image_reject_reason(url)).alias("reason"), widest_source(srcset).alias("widest"))


def bulk_export(spark, sf):
    """A bulk export applied to the variants' images and positions."""
    v = Tables(spark, sf).variants().select("variant_id", "product_id", "image_src", F.col("position").cast("int").alias("position"))
    p = F.col("position")
    e = v.where(p % 3 == 0).select(F.col("variant_id").cast("string").alias("variant_id"), F.col("product_id").cast("string").alias("product_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("ord"), p).select(
        "variant_id", "product_id", "ord", F.when(F.col("ord") == p % 2, F.concat(F.lit(" https://n/"), "variant_id", F.lit("/"), F.col("ord").cast("string"))).otherwise("").alias("image"), F.when(F.col("ord") == 0, (p + 5).cast("string")).alias("pos"))
    return I.apply_bulk_export(v, e).select("variant_id", "image_src", F.col("position").cast("bigint").alias("position"))


def bulk_export_totals(spark, sf):
    v = Tables(spark, sf).variants().select("variant_id", "product_id", "image_src", F.col("position").cast("int").alias("position"))
    e = v.select((F.col("variant_id") + F.when(F.col("position") % 4 == 0, 10**12).otherwise(0)).cast("string").alias("variant_id"), "product_id", F.when(F.col("position") % 2 == 0, "x").otherwise("").alias("image"), F.when(F.col("position") % 3 == 0, "1").alias("pos"), F.lit(0).alias("ord"))
    return I.bulk_export_counts(v, e)


def refusals(spark, sf):
    """Refusal phrases put before every third text."""
    d = Tables(spark, sf).raw("documents")
    body = F.concat(F.when(F.col("doc_id") % 3 == 0, "<p>I CANNOT generate a description</p>").otherwise(""), F.coalesce("text", F.lit("")))
    return d.select("doc_id", text(Q.refusal(body)).alias("phrase"))


QUERIES = {f.__name__: f for f in (
    export_round_trip, input_round_trip, input_vendors, payoff_rows, audit_file, assignment_file, decision_log, snapshot_versions, appended_images, landed_prices, image_checks, bulk_export, bulk_export_totals,
    refusals,
)}

#: The first refusal phrases, written out again so that a wrong one in the rules shows.
_REFUSALS = [
    "does not contain sufficient", "insufficient descriptive content", "not contain enough", "unable to create", "cannot generate", "no product information", "appears to be navigation",
]

_yes = lambda c: f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
_FLAGS = "has_product_image AS has_image, has_all_variant_images AS has_variant_images, has_description, has_product_type, has_tags"

ORACLES = {
    "refusals": f"""SELECT doc_id, coalesce(CASE {" ".join(f"WHEN contains(t, '{p}') THEN '{p}'" for p in _REFUSALS)} END, '') AS phrase
        FROM (SELECT doc_id, lower(CASE WHEN doc_id % 3 = 0 THEN '<p>I CANNOT generate a description</p>' ELSE '' END || coalesce(text, '')) AS t FROM documents)""",
    "export_round_trip": """SELECT 'doc-' || doc_id AS handle, CASE WHEN n = 1 THEN coalesce(text, '') ELSE '' END AS body, CASE WHEN doc_id % 3 > 0 THEN 'https://i/' || doc_id || '/' || n ELSE '' END AS src,
        CASE WHEN doc_id % 3 > 0 THEN n::VARCHAR ELSE '' END AS position, 'say "x", y' AS alt FROM (SELECT doc_id, text, unnest(range(1, greatest(doc_id % 3, 1) + 1)) AS n FROM documents)""",
    "input_round_trip": with_tables(f"""SELECT handle, vendor, {_FLAGS}, {_GAPS} AS gaps, 'https://admin.example.com/products/' || product_id AS admin_link, {r('priority_score', 2)} AS priority_score,
        {_SUGG} AS suggestions, title, coalesce(barcode, '') AS barcode, coalesce(sku, '') AS sku FROM audited WHERE gap_count > 0"""),
    "input_vendors": with_tables("SELECT vendor, count(*) AS rows FROM audited WHERE gap_count > 0 GROUP BY 1"),
    "payoff_rows": with_tables(f"""SELECT handle, vendor, title, {r('priority_score', 2)} AS priority, {_FLAGS}, {_GAPS} AS gaps, {_SUGG} AS suggestions,
        CASE WHEN online_sessions > 0 THEN online_sessions::VARCHAR ELSE '' END AS sessions FROM audited WHERE gap_count > 0"""),
    "audit_file": with_tables(f"""SELECT handle, title, vendor, product_type, {_yes('has_product_image')} AS has_image, {_yes('has_all_variant_images')} AS has_variant_images, {_yes('has_description')} AS has_description,
        {_yes('has_product_type')} AS has_product_type, {_yes('has_tags')} AS has_tags, {_GAPS} AS gaps, {_SUGG} AS suggestions, variant_count, variants_missing_images AS missing, description_length, total_inventory,
        {r('gap_count', 1)} AS gap_count, {r('priority_score', 2)} AS priority,
        {r('(has_product_image::INT + has_all_variant_images::INT + has_description::INT + has_product_type::INT + has_tags::INT) * 20.0', 1)} AS completeness, {r('inventory_value', 2)} AS inventory_value, {r('full_price_inventory_value', 2)} AS full_price_value FROM audited"""),
    "assignment_file": with_tables("""SELECT sku AS variant_sku, CASE WHEN position % 7 = 0 THEN '' ELSE variant_id::VARCHAR END AS variant_id, product_id::VARCHAR AS handle, option1_name AS option_name, option1_value AS option_value,
        image_src AS variant_image, (product_id % 101)::VARCHAR AS confidence, CASE WHEN image_src = '' THEN 'NO_IMAGE' ELSE '' END AS warning FROM variants"""),
    "decision_log": """SELECT 'doc-' || doc_id AS handle, coalesce(lang, '') AS vendor, coalesce(text, '') AS catalog_title, 'enriched' AS outcome,
        array_to_string(list_transform(range(0, doc_id % 3 + 1), lambda k: 'https://s/' || k || CASE WHEN k = doc_id % 3 THEN ' accept ' ELSE ' rejected ' END || (k * 1.5::DOUBLE)::VARCHAR), '; ') AS tried FROM documents""",
    "snapshot_versions": with_tables(f"""SELECT product_id, vendor, {r('priority_score', 3)} AS priority_score, CASE WHEN product_id % 2 = 0 THEN -1 ELSE total_inventory END AS total_inventory, 'none' AS note FROM audited"""),
    "appended_images": """SELECT doc_id, CASE WHEN doc_id % 4 = 0 OR regexp_matches(t, '!\\[.*?\\]\\(https?://[^)]+\\)') OR regexp_matches(t, '(?i)https?://\\S+\\.(?:jpg|jpeg|png|webp|avif)') THEN t
        ELSE t || chr(10) || chr(10) || '![](https://i/' || doc_id || ')' || chr(10) || '![](https://i/b)' END AS text FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "landed_prices": """SELECT id, p AS price, CASE WHEN id % 2 = 0 AND id % 5 <> 0 THEN id % 100 ELSE 0 END AS share, CASE WHEN id % 3 <> 0 THEN p WHEN id % 6 = 0 THEN 9.5::DOUBLE END AS fact
        FROM (SELECT o_orderkey AS id, (floor(o_totalprice * 100 + 0.5::DOUBLE)::BIGINT / 100)::DECIMAL(20, 2)::DOUBLE AS p FROM orders)""",
    "image_checks": with_tables("""SELECT variant_id, CASE WHEN position % 5 = 1 THEN 'unsupported format' WHEN position % 5 = 2 THEN 'likely icon/badge' WHEN position % 5 = 3 THEN 'data URI' ELSE '' END AS reason,
        CASE WHEN position % 7 * 100 > 300 THEN 'https://w/' || position ELSE split_part(image_src, '?', 1) END AS widest FROM variants WHERE image_src <> ''"""),
    "bulk_export": with_tables("""SELECT variant_id, CASE WHEN position % 3 = 0 THEN 'https://n/' || variant_id || '/' || (position % 2) ELSE image_src END AS image_src,
        CASE WHEN position % 3 = 0 THEN position + 5 ELSE position END AS position FROM variants"""),
    "bulk_export_totals": with_tables("""SELECT count(*) FILTER (position % 4 <> 0 AND (position % 2 = 0 OR position % 3 = 0)) AS variants_updated, count(*) FILTER (position % 4 = 0) AS variants_skipped,
        count(*) FILTER (position % 4 <> 0 AND position % 2 = 0) AS images_set, count(*) FILTER (position % 4 <> 0 AND position % 3 = 0) AS positions_set,
        count(DISTINCT CASE WHEN position % 4 <> 0 THEN product_id END) AS products_seen FROM variants"""),
}
