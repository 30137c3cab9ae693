"""File sources: work CSVs, product exports, logs, artifacts and landed responses."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merchgrid.functions.common import strip, text
from merchgrid.functions.urls import drop_resize_params
from merchgrid.operators.signals import report_value

TRUE_WORDS = ["true", "yes", "1", "y", "t"]
INPUT_COLUMNS = {
    "Product Handle": "handle", "Vendor": "vendor", "Has Image": "has_image", "Has Variant Images": "has_variant_images", "Has Description": "has_description",
    "Has Product Type": "has_product_type", "Has Tags": "has_tags", "Gaps": "gaps", "Admin Link": "admin_link", "Priority Score": "priority_score",
    "Suggestions": "suggestions", "Title": "title", "Barcode": "barcode", "SKU": "sku",
}
REQUIRED_INPUT = ["Product Handle", "Vendor", "Has Image", "Has Variant Images", "Has Description"]


def parse_bool(c: Column) -> Column:
    """Messy CSV boolean."""
    return F.lower(strip(text(c))).isin(TRUE_WORDS)


def read_input(spark: SparkSession, path: str, rejected: bool = False) -> DataFrame:
    """Work CSV by header names (S7). Rows without a handle or vendor, or with an unreadable score, are left out; ``rejected`` returns those instead."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    missing = [c for c in REQUIRED_INPUT if c not in raw.columns]
    if missing:
        raise ValueError(f"input lacks columns {missing}")
    col = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
    score = col("Priority Score")
    ok = col("Product Handle").isNotNull() & col("Vendor").isNotNull() & (score.isNull() | score.try_cast("double").isNotNull())
    out = []
    for src, name in INPUT_COLUMNS.items():
        if name in ("has_product_type", "has_tags") and src not in raw.columns:
            out.append(F.lit(True).alias(name))
        elif name.startswith("has_"):
            out.append(parse_bool(col(src)).alias(name))
        elif name == "priority_score":
            out.append(score.try_cast("double").alias(name))
        else:
            out.append((text(col(src)) if name == "gaps" else col(src)).alias(name))
    return raw.where(~F.coalesce(ok, F.lit(False)) if rejected else ok).select(*out)


def vendor_counts(rows: DataFrame) -> DataFrame:
    """Rows per vendor."""
    return rows.groupBy("vendor").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "vendor")


PLACE = ["_file", "_block", "_pos"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their place: file, start of the split, number within it."""
    raw = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    return raw.withColumn("_pos", F.monotonically_increasing_id())


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of quoted CSV files whose fields may hold line breaks; a file is read in as many tasks as it has splits.

    Every split counts its quotes; the sums of the earlier splits tell whether one begins inside a
    quoted field.  A line that begins outside starts a record, every other one continues the last
    record started, be it in an earlier split.  Only records of several lines are put together by a shuffle.
    Returns ``(record, _file, _block, _pos, _head)`` with the place of the first line; ``_head`` marks each file's first record.
    """
    split = ["_file", "_block"]
    lines = _lines(spark, path).withColumn("_quotes", F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit(""))))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    begun = lines.groupBy(*split).agg(F.sum("_quotes").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    within = Window.partitionBy(*split).orderBy("_pos")
    upto = within.rowsBetween(Window.unboundedPreceding, -1)
    opened = lines.join(begun, split).withColumn("_starts", (F.col("_before") + F.coalesce(F.sum("_quotes").over(upto), F.lit(0))) % 2 == 0).drop("_before", "_quotes")
    first = F.when(F.col("_starts"), F.struct("_block", "_pos"))
    opened = opened.withColumn("_of", F.last(first, ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)))
    last = opened.groupBy(*split).agg(F.max(first).alias("_end")).withColumn("_carry", F.last("_end", ignorenulls=True).over(earlier)).drop("_end")
    placed = opened.join(last, split).withColumn("_of", F.coalesce("_of", "_carry"))
    alone = F.col("_starts") & F.coalesce(F.lead("_starts").over(within), F.lit(False))
    head = (F.col("_block") == 0) & (F.row_number().over(within) == 1)
    placed = placed.withColumns({"_alone": alone, "_head": head}).select("value", *PLACE, "_of", "_alone", "_head")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("_block", "_pos", "value"))), lambda x: x["value"])
    several = placed.where("not _alone").groupBy("_file", "_of").agg(F.array_join(parts, "\n").alias("record"), F.bool_or("_head").alias("_head")).select("record", "_file", "_of._block", "_of._pos", "_head")
    records = placed.where("_alone").select(F.col("value").alias("record"), *PLACE, "_head").unionByName(several)
    return records.withColumn("record", F.regexp_replace("record", "\r$", ""))


def read_export(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Product export whose continuation rows inherit the handle above.

    Row order is (file, split start, position in split).  The fill runs inside a split;
    the last handle of the earlier splits is carried over through the small table of
    splits.  With ``multi_line`` fields may hold line breaks; the header is one line.
    """
    if multi_line:
        names = spark.read.csv(path, header=True, escape='"').columns
        schema = ", ".join(f"`{n}` string" for n in names)
        found = quoted_records(spark, path).where("not _head and record <> ''")
        raw = found.select(F.from_csv("record", F.lit(schema), {"escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("r"), *PLACE).select("r.*", *PLACE)
    else:
        raw = spark.read.csv(path, header=True, escape='"').select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        raw = raw.withColumn("_pos", F.monotonically_increasing_id())
    raw = raw.withColumn("_own", F.nullif(strip(text(F.col("Handle"))), F.lit("")))
    inside = Window.partitionBy("_file", "_block").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    filled = raw.withColumn("_here", F.last("_own", ignorenulls=True).over(inside))
    ends = raw.groupBy("_file", "_block").agg(F.max_by("_own", F.when(F.col("_own").isNotNull(), F.col("_pos"))).alias("_end"))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).drop("_end")
    out = filled.join(carried, ["_file", "_block"]).withColumn("Handle", F.coalesce("_here", "_carry"))
    return out.where("Handle is not null").withColumn("row_order", F.struct(*PLACE)).drop(*PLACE, "_own", "_here", "_carry")


SIGNALS = "struct<title_similarity double, price_ratio double, color_overlap double, content_quality double>"
DECISION_SCHEMA = (
    "handle string, vendor string, catalog_title string, catalog_price double, catalog_colors array<string>, timestamp timestamp, outcome string, "
    "final_url string, retries int, type_words array<string>, candidates_tried array<struct<url string, outcome string, reason string, stage string, action string, "
    "title_extracted string, resolver_confidence double, pre_scrape_confidence double, post_scrape_confidence double, confidence double, post_confidence double, "
    f"title_similarity double, word_overlap double, rescore_reasoning string, penalties map<string,double>, signals {SIGNALS}>>, "
    "resolver_candidates array<struct<url string, title string, snippet string, reasoning string, confidence int>>"
)


def read_decisions(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Decision log (S11) as analysis input: malformed lines are left out (``rejected_lines`` returns them), or fail when ``strict``.

    The id of a decision is its handle, time and a digest of the whole record, so two records
    of one handle differ unless they are the same.  Both candidate shapes are folded into one, accepted is spelt ``accept``, and the
    numeric fields become a metrics map.
    """
    mode = "FAILFAST" if strict else "DROPMALFORMED"
    raw = spark.read.schema(DECISION_SCHEMA).option("recursiveFileLookup", "true").json(path, mode=mode).where("handle is not null")
    outcome = lambda c: F.coalesce(c["outcome"], c["action"])
    tried = F.transform(F.coalesce("candidates_tried", F.array().cast(raw.schema["candidates_tried"].dataType)), lambda c: F.struct(
        c["url"].alias("url"), F.when(outcome(c) == "accepted", "accept").otherwise(outcome(c)).alias("outcome"),
        F.coalesce(c["resolver_confidence"], c["pre_scrape_confidence"]).alias("resolver_confidence"),
        F.coalesce(c["confidence"], c["post_confidence"], c["post_scrape_confidence"]).alias("confidence"), c["title_extracted"].alias("title_extracted"),
        F.map_filter(F.create_map(F.lit("title_similarity"), c["title_similarity"], F.lit("word_overlap"), c["word_overlap"]), lambda k, v: v.isNotNull()).alias("metrics"),
        F.coalesce(c["penalties"], F.create_map().cast("map<string,double>")).alias("penalties"), c["rescore_reasoning"].alias("rescore_reasoning"), c["signals"].alias("signals")))
    return raw.select(
        F.concat_ws("#", "handle", F.coalesce(F.col("timestamp").cast("string"), F.lit("")), F.sha2(F.to_json(F.struct(*raw.columns)), 256)).alias("decision_id"),
        "handle", text(F.col("vendor")).alias("vendor"), text(F.col("catalog_title")).alias("catalog_title"), F.col("timestamp").alias("ts"), "outcome", "final_url",
        F.coalesce("type_words", F.array().cast("array<string>")).alias("type_words"), tried.alias("candidates_tried"),
        F.transform(F.coalesce("resolver_candidates", F.array().cast(raw.schema["resolver_candidates"].dataType)), lambda c: c["url"]).alias("resolver_candidates"))


def rejected_lines(spark: SparkSession, path: str, schema: str = DECISION_SCHEMA) -> DataFrame:
    """``(file, line)`` of the lines of a JSON-lines log that a reader with ``schema`` leaves out."""
    raw = spark.read.schema(schema + ", _bad string").option("recursiveFileLookup", "true").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return raw.select(F.col("_metadata.file_path").alias("file"), "handle", "_bad").where("_bad is not null or handle is null").select("file", F.col("_bad").alias("line"))


def read_artifacts(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """``<root>/<handle>/<name>`` JSON files, unreadable ones dropped; the handle is the folder."""
    raw = spark.read.schema(schema + ", _bad string").json(f"{root}/*/{name}", multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    handle = F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{name.replace('.', '[.]')}$", 1)
    return raw.withColumn("handle", F.url_decode(handle)).where("_bad is null").drop("_bad")


def read_feedback(spark: SparkSession, glob: str) -> DataFrame:
    """Feedback entries of one or all runs."""
    schema = "handle string, run_id string, disposition string, reason string, generated_html string, final_html string, confidence int, timestamp timestamp"
    return spark.read.schema(schema).json(glob, multiLine=True, mode="DROPMALFORMED").where("handle is not null")


def report_rows(landed: DataFrame, names: list[str]) -> DataFrame:
    """Report rows that arrive positionally with a column list."""
    return landed.select(*[report_value(F.col("row"), F.col("columns"), n).alias(n) for n in names])


VENDOR_SCHEMA = T.StructType([
    T.StructField("vendor", T.StringType()), T.StructField("domain", T.StringType()), T.StructField("is_shopify", T.BooleanType()),
    T.StructField("blocked", T.BooleanType()), T.StructField("house_brand", T.BooleanType()), T.StructField("search_brand_name", T.StringType()),
    T.StructField("blocked_paths", T.ArrayType(T.StringType())), T.StructField("product_url_patterns", T.ArrayType(T.StringType())),
])
VENDOR_DEFAULTS = {
    "domain": "", "is_shopify": False, "blocked": False, "house_brand": False, "search_brand_name": "",
    "blocked_paths": ["/blog", "/stores", "/account", "/cart"], "product_url_patterns": ["/product", "/products", "/p/", "/shop/"],
}


def read_vendors(spark: SparkSession, path: str) -> DataFrame:
    """Vendor dimension from one small JSON or YAML configuration file."""
    body = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file, from any store
    if path.endswith((".yaml", ".yml")):
        import yaml  # optional dependency

        config = yaml.safe_load(body)
    else:
        config = json.loads(body)
    rows = [{"vendor": k, **VENDOR_DEFAULTS, **{f: v for f, v in (cfg or {}).items() if f in VENDOR_DEFAULTS}} for k, cfg in config.get("vendors", {}).items()]
    return spark.createDataFrame(rows, VENDOR_SCHEMA)


def save_snapshot(scores: DataFrame, path: str) -> None:
    """Audit snapshot for weight tuning, without raw variants."""
    scores.drop("variants_raw").write.mode("overwrite").parquet(path)


def load_snapshot(spark: SparkSession, path: str, schema: T.StructType | None = None, defaults: dict | None = None) -> DataFrame:
    """Snapshot files of any version, columns met by name over all files.

    With ``schema`` columns that no version has are added and those that it lacks are ignored; a column that is missing or null
    takes its value in ``defaults``.
    """
    found = spark.read.option("mergeSchema", "true").parquet(path)
    have = set(found.columns)
    fields = schema.fields if schema else found.schema.fields
    value = lambda f: F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
    filled = lambda f: F.coalesce(value(f), F.lit(defaults[f.name]).cast(f.dataType)) if defaults and f.name in defaults else value(f)
    return found.select(*[filled(f).alias(f.name) for f in fields])


STORE_SCHEMA = (
    "id long, handle string, title string, vendor string, product_type string, body_html string, "
    "images array<struct<id long, src string, alt string, width int, height int, variant_ids array<long>>>, variants array<struct<id long, option1 string>>"
)


def store_facts(products: DataFrame, paragraphs: int | None = None) -> DataFrame:
    """Facts of a vendor store's product JSON (S26); ``paragraphs`` bounds how many of the body are kept."""
    default = lambda c: (text(c) == "") | F.lower(text(c)).isin("default title", "default")
    plain = strip(F.regexp_replace(F.regexp_replace(text(F.col("body_html")), r"(?i)</p>|<br\s*/?>", "\n\n"), "<[^>]+>", ""))
    blocks = F.filter(F.transform(F.split(plain, r"\n\s*\n"), strip), lambda b: b != "")
    blocks = blocks if paragraphs is None else F.slice(blocks, 1, paragraphs)
    option = F.map_from_entries(F.transform("variants", lambda v: F.struct(v["id"], v["option1"])))
    named = F.flatten(F.transform("images", lambda i: F.transform(F.coalesce(i["variant_ids"], F.array().cast("array<long>")), lambda v: F.struct(F.element_at(option, v).alias("color"), i["src"].alias("url")))))
    staged = products.withColumn("_pairs", F.array_distinct(F.filter(named, lambda p: ~default(p["color"]))))
    pairs, keys = F.col("_pairs"), F.array_distinct(F.transform("_pairs", lambda p: p["color"]))
    pictures = F.transform(
        F.filter("images", lambda i: text(i["src"]) != ""),
        lambda i: F.struct(i["src"].alias("url"), text(i["alt"]).alias("alt"), F.lit("store_json").alias("source_hint")))
    shaped = staged.withColumns({
        "description_blocks": blocks, "_pictures": pictures,
        "specs": F.when(text(F.col("product_type")) != "", F.create_map(F.lit("Product Type"), F.col("product_type"))).otherwise(F.create_map().cast("map<string,string>")),
        "colors": F.array_distinct(F.filter(F.transform("variants", lambda v: v["option1"]), lambda c: ~default(c))),
        "variant_image_candidates": F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.transform(F.filter(pairs, lambda p: p["color"] == k), lambda p: p["url"])))),
    })
    return shaped.select(
        "id", "handle", F.col("title").alias("product_name"), F.col("vendor").alias("brand"), "description_blocks", "specs", F.col("_pictures").alias("images"),
        "colors", "variant_image_candidates")


def search_images(responses: DataFrame, min_dim: int = 500, one_per_domain: bool = True) -> DataFrame:
    """Usable image-search results (S27): confident, large, complete, first per source domain."""
    r = responses.select("query", F.posexplode("results").alias("ord", "r")).select("query", "ord", "r.*").where(
        F.col("confidence").isin("high", "medium") & (F.coalesce("properties.width", F.lit(0)) >= min_dim) & (F.coalesce("properties.height", F.lit(0)) >= min_dim)
        & (text(F.col("properties.url")) != "") & (text(F.col("thumbnail.src")) != ""))
    row = r.select("query", "ord", text(F.col("source")).alias("domain"), F.col("properties.url").alias("full_url"), F.col("thumbnail.src").alias("thumbnail_url"),
                   F.col("url").alias("source_page"), "title", "confidence")
    if not one_per_domain:
        return row
    return row.groupBy("query", "domain").agg(F.min_by(F.struct("ord", "full_url", "thumbnail_url", "source_page", "title", "confidence"), "ord").alias("r")).select("query", "domain", "r.*")


EXTRACTION_SCHEMA = (
    "product_name string, brand string, description_blocks array<string>, feature_bullets array<string>, specs map<string,string>, materials string, images array<string>"
)


def structured_facts(landed: DataFrame) -> DataFrame:
    """Structured-extraction JSON to facts (S28): http images only, resize parameters dropped, no repeats."""
    d = landed.select("url", F.from_json("json", EXTRACTION_SCHEMA).alias("d"))
    images = F.array_distinct(F.transform(F.filter(F.coalesce("d.images", F.array().cast("array<string>")), lambda u: text(u).startswith("http")), drop_resize_params))
    empty = F.array().cast("array<string>")
    return d.select(
        F.col("url").alias("canonical_url"), text(F.col("d.product_name")).alias("product_name"), text(F.col("d.brand")).alias("brand"),
        F.coalesce("d.description_blocks", empty).alias("description_blocks"), F.coalesce("d.feature_bullets", empty).alias("feature_bullets"),
        F.coalesce("d.specs", F.create_map().cast("map<string,string>")).alias("specs"), text(F.col("d.materials")).alias("materials"), images.alias("images"))


def markdown_images(markdown: Column) -> Column:
    """Whether a markdown page shows any image."""
    return markdown.rlike(r"!\[.*?\]\(https?://[^)]+\)") | markdown.rlike(r"(?i)https?://\S+\.(?:jpg|jpeg|png|webp|avif)")


def append_images(markdown: Column, urls: Column) -> Column:
    """Image list appended to a page without images."""
    lines = F.array_join(F.transform(urls, lambda u: F.concat(F.lit("![]("), u, F.lit(")"))), "\n")
    return F.when(markdown_images(markdown) | (F.size(urls) == 0), markdown).otherwise(F.concat(markdown, F.lit("\n\n"), lines))


def list_values(products: DataFrame, column: str) -> DataFrame:
    """Distinct vendors, types or collections."""
    return products.select(column).where(text(F.col(column)) != "").distinct()


def list_products(products: DataFrame, vendor: str | None = None, product_type: str | None = None, status: str | None = "active", limit: int = 0) -> DataFrame:
    """Filtered product scan (S1): equality predicates reach the source; 0 is no limit."""
    for name, value in (("vendor", vendor), ("product_type", product_type), ("status", status)):
        if value:
            products = products.where(F.col(name) == value)
    return products.orderBy("product_id").limit(limit) if limit > 0 else products


def shape_products(products: DataFrame, images: DataFrame) -> DataFrame:
    """Null defaults and the images of a product nested by position."""
    nested = images.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct(
        F.coalesce("position", F.lit(0)).alias("position"), text(F.col("src")).alias("src"), text(F.col("alt")).alias("alt"), "variant_id"))).alias("images"))
    names = ("title", "body_html", "vendor", "product_type", "tags", "status")
    filled = products.withColumns({n: text(F.col(n)) for n in names})
    return filled.join(nested, "product_id", "left")


def shape_variants(variants: DataFrame) -> DataFrame:
    """Null defaults of variants (S6): empty text, zero numbers, shipping required, pounds."""
    strings = [f"option{i}_{k}" for i in (1, 2, 3) for k in ("name", "value")] + ["sku", "barcode", "image_src"]
    cols = {c: text(F.col(c)) for c in strings if c in variants.columns}
    cols |= {c: F.coalesce(c, F.lit(0.0)) for c in ("price", "cost", "grams") if c in variants.columns}
    if "weight_unit" in variants.columns:
        cols["weight_unit"] = F.coalesce(F.nullif("weight_unit", F.lit("")), F.lit("lb"))
    return variants.withColumns(cols | {"requires_shipping": F.coalesce("requires_shipping", F.lit(True))})


def get_product(products: DataFrame, handle: str) -> DataFrame:
    """Point lookup by handle."""
    return products.where(F.col("handle") == handle)


def variants_by(variants: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """Variants for a table of product ids, barcodes or variant ids (S3): an equi-join, never a loop."""
    return variants.join(keys.select(column).where(F.col(column).isNotNull()).distinct(), column, "left_semi")


def collection_products(products: DataFrame, members: DataFrame, collection: str) -> DataFrame:
    """Products of a collection."""
    return products.join(members.where(F.col("collection") == collection).select("product_id").distinct(), "product_id", "left_semi")
