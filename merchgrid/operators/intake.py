"""Work intake: needs, routing, catalog coverage and variant image expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchgrid.functions.colors import normalize
from merchgrid.functions.common import merged, strip, text
from merchgrid.operators.colors import match_colors

COLOR_NAMES = ["color", "colour", "style"]
SIZE_NAMES = ["size", "length"]
ALL = "__all__"


def option_by_name(names: list[str]) -> Column:
    """Value of the last option that carries one of the names."""
    pick = lambda i: F.when(F.lower(text(F.col(f"option{i}_name"))).isin(names), text(F.col(f"option{i}_value")))
    return F.coalesce(pick(3), pick(2), pick(1), F.lit(""))


def variant_options(variants: DataFrame) -> DataFrame:
    have = set(variants.columns)
    blank = {f"option{i}_{k}": F.lit("") for i in (1, 2, 3) for k in ("name", "value") if f"option{i}_{k}" not in have}
    return variants.withColumns(blank).withColumns({"color": option_by_name(COLOR_NAMES), "size": option_by_name(SIZE_NAMES)}) if blank else variants.withColumns(
        {"color": option_by_name(COLOR_NAMES), "size": option_by_name(SIZE_NAMES)})


def known_colors(variants: DataFrame) -> DataFrame:
    """Distinct colours per product in variant order, with the catalog image of the last variant that has one."""
    has_image = text(F.col("catalog_image")) != ""
    return variants.where("color <> ''").groupBy("product_id", "color").agg(
        F.min(F.struct("position", "variant_id")).alias("first_at"),
        F.max_by("catalog_image", F.when(has_image, F.struct("position", "variant_id"))).alias("catalog_image"),
    )


def identifier_rows(variants: DataFrame, inputs: DataFrame, column: str) -> DataFrame:
    """All barcodes or SKUs of a product; the input row's own value only when no variant has one."""
    own = variants.where(text(F.col(column)) != "").select("product_id", column)
    fallback = inputs.where(text(F.col(column)) != "").join(merged(own.select("product_id").distinct()), "product_id", "left_anti").select("product_id", column)
    return own.unionByName(fallback)


def needs(rows: DataFrame, only: str | None = None) -> DataFrame:
    """Need flags of an input row (P5); ``only`` restricts the run to one kind of gap."""
    force = {"images": ("has_description", "has_variant_images"), "description": ("has_image", "has_variant_images"),
             "variant-images": ("has_image", "has_description")}.get(only or "", ())
    flag = lambda c: F.lit(False) if c in force else ~F.col(c)
    out = rows.withColumns({"needs_description": flag("has_description"), "needs_images": flag("has_image"), "needs_variant_images": flag("has_variant_images")})
    return out.withColumn("has_any_gap", F.col("needs_description") | F.col("needs_images") | F.col("needs_variant_images"))


def route(rows: DataFrame, vendors: DataFrame, cached: DataFrame, force: bool = False, image_search: bool = True) -> DataFrame:
    """Processing status per row (P8): no gaps, unknown vendor, blocked, cached, process."""
    v = vendors.select("vendor", F.coalesce("blocked", F.lit(False)).alias("_blocked"), F.coalesce("house_brand", F.lit(False)).alias("_house"), F.lit(True).alias("_known"))
    c = cached.select("handle").distinct().withColumn("_cached", F.lit(True))
    j = rows.join(v, "vendor", "left").join(merged(c), "handle", "left")
    status = (
        F.when(~F.col("has_any_gap") & ~F.lit(force), "SKIPPED_NO_GAPS").when(F.col("_known").isNull(), "SKIPPED_VENDOR_NOT_CONFIGURED")
        .when(F.col("_blocked") & F.lit(image_search) & ~F.col("_house"), "IMAGE_SEARCH_ONLY").when(F.col("_blocked"), "SKIPPED_VENDOR_NOT_CONFIGURED")
        .when(F.col("_cached").isNotNull() & ~F.lit(force), "CACHED").otherwise("PROCESS")
    )
    return j.withColumn("status", status).drop("_blocked", "_house", "_known", "_cached")


def catalog_direct(rows: DataFrame, colors: DataFrame) -> DataFrame:
    """Products whose catalog images cover every colour and that need no description.

    ``colors`` comes from ``known_colors``.  Confidence is 90: the vendor's own images.
    """
    wanted = colors.select("product_id", "color")
    offered = colors.where(text(F.col("catalog_image")) != "").select("product_id", F.col("color").alias("candidate"), F.col("first_at.position").cast("bigint").alias("ord"))
    hit = match_colors(wanted, offered).select("product_id", "color", F.lit(1).alias("hit"))
    covered = wanted.join(merged(hit), ["product_id", "color"], "left").groupBy("product_id").agg(
        F.count(F.lit(1)).alias("colors"), F.count("hit").alias("covered"))
    full = covered.where("colors = covered")
    return rows.where(~F.col("needs_description")).join(merged(full.select("product_id", "colors")), "product_id").withColumns(
        {"confidence": F.lit(90), "warning": F.lit("CATALOG_IMAGES_USED_DIRECTLY")})


def merge_color_images(scraped: DataFrame, catalog: DataFrame) -> DataFrame:
    """Scraped and catalog images under one colour name.

    Both inputs are long rows ``(product_id, color, ord, url)``.  A catalog colour joins the
    scraped colour it matches; names with one normal form merge under the first.
    """
    names = scraped.groupBy("product_id", "color").agg(F.min("ord").alias("ord")).withColumnRenamed("color", "candidate")
    found = match_colors(catalog.select("product_id", "color"), names).select("product_id", "color", "matched")
    at = lambda source: F.struct(F.lit(source).alias("source"), "ord").alias("place")  # scraped names and images come first
    moved = catalog.join(merged(found), ["product_id", "color"], "left").select("product_id", F.coalesce("matched", "color").alias("color"), at(1), "url")
    rows = scraped.select("product_id", "color", at(0), "url").unionByName(moved).withColumn("norm", normalize(F.col("color")))
    images = rows.groupBy("product_id", "norm", "url").agg(F.min("place").alias("place"), F.min(F.struct("place", "color")).alias("lead"))
    # over the images themselves, so the rows are built once
    color = F.min("lead").over(Window.partitionBy("product_id", "norm"))["color"]
    return images.select("product_id", color.alias("color"), "place", "url")


def store_form(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit(" | "), F.lit(" / ")), F.lit("|"), F.lit("/"))


def keep_store_colors(mapped: DataFrame, variants: DataFrame) -> DataFrame:
    """Colour-map rows whose colour the store sells.

    Equal names and equal first segments are joined by key.  A prefix match in either
    direction implies the same first letter run, so it is joined on the first segment's
    leading word and verified; products without colours keep everything.
    """
    store = variants.where("color <> ''").select("product_id", store_form(F.col("color")).alias("s")).distinct()
    m = mapped.withColumn("k", store_form(F.col("color")))
    free = (F.col("color") == ALL)
    has_colors = store.select("product_id").distinct().withColumn("_c", F.lit(True))
    segment = lambda c: F.substring_index(c, " / ", 1)
    block = lambda c: F.left(c, F.lit(1))
    distinct = m.select("product_id", "k").distinct()
    same_segment = distinct.withColumn("g", segment(F.col("k"))).join(merged(store.select("product_id", segment(F.col("s")).alias("g")).distinct()), ["product_id", "g"]).select("product_id", "k")
    prefix = distinct.withColumn("g", block(F.col("k"))).join(merged(store.withColumn("g", block(F.col("s")))), ["product_id", "g"]).where(
        F.col("k").startswith(F.col("s")) | F.col("s").startswith(F.col("k"))).select("product_id", "k")
    ok = same_segment.unionByName(prefix).distinct().withColumn("_ok", F.lit(True))
    return m.join(merged(has_colors), "product_id", "left").join(merged(ok), ["product_id", "k"], "left").where(
        free | F.col("_c").isNull() | F.col("_ok").isNotNull()).drop("k", "_c", "_ok")


def expand_variant_images(mapped: DataFrame, variants: DataFrame, products: DataFrame) -> DataFrame:
    """Variant image rows from a colour map.

    ``mapped(product_id, color, ord, url, confidence)``; ``__all__`` goes to every variant
    with an option value, a colour to the variants it matches, products without variants
    get marker rows, products without a map a warning row.
    """
    base = ["product_id", "variant_id", "sku", "option_name", "option_value", "image", "confidence", "warning"]
    blank = F.lit("")
    hero = mapped.where(F.col("color") == ALL).groupBy("product_id").agg(F.min_by(F.struct("url", "confidence"), "ord").alias("h"))
    value = F.when(F.col("color") != "", F.col("color")).otherwise(F.col("size"))
    to_all = variants.join(merged(hero), "product_id").where(value != "").select(
        "product_id", "variant_id", "sku", F.when(F.col("color") != "", "Color").otherwise("Size").alias("option_name"), value.alias("option_value"),
        F.col("h.url").alias("image"), F.col("h.confidence").alias("confidence"), F.lit("EXPANDED_FROM_ALL").alias("warning"))
    colors = mapped.where((F.col("color") != ALL) & (text(F.col("url")) != ""))
    first = colors.groupBy("product_id", "color").agg(F.min("ord").alias("ord"), F.min_by(F.struct("url", "confidence"), "ord").alias("c"))
    found = match_colors(variants.where("color <> ''").select("product_id", "color"), first.select("product_id", F.col("color").alias("candidate"), "ord"))
    by_color = variants.join(merged(found), ["product_id", "color"]).join(merged(first.select("product_id", F.col("color").alias("matched"), "c")), ["product_id", "matched"]).select(
        "product_id", "variant_id", "sku", F.lit("Color").alias("option_name"), F.col("color").alias("option_value"), F.col("c.url").alias("image"),
        F.col("c.confidence").alias("confidence"), blank.alias("warning"))
    with_variants = variants.select("product_id").distinct()
    bare = first.join(merged(with_variants), "product_id", "left_anti").select(
        "product_id", F.lit(0).cast("bigint").alias("variant_id"), blank.alias("sku"), F.lit("Color").alias("option_name"), F.col("color").alias("option_value"),
        F.col("c.url").alias("image"), F.col("c.confidence").alias("confidence"), F.lit("NO_VARIANT_DATA").alias("warning"))
    bare_all = hero.join(merged(with_variants), "product_id", "left_anti").select(
        "product_id", F.lit(0).cast("bigint").alias("variant_id"), blank.alias("sku"), F.lit(ALL).alias("option_name"), blank.alias("option_value"),
        F.col("h.url").alias("image"), F.col("h.confidence").alias("confidence"), F.lit("ASSIGN_TO_ALL_VARIANTS").alias("warning"))
    none = products.join(merged(mapped.select("product_id").distinct()), "product_id", "left_anti").select(
        "product_id", F.lit(0).cast("bigint").alias("variant_id"), blank.alias("sku"), F.lit("Color").alias("option_name"), blank.alias("option_value"), blank.alias("image"),
        F.lit(0).alias("confidence"), F.lit("VARIANT_IMAGE_NOT_ASSIGNED").alias("warning"))
    out = to_all
    for part in (by_color, bare, bare_all, none):
        out = out.unionByName(part)
    return out.select(*base)


def export_variant_images(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """Variant images by exact option value (J10, export-row form).

    ``rows(product_id, row_id, option1_name .. option3_value)``, ``mapped(product_id, color, ord, url)``.  Of a row's colour
    options the first one with an image counts, with the colour's first image.
    """
    options = F.array(*[F.struct(text(F.col(f"option{k}_name")).alias("name"), text(F.col(f"option{k}_value")).alias("value")) for k in (1, 2, 3)])
    named = rows.select("product_id", "row_id", F.posexplode(options).alias("at", "o")).where(F.lower("o.name").isin("color", "colour") & (F.col("o.value") != ""))
    first = mapped.where(text(F.col("url")) != "").groupBy("product_id", F.col("color").alias("option_value")).agg(F.min_by("url", "ord").alias("image"))
    found = named.select("product_id", "row_id", "at", F.col("o.value").alias("option_value")).join(merged(first), ["product_id", "option_value"])
    best = found.groupBy("product_id", "row_id").agg(F.min_by(F.struct("option_value", "image"), "at").alias("b"))
    return best.select("product_id", "row_id", F.lit("Color").alias("option_name"), "b.option_value", "b.image", F.lit(85).alias("confidence"))


def option_map(row: DataFrame) -> DataFrame:
    """Option name to value per export row, empty names and values dropped."""
    pairs = F.filter(
        F.array(*[F.struct(text(F.col(f"Option{i} Name")).alias("n"), text(F.col(f"Option{i} Value")).alias("v")) for i in (1, 2, 3)]),
        lambda p: (p["n"] != "") & (p["v"] != ""))
    # A repeated option name keeps its last value.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, 3), lambda q: q["n"] == p["n"]))
    return row.withColumn("options", F.map_from_entries(last)).where(F.size("options") > 0)


def brand_color(rows: DataFrame, whole_title: list[str], leading: list[str], words: list[str]) -> DataFrame:
    """Colour of vendors that put it into the title (P19): the whole title, or its leading colour word."""
    lead = F.regexp_extract(text(F.col("title")), rf"(?i)^({'|'.join(words)})\b", 1)
    return rows.withColumn("color", F.when(F.col("vendor").isin(whole_title), strip(F.col("title"))).when(F.col("vendor").isin(leading), F.initcap(lead)).otherwise(""))


def skip_types(rows: DataFrame, types: list[str]) -> DataFrame:
    """Rows whose type is not in the skip list (P20)."""
    return rows.where(~F.lower(strip(text(F.col("product_type")))).isin(types))


def color_variants(variants: DataFrame, wanted: DataFrame) -> DataFrame:
    """Variants whose first or second option equals a wanted colour (S25): two equi-joins instead of an OR."""
    w = wanted.select("product_id", "color").distinct()
    one = variants.join(merged(w.withColumnRenamed("color", "option1_value")), ["product_id", "option1_value"]).select("product_id", "variant_id", F.col("option1_value").alias("color"))
    two = variants.join(merged(w.withColumnRenamed("color", "option2_value")), ["product_id", "option2_value"]).select("product_id", "variant_id", F.col("option2_value").alias("color"))
    return one.unionByName(two).distinct()
