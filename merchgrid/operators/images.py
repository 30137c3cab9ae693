"""Variant images: propagation, catalog fallback, assignment tiers, bulk-edit rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.functions.common import contains_any, merged, strip, text

# Hosts whose pictures are indexed by colour and not by product.
SWATCH_HOSTS = ["swatch.example.net/", "media.swatch.example.org/", "img.swatch.example.org/images/"]


def is_swatch(url: Column) -> Column:
    return contains_any(url, SWATCH_HOSTS)


def catalog_by_barcode(items: DataFrame) -> DataFrame:
    """Catalog image per barcode without swatches."""
    return items.where("barcode <> '' and image_url <> ''").where(~is_swatch(F.col("image_url"))).groupBy("barcode").agg(
        F.min("image_url").alias("catalog_image")
    )


def with_catalog_image(variants: DataFrame, items: DataFrame) -> DataFrame:
    """``variants`` with the catalog image of their barcode; rows without a barcode, often most of a shop, stay out of the join."""
    known = variants.where("barcode <> ''").join(merged(catalog_by_barcode(items)), "barcode", "left")
    blank = variants.where("barcode is null or barcode = ''").withColumn("catalog_image", F.lit(None).cast("string"))
    return known.select(*variants.columns, "catalog_image").unionByName(blank)


def catalog_by_style(items: DataFrame) -> DataFrame:
    return items.where("style <> '' and image_url <> ''").where(~is_swatch(F.col("image_url"))).groupBy("vendor", "style", "color").agg(
        F.min("image_url").alias("style_image")
    )


def propagate_images(products: DataFrame, variants: DataFrame, items: DataFrame) -> DataFrame:
    """An image for every variant without one.

    Colour products work per (product, colour): the first variant with an image, else
    the catalog image of the first variant whose barcode is known, else style and
    colour.  Other products look up each variant's barcode.  The group facts are
    aggregated and joined back; no window gathers a colour group.
    """
    p = products.where(F.col("status") == "active").select("product_id", "handle", "vendor", "style")
    has_color = variants.groupBy("product_id").agg(F.bool_or(F.lower(text(F.col("option1_name"))) == "color").alias("has_color"))
    v = (
        variants.select(
            "product_id", "variant_id", "position", "barcode", "image_src",
            F.when(F.col("option1_value") == "", "Unknown").otherwise(F.col("option1_value")).alias("color"),
        )
        .join(merged(has_color), "product_id")
    )
    v = with_catalog_image(v, items)
    at = F.struct("position", "variant_id")
    own = F.when(F.col("image_src") != "", at)
    found = F.when(F.col("catalog_image").isNotNull(), at)
    groups = v.where("has_color").groupBy("product_id", "color").agg(
        F.min_by(F.struct("image_src", "variant_id"), own).alias("own"), F.min_by("catalog_image", found).alias("group_catalog")
    )
    style = p.join(catalog_by_style(items), ["vendor", "style"]).select("product_id", "color", "style_image")
    need = v.where("image_src = ''").join(merged(groups), ["product_id", "color"], "left").join(merged(style), ["product_id", "color"], "left").join(merged(p), "product_id")
    color = F.col("has_color")
    source = (
        F.when(color & F.col("own").isNotNull(), "propagation")
        .when(color & F.col("group_catalog").isNotNull(), "catalog_barcode")
        .when(color & F.col("style_image").isNotNull(), "catalog_style_color")
        .when(~color & F.col("catalog_image").isNotNull(), "catalog_barcode")
        .otherwise("missing")
    )
    image = F.when(color, F.coalesce("own.image_src", "group_catalog", "style_image")).otherwise(F.col("catalog_image"))
    return need.select(
        "variant_id", "product_id", "handle", text(image).alias("image_url"), source.alias("source"),
        F.when(source == "propagation", F.col("own.variant_id")).alias("source_id"),
    )


def source_counts(assignments: DataFrame) -> DataFrame:
    """Counters by source."""
    return assignments.groupBy("source").agg(F.count(F.lit(1)).alias("variants"))


def description_backfill(products: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Catalog descriptions for products without one."""
    empty = products.where((F.col("status") == "active") & (strip(text(F.col("body_html"))) == "")).select("product_id", "handle")
    return empty.join(merged(descriptions.where("description <> ''")), "product_id")


def apply_bulk_export(variants: DataFrame, export: DataFrame) -> DataFrame:
    """Variant snapshot after a bulk export: a value in the export replaces the old one."""
    new = export.select(
        F.col("variant_id").try_cast("bigint").alias("variant_id"),
        F.nullif(strip(text(F.col("image"))), F.lit("")).alias("_image"), F.col("pos").try_cast("int").alias("_pos"), F.col("ord"),
    ).where("variant_id is not null")
    # Rows apply in file order: per column the last present value wins.
    last = new.groupBy("variant_id").agg(
        F.max_by("_image", F.when(F.col("_image").isNotNull(), F.col("ord"))).alias("_image"),
        F.max_by("_pos", F.when(F.col("_pos").isNotNull(), F.col("ord"))).alias("_pos"),
    )
    return variants.join(merged(last), "variant_id", "left").withColumns({
        "image_src": F.coalesce("_image", "image_src"), "position": F.coalesce("_pos", "position"),
    }).drop("_image", "_pos")


def bulk_export_counts(variants: DataFrame, export: DataFrame) -> DataFrame:
    """Counters of the bulk export (K14): one pass over the joined rows."""
    rows = export.where(text(F.col("variant_id")) != "").withColumn("_id", F.col("variant_id").try_cast("bigint"))
    known = variants.select(F.col("variant_id").alias("_id"), F.lit(True).alias("_known"))
    hit = F.col("_known").isNotNull()
    image, pos = strip(text(F.col("image"))) != "", F.col("pos").try_cast("int").isNotNull()
    return rows.join(merged(known), "_id", "left").agg(
        F.count_if(hit & (image | pos)).alias("variants_updated"), F.count_if(~hit).alias("variants_skipped"),
        F.count_if(hit & image).alias("images_set"), F.count_if(hit & pos).alias("positions_set"),
        F.count_distinct(F.when(hit, F.col("product_id"))).alias("products_seen"),
    )


def merge_marker(rows: DataFrame) -> DataFrame:
    """Bulk-edit image rows: the command stands on a product's first row only (K7)."""
    first = rows.groupBy("product_id").agg(F.min("ord").alias("_first"))
    return rows.join(merged(first), "product_id").withColumn(
        "command", F.when(F.col("ord") == F.col("_first"), "MERGE").otherwise(F.lit(""))
    ).drop("_first")


def assign_hero(outputs: DataFrame) -> DataFrame:
    """Variant image tiers without a model (M24): explicit map, hero for colourless products, else a warning."""
    explicit = F.size("image_map") > 0
    picked = F.transform_values("image_map", lambda k, urls: F.get(urls, F.lit(0)))
    hero = F.get("images", F.lit(0))
    return outputs.select(
        "handle",
        F.when(explicit, picked)
        .when(~F.col("has_color") & hero.isNotNull(), F.create_map(F.lit("__all__"), hero))
        .otherwise(F.create_map().cast("map<string,string>")).alias("assignment"),
        F.when(~explicit & F.col("has_color"), "COLOR_MATCHING_FAILED_NO_IMAGES_ASSIGNED").when(~explicit & hero.isNull(), "NO_IMAGES_FOR_VARIANT_ASSIGNMENT").alias("warning"),
    )
