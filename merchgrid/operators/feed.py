"""Shopping feed, weight sheet, bulky-item audit and alt-text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.functions.common import any_of, first_rule, lookup, squeeze, strip, text
from merchgrid.functions.ranking import distributed_rank
from merchgrid.operators.shipping import type_weight_grams
from merchgrid.operators.taxonomy import split_tags
from merchgrid.rules import catalog as rules

COLOR_NAMES = ["color", "style"]
DEFAULT_OPTION = "default title"
# Fixed value: units that make an option value a quantity and not a size.
UNITS = "oz|OZ|ml|mL|ML|L|l|g|kg|cm|mm|M|m|ft|pk|ct"
NON_SIZE = rf"^\d+(\.\d+)?\s*({UNITS})\b|^\d+\s*/\s*\d+\s*(oz|g)"


def first_tag(tags: Column, table: dict[str, str]) -> Column:
    """Value of the first tag (in tag order) that the table knows."""
    hits = F.filter(F.transform(split_tags(tags), lambda t: lookup(F.lower(t), table)), lambda v: v.isNotNull())
    return F.get(hits, F.lit(0))


def gender(tags: Column, title: Column) -> Column:
    return F.coalesce(first_tag(tags, rules.TAG_TO_GENDER), first_rule(text(title), rules.TITLE_FEED_GENDER_RULES), F.lit(""))


def age_group(tags: Column, title: Column) -> Column:
    kids = F.exists(split_tags(tags), lambda t: F.lower(t) == "gender:kids") | text(title).rlike(rules.TITLE_FEED_GENDER_RULES[0][0])
    return F.when(kids, "kids").otherwise("adult")


def season(tags: Column) -> Column:
    return F.coalesce(first_tag(tags, rules.SEASON_TAG_MAP), F.lit("year-round"))


def activity(tags: Column) -> Column:
    hits = F.filter(split_tags(tags), lambda t: F.lower(t).startswith("activity:"))
    return F.coalesce(strip(F.regexp_replace(F.get(hits, F.lit(0)), "^[^:]*:", "")), F.lit("general"))


def price_tier(price: Column) -> Column:
    out = F.lit(rules.TOP_PRICE_TIER)
    for limit, name in reversed(rules.PRICE_TIERS):
        out = F.when(price < limit, name).otherwise(out)
    return F.when(price.isNull(), rules.PRICE_TIERS[0][1]).otherwise(out)


def variant_color(name: Column, value: Column) -> Column:
    real = F.lower(text(name)).isin(COLOR_NAMES) & (F.lower(text(value)) != DEFAULT_OPTION)
    return F.when(real, text(value)).otherwise(F.lit(""))


def variant_size(name1: Column, value1: Column, value2: Column) -> Column:
    """Size option: option 1 when named Size, option 2 beside a colour; quantities are no sizes."""
    low = F.lower(text(name1))
    raw = F.when(low == "size", text(value1)).when(low.isin(COLOR_NAMES), text(value2)).otherwise(F.lit(""))
    no_size = any_of(F.lower(raw) == DEFAULT_OPTION, strip(raw).rlike(NON_SIZE))
    return F.when(no_size, F.lit("")).otherwise(raw)


def size_system(vendor: Column, kind: Column, size: Column) -> Column:
    mondo = kind.isin(rules.MONDO_TYPES) & F.coalesce(size.try_cast("double").between(20, 33), F.lit(False))
    return F.when(size == "", F.lit("")).when(vendor.isin(rules.EU_SIZE_VENDORS), "EU").when(mondo, F.lit("")).otherwise("US")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+$", "")


def seo_title(vendor: Column, title: Column) -> Column:
    """'{vendor} {title} | {store}' within 60 characters, vendor not doubled."""
    v, t = strip(text(vendor)), strip(text(title))
    suffix = f" | {rules.STORE_NAME}"
    doubled = (v == "") | F.lower(t).startswith(F.lower(v))
    head = F.when(doubled, t).otherwise(F.concat(v, F.lit(" "), t))
    fits = F.length(head) + len(suffix) <= 60
    full = F.concat(F.when(fits, head).otherwise(rstrip(F.left(head, F.lit(60 - len(suffix))))), F.lit(suffix))
    return F.when((v == "") & (t == ""), F.lit("")).otherwise(full)


def parsed_text(html: Column) -> Column:
    """Text content as an HTML parser yields it: tags gone, basic entities decoded."""
    out = F.regexp_replace(text(html), "<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeeze(out)


def seo_description(vendor: Column, title: Column, html: Column, kind: Column) -> Column:
    body = parsed_text(html)
    phrase = lookup(text(kind), rules.TYPE_PHRASES)
    template = F.concat(
        F.lit("Shop the "), text(vendor), F.lit(" "), text(title), F.lit(f" at {rules.STORE_NAME} in {rules.STORE_PLACE}."),
        F.when(phrase.isNotNull(), F.concat(F.lit(" "), phrase, F.lit("."))).otherwise(F.lit("")),
        F.lit(" Free in-store pickup available."),
    )
    short = F.when(F.length(template) > 160, F.concat(rstrip(F.left(template, F.lit(157))), F.lit("..."))).otherwise(template)
    cut = F.when(F.length(body) > 155, F.concat(rstrip(F.left(body, F.lit(155))), F.lit("..."))).otherwise(body)
    return F.when(body != "", cut).otherwise(short)


def kept_products(products: DataFrame) -> DataFrame:
    return products.where((F.col("status") == "active") & ~F.col("vendor").isin(rules.HOUSE_VENDORS))


def shopping_feed(products: DataFrame, variants: DataFrame) -> DataFrame:
    """One feed row per variant; SEO text stands on the first variant of a product."""
    tags, title, kind = F.col("tags"), F.col("title"), F.col("product_type")
    first = variants.groupBy("product_id").agg(F.min_by("variant_id", F.struct("position", "variant_id")).alias("first_id"))
    p = kept_products(products).join(first, "product_id").select(
        "product_id", "handle", "vendor", kind, "first_id",
        F.coalesce(lookup(kind, rules.TYPE_TO_CATEGORY), F.lit("")).alias("category"),
        gender(tags, title).alias("gender"), age_group(tags, title).alias("age_group"), season(tags).alias("season"),
        activity(tags).alias("activity"), seo_title(F.col("vendor"), title).alias("seo_title"),
        seo_description(F.col("vendor"), title, F.col("body_html"), kind).alias("seo_description"),
    )
    size = variant_size(F.col("option1_name"), F.col("option1_value"), F.col("option2_value"))
    v = variants.select(
        "product_id", "variant_id", "price", variant_color(F.col("option1_name"), F.col("option1_value")).alias("color"), size.alias("size")
    )
    is_first = F.col("variant_id") == F.col("first_id")
    seo = lambda c: F.when(is_first, F.col(c)).otherwise(F.lit("")).alias(c)
    return v.join(p, "product_id").select(
        "product_id", "variant_id", "handle", F.lit("MERGE").alias("command"), "category", "gender", "age_group", F.lit("new").alias("condition"),
        "color", "size", size_system(F.col("vendor"), F.col("product_type"), F.col("size")).alias("size_system"),
        "season", price_tier(F.col("price")).alias("price_tier"), "activity", seo("seo_title"), seo("seo_description"),
    )


def feed_coverage(feed: DataFrame) -> DataFrame:
    """Fill counts of the feed (A10)."""
    filled = lambda c: F.count_if(F.col(c) != "").alias(f"has_{c}")
    return feed.agg(
        F.count(F.lit(1)).alias("total_variants"), F.count_distinct("handle").alias("total_products"),
        *[filled(c) for c in ("category", "gender", "age_group", "color", "size", "seo_title", "seo_description")],
    )


def category_buckets(feed: DataFrame) -> DataFrame:
    bucket = F.element_at(F.split("category", " > "), 1)
    return feed.where("category <> ''").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("variants"))


def weight_sheet(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Default weight for every variant of a type that has one (K8)."""
    p = kept_products(products).select("product_id", "handle", "product_type", type_weight_grams(F.col("product_type")).alias("grams"))
    return variants.select("product_id", "variant_id").join(p.where("grams is not null"), "product_id").select(
        "product_id", "variant_id", "handle", "product_type", F.lit("MERGE").alias("command"), "grams"
    )


def weight_counts(sheet: DataFrame) -> DataFrame:
    return sheet.groupBy("product_type").agg(F.count(F.lit(1)).alias("variants"))


def bulky_audit(products: DataFrame, variants: DataFrame) -> DataFrame:
    """Variants of bulky types with a suggested weight; sort by price at the sink (K9)."""
    p = kept_products(products).where(F.col("product_type").isin(rules.BULKY_TYPES)).select(
        "product_id", "handle", "title", "vendor", "product_type", type_weight_grams(F.col("product_type")).alias("suggested_g")
    )
    return variants.select("product_id", "variant_id", "sku", "price").join(p, "product_id")


def alt_text(vendor: Column, title: Column, name: Column, value: Column) -> Column:
    base = F.trim(F.concat_ws(" ", text(vendor), text(title)))
    color = variant_color(name, value)
    return F.when(color != "", F.concat(base, F.lit(" - "), color)).otherwise(base)


def alt_text_rows(products: DataFrame, variants: DataFrame) -> DataFrame:
    """One row per (product, image): the variant first by option value names it."""
    pick = F.min_by(F.struct("option1_name", "option1_value"), F.struct("option1_value", "position", "variant_id"))
    images = variants.where("image_src <> ''").groupBy("product_id", "image_src").agg(pick.alias("o"))
    p = kept_products(products).select("product_id", "handle", "vendor", "title")
    return images.join(p, "product_id").select(
        "product_id", "handle", "image_src",
        alt_text(F.col("vendor"), F.col("title"), F.col("o.option1_name"), F.col("o.option1_value")).alias("alt"),
    )


def feed_exclusions(products: DataFrame, vendors: list[str], types: list[str], rental_vendor_like: str) -> DataFrame:
    """Products kept out of the feed: vendors, rentals that are not for sale, special types."""
    t, k, v = F.lower(F.col("title")), F.lower(text(F.col("product_type"))), F.col("vendor")
    rental = t.contains("rental") & ~t.contains("sale") & ~F.lower(v).like(rental_vendor_like)
    return products.where((F.col("status") == "active") & (v.isin(vendors) | rental | k.isin(types)))


def metafield_rows(feed: DataFrame, fields: dict[str, str], batch: int = 25) -> DataFrame:
    """Long (owner, namespace, key, value) rows of two namespaces with a batch id of at most ``batch``.

    The running number comes from range-partitioned positions, not from one global window.
    """
    entries = F.array(*[
        F.struct(F.lit(ns).alias("namespace"), F.lit(key).alias("key"), F.col(col).alias("value"))
        for ns in ("google_shopping", "mm-google-shopping") for col, key in fields.items()
    ])
    owners = feed.select("product_id", *fields).distinct()
    rows = owners.select("product_id", F.explode(entries).alias("e")).select("product_id", "e.*").where("value <> ''")
    ranked = distributed_rank(rows, [], [F.col("product_id"), F.col("namespace"), F.col("key"), F.col("value")], "_n")
    return ranked.withColumn("batch_id", F.ceil(F.col("_n") / batch)).drop("_n")
