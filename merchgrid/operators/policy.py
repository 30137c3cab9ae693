"""Listing policy: barcode check digits, title rules, prohibited terms, required attributes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.functions.common import add_all, labels, strip, text

MAX_TITLE = 150
# Fixed value: patterns the listing policy rejects and their message.
PROHIBITED = [
    (r"\bfree shipping\b", "Promotional: 'free shipping'"),
    (r"\bbuy now\b", "Promotional: 'buy now'"),
    (r"\bon sale\b", "Promotional: 'on sale'"),
    (r"\blimited time\b", "Promotional: 'limited time'"),
    (r"\bwhile supplies last\b", "Promotional: 'while supplies last'"),
    (r"\bbest\b", "Superlative: 'best'"),
    (r"\bcheapest\b", "Superlative: 'cheapest'"),
    (r"\b(?:incredible|amazing|unbelievable)\b", "Superlative: exaggerated claim"),
    (r"\b(?:premium|superior|ultimate)\b", "Marketing superlative"),
    (r"\$\d+", "Price mention in description"),
    (r"\bguarantee\b", "Unsubstantiated guarantee claim"),
    (r"\b#\d+\s*(?:rated|selling|choice)\b", "Ranking claim"),
]
# Fixed value: attributes every listing needs.
REQUIRED = {"title": "Product title", "body_html": "Product description", "image": "Product image", "price": "Product price"}


def valid_gtin(code: Column) -> Column:
    """Check digit of an 8/12/13/14-digit code; all zeros are a placeholder."""
    shaped = code.rlike(r"^(\d{8}|\d{12,14})$") & ~code.rlike("^0+$")
    # Left-padded to 14 digits the weights are 3,1,3,1,... from the left.
    padded = F.lpad(code, 14, "0")
    digit = lambda i: F.coalesce(F.substring(padded, i, 1).try_cast("int"), F.lit(0))
    total = add_all(*[digit(i) * (3 if i % 2 else 1) for i in range(1, 14)])
    return F.coalesce(shaped & ((10 - total % 10) % 10 == digit(14)), F.lit(False))


def title_violations(title: Column) -> Column:
    """Title problems in rule order."""
    empty = strip(text(title)) == ""
    size = F.length(title)
    found = labels(
        (size > MAX_TITLE, F.concat(F.lit(f"Title exceeds {MAX_TITLE} characters ("), size.cast("string"), F.lit(")"))),
        ((title == F.upper(title)) & (size > 10), "Title is all caps (GMC may flag as spammy)"),
        (title.rlike("[!]{2,}|[?]{2,}"), "Title contains excessive punctuation"),
    )
    return F.when(empty, F.array(F.lit("Title is empty"))).otherwise(found)


def structured_title(brand: Column, kind: Column, gender: Column, color: Column, size: Column) -> Column:
    """Brand, type and '- attribute' parts, cut at a word below the title limit."""
    dash = lambda c: F.when(text(c) != "", F.concat(F.lit("- "), c))
    full = F.concat_ws(" ", F.nullif(text(brand), F.lit("")), F.nullif(text(kind), F.lit("")), dash(gender), dash(color), dash(size))
    cut = F.concat(F.regexp_replace(F.left(full, F.lit(MAX_TITLE - 3)), r"\s[^\s]*$", ""), F.lit("..."))
    return F.when(F.length(full) > MAX_TITLE, cut).otherwise(full)


def prohibited_terms(body: Column) -> Column:
    low = text(body)
    return labels(*[(low.rlike("(?iU)" + p), msg) for p, msg in PROHIBITED])


def missing_attributes(df: DataFrame) -> Column:
    """Labels of required columns that are null, zero or blank."""
    def absent(name: str) -> Column:
        c = F.col(name)
        if dict(df.dtypes)[name] == "string":
            return strip(text(c)) == ""
        return F.coalesce(c, F.lit(0)) == 0

    return labels(*[(absent(k), f"Missing required attribute: {v}") for k, v in REQUIRED.items()])


def gtin_quality(variants: DataFrame, products: DataFrame) -> DataFrame:
    """Barcode validity per vendor over all variants."""
    coded = variants.where("barcode <> ''").withColumn("ok", valid_gtin(F.col("barcode")))
    per_product = coded.groupBy("product_id").agg(F.count(F.lit(1)).alias("coded"), F.count_if(~F.col("ok")).alias("invalid"))
    return per_product.join(products.select("product_id", "vendor"), "product_id").groupBy("vendor").agg(
        F.sum("coded").alias("coded"), F.sum("invalid").alias("invalid")
    )


def output_flags(outputs: DataFrame) -> DataFrame:
    """Policy flags of a generated output: prohibited terms of the body, then title problems."""
    none = F.array().cast("array<string>")
    body = F.when(text(F.col("body_html")) != "", prohibited_terms(F.col("body_html"))).otherwise(none)
    title = F.when(text(F.col("title")) != "", title_violations(F.col("title"))).otherwise(none)
    return outputs.withColumn("policy_flags", F.concat(body, title))
