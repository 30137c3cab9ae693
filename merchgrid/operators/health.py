"""Catalog health: description quality, title coherence and overall severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.functions.common import squeeze, strip, text

MIN_TEXT = 50
# Fixed value: phrases of a placeholder description.
BOILERPLATE = [
    r"buy\s+locally", r"visit\s+us", r"contact\s+(your\s+)?(local\s+)?dealer", r"description\s+coming\s+soon",
    r"check\s+with\s+your\s+local", r"available\s+at\s+your\s+(local|nearest)", r"see\s+in\s+store",
    r"call\s+for\s+(pricing|availability)",
]
BOILERPLATE_RE = "(?i)(" + "|".join(BOILERPLATE) + ")"
# Fixed value: words that say nothing about the product.
IGNORED_WORDS = [
    "the", "a", "an", "and", "or", "of", "for", "in", "on", "to", "with", "men's", "mens", "women's", "womens",
    "unisex", "kid's", "kids", "youth", "junior", "adult",
]


def plain_text(html: Column) -> Column:
    """Tags and entities to blanks, whitespace collapsed."""
    return squeeze(F.regexp_replace(F.regexp_replace(text(html), "<[^>]+>", " "), r"&\w+;", " "))


def description_reason(html: Column, title: Column) -> Column:
    """'' for a usable description, else why it is empty or weak."""
    body = plain_text(html)
    name = plain_text(title)
    hit = F.regexp_extract(body, BOILERPLATE_RE, 0)
    return (
        F.when(strip(text(html)) == "", F.lit("No description"))
        .when((name != "") & (F.lower(body) == F.lower(name)), F.lit("Title repeated as description"))
        .when(F.length(body) < MIN_TEXT, F.concat(F.lit("Too short ("), F.length(body).cast("string"), F.lit(" chars)")))
        .when(hit != "", F.concat(F.lit("Boilerplate: '"), hit, F.lit("'")))
        .otherwise(F.lit(""))
    )


def description_quality(reason: Column) -> Column:
    return F.when(reason == "No description", "empty").when(reason != "", "weak").otherwise("ok")


def check_words(title: Column, product_type: Column) -> Column:
    """Distinct meaningful words of title and type, longer than three characters."""
    words = F.split(F.lower(F.concat_ws(" ", text(title), text(product_type))), r"\s+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(IGNORED_WORDS)))


def stem(w: Column) -> Column:
    return F.left(w, F.greatest(F.lit(4), F.length(w) - 1))


def coherent(title: Column, product_type: Column, html: Column) -> Column:
    """Whether the description has a title/type word or a word of the same stem."""
    words = check_words(title, product_type)
    body = F.lower(plain_text(html))
    # Distinct words first: the stem test is per word pair inside one row.
    tokens = F.filter(F.array_distinct(F.regexp_extract_all(body, F.lit(r"([a-z']+)"), 1)), lambda d: F.length(d) > 3)
    found = F.exists(
        words,
        lambda w: body.contains(w) | F.exists(tokens, lambda d: d.startswith(stem(w)) | w.startswith(stem(d))),
    )
    return (strip(text(html)) == "") | (F.size(words) == 0) | found


def image_verdict(match: Column, kind: Column, has_image: Column) -> Column:
    """Verdict from a table of image labels."""
    return (
        F.when(~has_image, "no_image").when(match.isNull(), "error").when(match == "no", "mismatch").otherwise(kind)
    )


def severity(verdict: Column, quality: Column, coherence: Column) -> Column:
    return (
        F.when((verdict == "mismatch") | (coherence == "mismatch"), "FAIL")
        .when(verdict.isin("lifestyle", "placeholder", "no_image", "error"), "WARN")
        .when(quality.isin("weak", "empty"), "WARN")
        .otherwise("OK")
    )


def hero_images(images: DataFrame) -> DataFrame:
    """First product-level image by position."""
    return images.where("variant_id is null").groupBy("product_id").agg(
        F.min_by("src", F.struct("position", "src")).alias("hero_image_url")
    )


def health_report(products: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """Health row per active product (M6); ``verdicts(product_id, image_verdict)`` is optional."""
    rows = products.where(F.col("status") == "active")
    if verdicts is not None:
        rows = rows.join(verdicts, "product_id", "left")
    verdict = F.coalesce("image_verdict", F.lit("skipped")) if verdicts is not None else F.lit("skipped")
    staged = rows.select(
        "product_id", "vendor", "handle", "title", "product_type", verdict.alias("image_verdict"),
        description_reason(F.col("body_html"), F.col("title")).alias("reason"),
        F.when(coherent(F.col("title"), F.col("product_type"), F.col("body_html")), "ok").otherwise("mismatch").alias("coherence"),
        check_words(F.col("title"), F.col("product_type")).alias("_words"),
    )
    image_note = (
        F.when(F.col("image_verdict") == "mismatch", "Hero image doesn't match product")
        .when(F.col("image_verdict") == "lifestyle", "Hero image is a lifestyle shot")
        .when(F.col("image_verdict") == "placeholder", "Hero image is a placeholder")
    )
    word_note = F.when(
        F.col("coherence") == "mismatch",
        F.concat(F.lit("No title/type words found in description. Expected one of: "), F.array_join(F.array_sort("_words"), ", ")),
    )
    quality = description_quality(F.col("reason"))
    return staged.select(
        "product_id", "vendor", "handle", "title", "product_type", "image_verdict", quality.alias("description_quality"),
        "coherence", severity(F.col("image_verdict"), quality, F.col("coherence")).alias("severity"),
        F.concat_ws("; ", image_note, F.nullif("reason", F.lit("")), word_note).alias("notes"),
    )
