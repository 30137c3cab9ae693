"""Product typing and tagging from rule tables, and the change queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.functions.common import first_rule, lookup, strip, text
from merchgrid.rules import catalog as rules

SOURCE = "taxonomy_map"


def category_leaf(category: Column) -> Column:
    return strip(F.element_at(F.split(F.lower(strip(text(category))), " > "), -1))


def assigned_type(current: Column, category: Column, vendor: Column, title: Column) -> Column:
    """Type by priority: existing type, category leaf, vendor, first title rule."""
    cur = strip(text(current))
    known = F.when(cur != "", F.coalesce(lookup(cur, rules.OLD_TYPE_TO_TYPE), cur))
    heading = F.lower(F.concat_ws(" ", text(vendor), text(title)))
    return F.coalesce(
        known, lookup(category_leaf(category), rules.CATEGORY_LEAF_TO_TYPE), lookup(vendor, rules.VENDOR_TO_TYPE),
        first_rule(heading, rules.TITLE_TYPE_RULES), F.lit(""),
    )


def assigned_tags(kind: Column, category: Column, title: Column, gender: Column) -> Column:
    """Ordered tag list: activity, gender, season, features, type group."""
    low = F.lower(text(title))
    none = F.array().cast("array<string>")
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(none)
    path = F.lower(text(category))
    by_path = F.coalesce(*[F.when(path.contains(s), F.lit(t)) for s, t in rules.ACTIVITY_PATH_RULES])
    by_type = none
    for t, tags in rules.ACTIVITY_FROM_TYPE.items():
        by_type = F.when(kind == t, F.array(*[F.lit(x) for x in tags])).otherwise(by_type)
    activity = F.when(by_path.isNotNull(), F.array(by_path)).otherwise(by_type)
    named = first_rule(low, rules.TITLE_GENDER_TAG_RULES)
    soft = F.when(kind.isin(rules.SOFT_TYPES), F.coalesce(lookup(text(gender), rules.GENDER_TO_TAG), F.lit("gender:mens")))
    season = F.when(kind.isin(rules.WINTER_TYPES), "season:winter").when(kind.isin(rules.SUMMER_TYPES), "season:summer")
    features = F.array_compact(F.array(*[
        F.when(low.rlike(p) & (F.lit(tag not in rules.CONTEXT_TAGS) | kind.isin(rules.CONTEXT_TYPES)), F.lit(tag))
        for p, tag in rules.FEATURE_RULES
    ]))
    return F.concat(activity, one(F.coalesce(named, soft)), one(season), features, one(lookup(kind, rules.TYPE_TO_GROUP)))


def split_tags(tags: Column) -> Column:
    return F.filter(F.transform(F.split(text(tags), ","), strip), lambda t: t != "")


def assign_taxonomy(products: DataFrame) -> DataFrame:
    """One row per handle outside the house vendors.

    Expects ``category`` and ``gender``; of several rows with one handle the first
    with a category counts.
    """
    kept = products.where(~F.col("vendor").isin(rules.HOUSE_VENDORS))
    row = F.struct("title", "vendor", "product_type", "tags", "category", "gender")
    first = kept.groupBy("handle").agg(F.min_by(row, F.struct((text(F.col("category")) == "").cast("int"), F.col("product_id"))).alias("r"))
    p = first.select("handle", "r.*")
    typed = p.withColumn("new_type", assigned_type(F.col("product_type"), F.col("category"), F.col("vendor"), F.col("title")))
    return typed.select(
        "handle", "title", "vendor", strip(text(F.col("product_type"))).alias("current_type"), text(F.col("tags")).alias("current_tags"),
        text(F.col("category")).alias("category"), "new_type",
        F.array_join(assigned_tags(F.col("new_type"), F.col("category"), F.col("title"), F.col("gender")), ", ").alias("new_tags"),
    )


def update_queue(mapping: DataFrame, replace_tags: bool = False) -> DataFrame:
    """Pending type and tag changes (K11, O3): write it over the partition of its source."""
    merged = F.when(F.lit(replace_tags), F.col("new_tags")).otherwise(
        # Existing tags stay as they are, duplicates included; only unseen new ones are appended.
        F.array_join(
            F.concat(
                split_tags(F.col("current_tags")),
                F.array_except(split_tags(F.col("new_tags")), split_tags(F.col("current_tags"))),
            ),
            ", ",
        )
    )
    change = lambda field, old, new: F.struct(F.lit(field).alias("field"), old.alias("old_value"), new.alias("new_value"))
    kind = F.when((F.col("new_type") != "") & (F.col("new_type") != F.col("current_type")), change("product_type", F.col("current_type"), F.col("new_type")))
    tags = F.when((F.col("new_tags") != "") & (merged != F.col("current_tags")), change("tags", F.col("current_tags"), merged))
    return mapping.select("handle", F.explode(F.array_compact(F.array(kind, tags))).alias("c")).select(
        "handle", "c.*", F.lit(SOURCE).alias("source"), F.lit("pending").alias("status")
    )


# -- the simpler tagger ------------------------------------------------------
TAGGER_TYPES = [
    (r"\bring\b(?!\s+binder)", "Ring"), (r"\bhot\s+rod\b", "Heated Part"), (r"\brod\b", "Bar Stock"), (r"\bbolts?\b", "Fastener"),
    (r"\bplate\b", "Sheet Stock"), (r"\bgear\b", "Gear"), (r"\banvil\b", "Anvil"), (r"\bwidget\b", "Widget"),
]
TAGGER_TAGS = {
    "gender:womens": [r"\bwomen'?s\b", r"\bladies\b"], "gender:mens": [r"\bmen'?s\b"], "gender:kids": [r"\bkids?\b", r"\byouth\b"],
    "activity:forging": [r"\banvil\b", r"\bhot\b"], "activity:cooling": [r"\bcold\b"], "activity:assembly": [r"\bbolts?\b", r"\bring\b"],
}


def infer_tags(products: DataFrame) -> DataFrame:
    """Type and new tags from name and description."""
    body = F.lower(F.concat_ws(" ", text(F.col("title")), text(F.col("body_html"))))
    existing = F.transform(split_tags(F.col("tags")), F.lower)
    hits = F.array_compact(F.array(*[
        F.when(body.rlike("|".join(f"(?:{p})" for p in pats)), F.lit(tag)) for tag, pats in TAGGER_TAGS.items()
    ]))
    return products.select(
        "product_id", F.coalesce(first_rule(body, TAGGER_TYPES), F.lit("")).alias("inferred_type"),
        F.array_except(hits, existing).alias("new_tags"),
    )
