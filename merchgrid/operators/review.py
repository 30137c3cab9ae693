"""Change plans, undo plans, review rows, work batches and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.functions.common import labels, merged, strip, text
from merchgrid.functions.ranking import top_k


def image_diff(current: Column, proposed: Column) -> dict[str, Column]:
    """Kept, added and removed image counts."""
    a, b = F.array_distinct(current), F.array_distinct(proposed)
    return {"kept": F.size(F.array_intersect(a, b)), "added": F.size(F.array_except(b, a)), "removed": F.size(F.array_except(a, b))}


def change_plan(changes: DataFrame) -> DataFrame:
    """What a push would change (M30). Expects current and new body and image arrays."""
    d = image_diff(F.col("current_images"), F.col("new_images"))
    body = text(F.col("new_body_html"))
    return changes.select(
        "handle", ((strip(body) != "") & (body != text(F.col("current_body_html")))).alias("body_changed"), *[c.alias(n) for n, c in d.items()])


def artifact_changes(outputs: DataFrame, selected: DataFrame, products: DataFrame) -> DataFrame:
    """Review changes from run artifacts and the store.

    ``outputs(handle, body_html, source_url, images)``, ``selected(handle, selected_url)``, ``products(handle, title,
    vendor, body_html)``.  Unknown handles are skipped; an output without a source takes the selected URL.
    """
    store = products.select("handle", "title", "vendor", F.col("body_html").alias("current_body_html"))
    url = selected.select("handle", F.col("selected_url").alias("_url"))
    rows = outputs.join(merged(store), "handle").join(merged(url), "handle", "left")
    return rows.select("handle", "title", "vendor", "current_body_html", F.col("body_html").alias("new_body_html"), "images", F.coalesce(F.nullif("source_url", F.lit("")), "_url").alias("source_url"))


def review_rows(changes: DataFrame) -> DataFrame:
    """Reviewable changes with a confidence class and missing-field flags."""
    has_body, has_images = strip(text(F.col("new_body_html"))) != "", F.size("new_images") > 0
    conf = F.col("confidence")
    return changes.where(has_body | has_images).select(
        "handle", F.when(conf >= 80, "high").when(conf >= 60, "medium").otherwise("low").alias("confidence_class"),
        F.array_join(labels((text(F.col("product_type")) == "", "product_type"), (text(F.col("tags")) == "", "tags")), ",").alias("missing_fields"),
        *[c.alias(n) for n, c in image_diff(F.col("current_images"), F.col("new_images")).items()])


def clean_description(c: Column) -> Column:
    """Rating and review counters removed."""
    out = F.regexp_replace(text(c), r"\d+\.\d+\(\d+\)\d+\s*total reviews?", "")
    return strip(F.regexp_replace(out, r"\b\d+\.\d+\s*out of \d+\s*stars?\b", ""))


def undo_plan(manifest: DataFrame, handles: list[str] | None = None) -> DataFrame:
    """Undo actions as long rows (M30): images to delete, bodies and variant images to restore.

    ``manifest(run_id, handle, before_body, before_images array<struct<id, variant_ids>>,
    pushed_body, images_created array<bigint>)``.
    """
    m = manifest.where(F.col("handle").isin(handles)) if handles else manifest
    act = lambda kind, target, value: F.struct(F.lit(kind).alias("action"), target.cast("string").alias("target"), value.alias("value"))
    deletes = F.transform("images_created", lambda i: act("delete_image", i, F.lit("")))
    restores = F.transform(
        F.filter("before_images", lambda i: F.size(i["variant_ids"]) > 0),
        lambda i: act("restore_variants", i["id"], F.array_join(F.transform(i["variant_ids"], lambda v: v.cast("string")), ",")))
    body = F.when(F.col("pushed_body").isNotNull(), F.array(act("restore_body", F.col("handle"), text(F.col("before_body")))))
    actions = F.concat(deletes, restores, F.coalesce(body, F.filter(deletes, lambda x: F.lit(False))))
    return m.select("run_id", "handle", F.explode(actions).alias("a")).select("run_id", "handle", "a.*")


def undo_totals(plan: DataFrame) -> DataFrame:
    """Counters of an undo plan."""
    c = lambda v: F.count_if(F.col("action") == v)
    return plan.groupBy("run_id").agg(
        F.count_distinct("handle").alias("products"), c("delete_image").alias("images_deleted"), c("restore_variants").alias("variants_restored"),
        c("restore_body").alias("bodies_restored"))


def missing_handles(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requested handles the manifest does not know."""
    return wanted.join(merged(manifest.select("handle")), "handle", "left_anti")


def next_batch(scores: DataFrame, tested: DataFrame, configured: DataFrame, blocked: list[str], size: int, per_vendor: int = 3) -> DataFrame:
    """Next work batch (P25): best priorities, untested, configured, few per vendor.

    The per-vendor limit runs per map task first, so a dominant vendor costs three rows a task.
    """
    open_ = (
        scores.where("gap_count > 0").where(~F.col("vendor").isin(blocked)).join(merged(tested.select("handle")), "handle", "left_anti")
        .join(configured.select("vendor"), "vendor", "left_semi")
    )
    capped = top_k(open_, ["vendor"], [F.desc("priority_score"), F.col("product_id")], per_vendor)
    return capped.orderBy(F.desc("priority_score"), "product_id").limit(size)


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows not yet in earlier reports."""
    return todo.join(merged(done.select(*keys).distinct()), keys, "left_anti")


SKIPS = ["SKIPPED_NO_GAPS", "SKIPPED_VENDOR_NOT_CONFIGURED", "SKIPPED_AMBIGUOUS"]


def run_summary(results: DataFrame) -> DataFrame:
    """Rows per status, the skip statuses folded."""
    folded = F.when(F.col("status").isin(SKIPS), "SKIPPED").otherwise(F.col("status"))
    return results.groupBy(folded.alias("status")).agg(F.count(F.lit(1)).alias("rows"))


def regression_check(rescored: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rescored winner against the recorded one (J21): passed, regressed or skipped."""
    best = rescored.groupBy("product_id").agg(F.min_by("url", F.struct(-F.col("confidence"), F.col("ord"))).alias("winner"))
    j = recorded.join(merged(best), "product_id", "left")
    verdict = F.when(text(F.col("final_url")) == "", "skipped").when(F.col("winner").isNull(), "skipped").when(
        F.col("winner") == F.col("final_url"), "passed").otherwise("regressed")
    return j.select("product_id", "final_url", text(F.col("winner")).alias("winner"), verdict.alias("verdict"))


def mismatch_vendors(verdicts: DataFrame, k: int = 10) -> DataFrame:
    """Vendors with most image mismatches."""
    return verdicts.where("verdict = 'mismatch'").groupBy("vendor").agg(F.count(F.lit(1)).alias("mismatches")).orderBy(F.desc("mismatches"), "vendor").limit(k)


def payoff_rows(priority_csv: DataFrame) -> DataFrame:
    """Typed dashboard rows from the priority CSV."""
    yes = lambda c: F.lower(text(F.col(c))) == "true"
    gaps = F.filter(F.transform(F.split(text(F.col("Gaps")), ","), strip), lambda g: g != "")
    return priority_csv.select(
        F.col("Product Handle").alias("handle"), F.col("Vendor").alias("vendor"), F.col("Title").alias("title"),
        F.coalesce(F.col("Priority Score").try_cast("double"), F.lit(0.0)).alias("priority"), yes("Has Image").alias("has_image"),
        yes("Has Variant Images").alias("has_variant_images"), yes("Has Description").alias("has_description"), yes("Has Product Type").alias("has_product_type"),
        yes("Has Tags").alias("has_tags"), gaps.alias("gaps"), F.col("Suggestions").alias("suggestions"),
        F.col("Sessions").alias("sessions"), F.col("Online Revenue").alias("revenue"))
