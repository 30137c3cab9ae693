"""Coverage of the top-N work list under a weight vector, and sweeps over vectors."""

from __future__ import annotations

import random
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merchgrid.functions.common import ratio
from merchgrid.operators.audit import WEIGHT_BOUNDS, Weights, priority
from merchgrid.session import durable


def _composite(vl: Column, vc: Column, ic: Column, ta: Column) -> Column:
    return 0.30 * vl + 0.20 * vc + 0.25 * ic + 0.25 * ta


def _part(prefix: str, cond: Column) -> list[Column]:
    traffic = F.col("online_sessions") + F.col("listing_impressions")
    pick = lambda c: F.coalesce(F.sum(F.when(cond, c)), F.lit(0))
    return [
        pick(F.col("variants_missing_images")).alias(f"{prefix}_missing"),
        pick(F.col("inventory_value")).alias(f"{prefix}_inventory"),
        pick(traffic).alias(f"{prefix}_traffic"),
    ]


def _components(df: DataFrame, keep: list[str]) -> DataFrame:
    vl = ratio(F.col("top_missing"), F.col("all_missing"))
    vc = F.when(F.col("top_count") > 0, 1.0 - ratio(F.col("top_vendors"), F.col("top_count"))).otherwise(F.lit(0.0))
    ic = ratio(F.col("top_inventory"), F.col("all_inventory"))
    ta = ratio(F.col("top_traffic"), F.col("all_traffic"))
    return df.select(
        *keep, vl.alias("variant_leverage"), vc.alias("vendor_concentration"), ic.alias("inventory_coverage"),
        ta.alias("traffic_alignment"), _composite(vl, vc, ic, ta).alias("composite"), "top_count",
    )


def ranked_handles(scores: DataFrame, weights: Weights = Weights(), limit: int | None = None) -> DataFrame:
    """Handles with a positive priority, best first."""
    out = scores.select("handle", "product_id", priority(weights.columns()).alias("priority")).where("priority > 0")
    out = out.orderBy(F.desc("priority"), "product_id")
    return out.limit(limit) if limit else out


def weight_grid(seed: int, per_transform: int) -> list[tuple[int, Weights]]:
    """Seeded random vectors inside the bounds for every inventory transform; id 0 is the default."""
    rng = random.Random(seed)
    grid = [(0, Weights())]
    for transform in ("linear", "log", "sqrt"):
        for _ in range(per_transform):
            vals = {k: round(rng.uniform(lo, hi), 6) for k, (lo, hi) in WEIGHT_BOUNDS.items()}
            grid.append((len(grid), replace(Weights(inventory_transform=transform), **vals)))
    return grid


def sweep(scores: DataFrame, grid: list[tuple[int, Weights]], top_n: int = 50) -> DataFrame:
    """Coverage per weight vector (M3, M4): one job over the snapshot.

    Each product row is expanded to the literal vectors (their number is the caller's
    parameter).  The top-N rank limit runs per map task before the shuffle; totals are
    map-side combined, so no weight id gathers its products in one task.
    """
    vectors = F.array(*[
        F.struct(F.lit(i).alias("weight_id"), *[F.lit(v).alias(k) for k, v in asdict(w).items()]) for i, w in grid
    ])
    # totals and the top rows read the same snapshot: the audit is planned and run once
    slim = durable(scores.select(
        "product_id", "vendor", "variants_missing_images", "variant_count", "inventory_value", "full_price_inventory_value",
        "online_sessions", "opportunity_gap", "listing_impressions", "discovery_gap", "listing_disapproved",
        "has_product_image", "has_all_variant_images", "has_description", "has_product_type", "has_tags",
    ))
    wide = slim.select("*", F.explode(vectors).alias("w")).select(
        "product_id", "vendor", "variants_missing_images", "inventory_value", "online_sessions", "listing_impressions",
        F.col("w.weight_id").alias("weight_id"), priority({k: F.col(f"w.{k}") for k in asdict(Weights())}).alias("p"),
    ).where("p > 0")
    totals = wide.groupBy("weight_id").agg(*_part("all", F.lit(True)))
    w = Window.partitionBy("weight_id").orderBy(F.desc("p"), "product_id")
    top = wide.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top_n).groupBy("weight_id").agg(
        *_part("top", F.lit(True)), F.count_distinct("vendor").alias("top_vendors"), F.count(F.lit(1)).alias("top_count")
    )
    return _components(totals.join(top, "weight_id"), ["weight_id"])


def coverage(scores: DataFrame, weights: Weights = Weights(), top_n: int = 50) -> DataFrame:
    """Coverage components of one vector."""
    return sweep(scores, [(0, weights)], top_n).drop("weight_id")


def best_vector(swept: DataFrame) -> DataFrame:
    """Best vector against the default (id 0); the lower id wins a tie."""
    return swept.agg(
        F.max_by("weight_id", F.struct("composite", -F.col("weight_id"))).alias("best_id"),
        F.max("composite").alias("best_efficiency"),
        F.max(F.when(F.col("weight_id") == 0, F.col("composite"))).alias("baseline_efficiency"),
    ).withColumn("improvement", F.col("best_efficiency") - F.col("baseline_efficiency"))


def top_vendors(scores: DataFrame, weights: Weights = Weights(), top_n: int = 50, vendors: int = 10) -> DataFrame:
    """Vendors of the top-N list by count."""
    top = scores.withColumn("p", priority(weights.columns())).where("p > 0").orderBy(F.desc("p"), "product_id").limit(top_n)
    return top.groupBy("vendor").agg(F.count(F.lit(1)).alias("products")).orderBy(F.desc("products"), "vendor").limit(vendors)
