"""Collection ranking: normalised factor score, overrides and pinned slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from merchgrid.functions.common import add_all, clamp, half_up, labels, ratio
from merchgrid.functions.ranking import distributed_rank
from merchgrid.rules import catalog as rules
from merchgrid.session import durable

NO_SALES_WEEKS = 999.0  # sentinel: weeks of supply without sales
NO_DATE_DAYS = 999      # sentinel: age without a creation date


def margin_stats(variants: DataFrame) -> DataFrame:
    """Margin percent per product; the price sum is divided by the count of costed variants (A4)."""
    cost, price = F.coalesce("cost", F.lit(0.0)), F.coalesce("price", F.lit(0.0))
    sums = variants.groupBy("product_id").agg(
        F.sum(F.when(cost > 0, cost).otherwise(0.0)).alias("c"),
        F.sum(F.when(price > 0, price).otherwise(0.0)).alias("p"),
        F.count_if(cost > 0).alias("n"),
    )
    avg_price, avg_cost = ratio(F.col("p"), F.col("n")), ratio(F.col("c"), F.col("n"))
    return sums.select("product_id", (ratio(avg_price - avg_cost, avg_price) * 100.0).alias("margin_pct"))


def age_days(created: Column, reference: Column) -> Column:
    """Whole elapsed days, floored; the sentinel when there is no date."""
    days = F.floor((F.unix_seconds(reference) - F.unix_seconds(created)) / 86400)
    return F.coalesce(days, F.lit(NO_DATE_DAYS))


def rank_metrics(members: DataFrame, variants: DataFrame, velocity: DataFrame, inventory: DataFrame,
                 overrides: DataFrame, reference: Column) -> DataFrame:
    """Raw ranking metrics and overrides per member product."""
    weekly = half_up(F.coalesce("weekly_avg", F.lit(0.0)), 2)
    raw_weekly = F.coalesce("weekly_avg", F.lit(0.0))
    stock = F.coalesce("total", F.lit(0))
    weeks = F.when(raw_weekly > 0, half_up(ratio(stock, raw_weekly), 1)).otherwise(F.lit(NO_SALES_WEEKS))
    return (
        members.join(margin_stats(variants), "product_id", "left")
        .join(velocity.select("product_id", "weekly_avg"), "product_id", "left")
        .join(inventory.select("product_id", "total"), "product_id", "left")
        .join(overrides.select("handle", "pin", "boost", "bury"), "handle", "left")
        .select(
            *members.columns,
            weekly.alias("weekly_units"),
            half_up(F.coalesce("margin_pct", F.lit(0.0)), 1).alias("margin_pct"),
            stock.alias("total_inventory"),
            weeks.alias("weeks_of_supply"),
            age_days(F.col("created_at"), reference).alias("days_old"),
            F.col("pin"),
            F.coalesce("boost", F.lit(0.0)).alias("boost"),
            F.coalesce("bury", F.lit(False)).alias("bury"),
        )
    )


def score(metrics: DataFrame, group: str) -> DataFrame:
    """Weighted score after normalising by the group's maxima.

    The maxima are aggregated (map-side combined) and joined back, so no window
    holds a whole group.
    """
    nonzero = lambda c: F.when(F.max(c) == 0, F.lit(1.0)).otherwise(F.max(c))
    maxima = metrics.groupBy(group).agg(nonzero("weekly_units").alias("max_v"), nonzero("margin_pct").alias("max_m"))
    wos, age, w = F.col("weeks_of_supply"), F.col("days_old"), rules.RANK_WEIGHTS
    health = (
        F.when(wos.between(3, 12), 1.0).when(wos < 3, 0.3).when(wos <= 20, 0.6).otherwise(0.2)
    )
    fresh = F.when(age <= rules.NEW_ARRIVAL_DAYS, 1.0 - age / F.lit(float(rules.NEW_ARRIVAL_DAYS))).otherwise(0.0)
    low = F.when(F.col("total_inventory") < rules.LOW_STOCK, -1.0).otherwise(0.0)
    parts = metrics.join(maxima, group).select(
        *metrics.columns,
        ratio(F.col("weekly_units"), F.col("max_v")).alias("velocity_score"),
        clamp(ratio(F.col("margin_pct"), F.col("max_m")), 0.0, 1.0).alias("margin_score"),
        health.alias("inventory_score"), fresh.alias("new_arrival"), low.alias("low_stock"),
    )
    total = add_all(
        F.col("velocity_score") * w["velocity"], F.col("margin_score") * w["margin"], F.col("inventory_score") * w["inventory"],
        F.col("new_arrival") * w["new_arrival"], F.col("low_stock") * w["low_stock"], F.col("boost"),
    )
    return parts.withColumn("total_score", F.when(F.col("bury"), F.lit(-999.0)).otherwise(total))


def notes() -> Column:
    """Remarks of a ranked row (K4)."""
    return F.array_join(labels(
        (F.col("pin").isNotNull(), F.concat(F.lit("pinned #"), F.col("pin").cast("string"))),
        (F.col("boost") > 0, "boosted"),
        (F.col("bury"), "buried"),
        (F.col("days_old") <= rules.NEW_ARRIVAL_DAYS, "new"),
        (F.col("total_inventory") < rules.LOW_STOCK, "low stock"),
    ), ", ")


def assign_slots(scored: DataFrame, group: str, tie: str = "product_id", strict_pins: bool = False) -> DataFrame:
    """Final rank with pins.

    A valid pin (1..n, the last row of a duplicate pin) takes its slot; the k-th
    unpinned product takes the k-th free slot.  With the pins sorted, the j-th pin p
    precedes the k-th unpinned product exactly when p - (j - 1) <= k, so merging pins
    keyed by p - (j - 1) with unpinned rows keyed by k yields the slot as the position
    in the merged order (a pin keeps its own slot, earlier free slots may stay empty).
    Pins outside 1..n and overridden duplicates keep rank 0, or
    are ranked by score with ``strict_pins``.

    Positions come from range-partitioned ranks, so no group meets one task.  The scored
    rows are written once and read by every step.
    """
    scored = durable(scored)

    def position(df: DataFrame, order: list, out: str) -> DataFrame:
        return distributed_rank(df, [group], order, out)

    sizes = scored.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    pins = (
        scored.where("pin is not null").join(sizes, group).where("pin between 1 and _n")
        .groupBy(group, "pin").agg(F.max(tie).alias(tie))
    )
    pinned = position(pins, [F.col("pin")], "_j").select(
        group, tie, F.col("pin").cast("bigint").alias("_slot"), (F.col("pin") - F.col("_j") + 1).cast("bigint").alias("_key")
    )
    if strict_pins:
        free = scored.join(pinned.select(group, tie), [group, tie], "left_anti")
    else:
        free = scored.where("pin is null")
    ranked = position(free.select(group, tie, "total_score"), [F.desc("total_score"), F.col(tie)], "_key")
    merged = position(
        ranked.select(group, tie, F.col("_key").cast("bigint").alias("_key"), F.lit(1).alias("_kind"), F.lit(0).cast("bigint").alias("_slot"))
        .unionByName(pinned.select(group, tie, "_key", F.lit(0).alias("_kind"), "_slot")),
        [F.col("_key"), F.col("_kind"), F.col("_slot"), F.col(tie)], "_rank",
    ).select(group, tie, F.when(F.col("_kind") == 0, F.col("_slot")).otherwise(F.col("_rank")).cast("bigint").alias("rank"))
    return scored.join(merged, [group, tie], "left").fillna({"rank": 0})


def rank_collections(members: DataFrame, variants, velocity, inventory, overrides, reference: Column,
                     group: str = "collection", limit: int | None = None) -> DataFrame:
    """Rank every collection in one job (M7).

    Whole collections are scored and ranked; ``limit`` returns the first ranks only (pins
    that are out of range, rank 0, included).
    """
    ranked = assign_slots(score(rank_metrics(members, variants, velocity, inventory, overrides, reference), group), group)
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)
