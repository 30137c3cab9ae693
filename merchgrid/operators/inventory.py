"""Inventory and sales roll-ups per product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inventory_rollup(levels: DataFrame) -> DataFrame:
    """Units, value and full-price value per product, with units by location (A1)."""
    value = F.col("qty") * F.col("cost")
    by_loc = levels.groupBy("product_id", "location").agg(
        F.sum("qty").alias("qty"),
        F.sum(value).alias("value"),
        F.sum(F.when(~F.col("on_sale"), value).otherwise(F.lit(0.0))).alias("full_price_value"),
    )
    return by_loc.groupBy("product_id").agg(
        F.sum("qty").alias("total"),
        F.sum("value").alias("value"),
        F.sum("full_price_value").alias("full_price_value"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("location", "qty")))).alias("by_location"),
    )


def inventory_totals(levels: DataFrame) -> DataFrame:
    """The same without the location map: one shuffle."""
    value = F.col("qty") * F.col("cost")
    return levels.groupBy("product_id").agg(
        F.sum("qty").alias("total"),
        F.sum(value).alias("value"),
        F.sum(F.when(~F.col("on_sale"), value).otherwise(F.lit(0.0))).alias("full_price_value"),
    )


def sales_velocity(lines: DataFrame, reference, days: int = 28) -> DataFrame:
    """Units and weekly average over the trailing window (A2)."""
    return lines.where(F.col("sold_at") > reference - F.make_dt_interval(F.lit(days))).groupBy("product_id").agg(F.sum("units").alias("units")).withColumn(
        "weekly_avg", F.col("units") / F.lit(days / 7.0)
    )
