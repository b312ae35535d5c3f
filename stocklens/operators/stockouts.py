"""Stockout impact, timing and causes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.expr import DateLike, fractional_days, money, pct, round_to, whole_days
from stocklens.operators.sales import months_back
from stocklens.sources.tables import Tables

# Severity points per event and per day out of stock.
POINTS_PER_EVENT, POINTS_PER_DAY = 30, 10


def _now(t: Tables, as_of: DateLike) -> Column:
    if as_of is not None:
        return F.lit(str(as_of)).cast("timestamp_ntz")
    start = F.col("stockout_start_date").cast("timestamp_ntz")
    return t("stockout_events", "stockout_start_date").agg(F.max(start)).scalar()


def _severity(events: Column, days: Column, lost: Column) -> Column:
    return events * POINTS_PER_EVENT + days * POINTS_PER_DAY + lost.cast("double") / 100


def stockout_impact_sql(t: Tables, as_of: DateLike = None, limit: int = 50, months: int = 12) -> DataFrame:
    """The worst warehouse-product pairs of the last months; open events last until now."""
    now = _now(t, as_of)
    start = F.col("stockout_start_date").cast("timestamp_ntz")
    end = F.coalesce(F.col("stockout_end_date").cast("timestamp_ntz"), now)
    sums = (
        t(
            "stockout_events", "warehouse_id", "product_id", "stockout_start_date", "stockout_end_date",
            "demand_during_stockout", "lost_sales_amount",
        )
        .filter(start.cast("date") >= months_back(now.cast("date"), months))
        .groupBy("warehouse_id", "product_id")
        .agg(
            F.count("*").alias("stockout_count"),
            F.sum("demand_during_stockout").alias("lost_units"),
            F.sum("lost_sales_amount").alias("lost"),
            F.avg(fractional_days(end, start)).alias("days"),
            F.max(start).alias("last_stockout_date"),
        )
    )
    lost = F.coalesce("lost", F.lit(0))
    return (
        sums.join(t("warehouses", "warehouse_id", "warehouse_code"), "warehouse_id")
        .join(t("products", "product_id", "sku", "product_name", "category_id"), "product_id")
        .join(t("product_categories", "category_id", "category_name"), "category_id", "left")
        .select(
            "warehouse_code",
            "sku",
            "product_name",
            "category_name",
            "stockout_count",
            round_to("days", 1).alias("avg_stockout_duration_days"),
            "lost_units",
            money("lost").alias("lost_revenue"),
            "last_stockout_date",
            round_to(_severity(F.col("stockout_count"), F.col("days"), lost), 0).alias("severity_score"),
        )
        .orderBy(F.desc("severity_score"), "warehouse_code", "sku")
        .limit(limit)
    )


def stockouts_by_weekday(t: Tables, as_of: DateLike = None, months: int = 12) -> DataFrame:
    """Events and lost revenue per weekday, Sunday = 0."""
    day = F.col("stockout_start_date").cast("date")
    return (
        t("stockout_events", "stockout_start_date", "lost_sales_amount")
        .filter(day >= months_back(_now(t, as_of).cast("date"), months))
        .groupBy(F.date_format(day, "EEEE").alias("day_of_week"), (F.dayofweek(day) - 1).alias("dow_num"))
        .agg(F.count("*").alias("stockout_count"), F.sum("lost_sales_amount").alias("lost_revenue"))
        .orderBy("dow_num")
    )


def stockout_impact(t: Tables) -> DataFrame:
    """Impact per warehouse and product over all time; open events have no duration."""
    sums = (
        t(
            "stockout_events", "stockout_id", "warehouse_id", "product_id", "stockout_start_date",
            "stockout_end_date", "demand_during_stockout", "lost_sales_amount",
        )
        .withColumn("duration_days", whole_days("stockout_end_date", "stockout_start_date"))
        .groupBy("warehouse_id", "product_id")
        .agg(
            F.count("stockout_id").alias("stockout_count"),
            F.avg("duration_days").alias("days"),
            F.coalesce(F.sum("demand_during_stockout"), F.lit(0)).alias("total_lost_units"),
            F.coalesce(F.sum("lost_sales_amount"), F.lit(0)).alias("lost"),
        )
    )
    return (
        sums.join(t("products", "product_id", "sku", "product_name"), "product_id")
        .join(t("warehouses", "warehouse_id", "warehouse_code"), "warehouse_id")
        .select(
            "warehouse_code",
            "sku",
            "product_name",
            "stockout_count",
            round_to("days", 1).alias("avg_duration_days"),
            "total_lost_units",
            money("lost").alias("total_lost_revenue"),
            round_to(_severity(F.col("stockout_count"), F.col("days"), F.col("lost")), 0).alias("severity_score"),
        )
        .orderBy(F.desc_nulls_last("severity_score"), "warehouse_code", "sku")
    )


def stockout_root_causes(t: Tables) -> DataFrame:
    """Events, losses and share per cause; events without a cause are left out."""
    causes = (
        t("stockout_events", "root_cause", "lost_sales_amount", "demand_during_stockout", "stockout_id")
        .filter(F.col("root_cause").isNotNull())
        .groupBy("root_cause")
        .agg(
            F.count("stockout_id").alias("occurrence_count"),
            money(F.coalesce(F.sum("lost_sales_amount"), F.lit(0))).alias("total_lost_revenue"),
            F.coalesce(F.sum("demand_during_stockout"), F.lit(0)).alias("total_lost_units"),
        )
    )
    total = causes.agg(F.sum("occurrence_count")).scalar()
    return causes.withColumn("pct_of_stockouts", round_to(pct("occurrence_count", total), 2)).orderBy(
        F.desc("occurrence_count"), "root_cause"
    )
