"""Supplier performance, scorecards and lead-time variability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.expr import (
    DateLike,
    anchor,
    at_least_value,
    days_between,
    label_up_to,
    pct,
    ratio,
    round_to,
    tier,
    within,
)
from stocklens.operators.sales import months_back
from stocklens.sources.tables import Tables

# Tier bounds (on-time %, fill %), consistency points, lead-time labels.
TIERS = [(95, 98, "Platinum"), (90, 95, "Gold"), (80, 90, "Silver")]
LOWEST_TIER = "Bronze"
CONSISTENCY_POINTS = [(1, 20), (3, 15), (7, 10)]
LOWEST_POINTS = 5
RELIABILITY_STEPS = [(10, "Highly Reliable"), (25, "Reliable"), (40, "Variable")]
UNRELIABLE = "Unreliable"


def _variance() -> Column:
    return days_between("actual_delivery_date", "expected_delivery_date")


def _lead() -> Column:
    return days_between("actual_delivery_date", "order_date")


def _on_time() -> Column:
    return F.col("actual_delivery_date") <= F.col("expected_delivery_date")


def _purchase_anchor(t: Tables, as_of: DateLike):
    return anchor(as_of, t("purchase_orders", "order_date"), "order_date")


def supplier_performance(t: Tables) -> DataFrame:
    """Orders, delivery variance, on-time rate and spend; suppliers without orders stay."""
    orders = t(
        "purchase_orders", "supplier_id", "status", "expected_delivery_date", "actual_delivery_date", "total_amount"
    )
    sums = orders.groupBy("supplier_id").agg(
        F.count("*").alias("total_orders"),
        F.count_if(F.col("status") == "Delivered").alias("delivered_orders"),
        F.avg(_variance()).alias("avg_delivery_variance_days"),
        pct(F.count_if(_on_time()), F.count("actual_delivery_date")).alias("on_time_delivery_rate"),
        F.sum("total_amount").alias("total_purchase_value"),
    )
    none = F.lit(0)
    return (
        t("suppliers", "supplier_id", "supplier_code", "supplier_name", "quality_rating")
        .join(sums, "supplier_id", "left")
        .select(
            "supplier_id",
            "supplier_code",
            "supplier_name",
            F.coalesce("total_orders", none).alias("total_orders"),
            F.coalesce("delivered_orders", none).alias("delivered_orders"),
            "avg_delivery_variance_days",
            "on_time_delivery_rate",
            "total_purchase_value",
            "quality_rating",
        )
    )


def supplier_scorecard_sql(t: Tables, as_of: DateLike = None, months: int = 12) -> DataFrame:
    """Scorecard of recent deliveries; the fill rate spans all time and mapped products only."""
    since = months_back(_purchase_anchor(t, as_of), months)
    orders = t(
        "purchase_orders", "po_id", "supplier_id", "status", "order_date", "expected_delivery_date",
        "actual_delivery_date", "total_amount",
    ).filter(F.col("status") == "Delivered").select(
        "po_id", "supplier_id", "total_amount", (F.col("order_date") >= since).alias("recent"),
        _variance().alias("late"), _on_time().alias("in_time"),
    )
    # Orders meet their lines once. One aggregation gives both grains: a row per order for the
    # deliveries, and a row per supplier and product for the fill rate.
    lines = t("purchase_order_items", "po_id", "product_id", "quantity_ordered", "quantity_received")
    order = ["po_id", "total_amount", "recent", "late", "in_time"]
    grains = (
        orders.join(lines, "po_id", "left")
        .groupingSets([["supplier_id", *order], ["supplier_id", "product_id"]], "supplier_id", "product_id", *order)
        .agg(
            F.grouping("po_id").alias("_per_product"),
            F.sum("quantity_received").alias("received"),
            F.sum("quantity_ordered").alias("ordered"),
        )
    )
    mapped = t("product_suppliers", "product_id", "supplier_id").withColumn("mapped", F.lit(True))
    is_order = (F.col("_per_product") == 0) & F.col("recent")
    is_mapped = (F.col("_per_product") == 1) & F.col("mapped")
    of_order = lambda c: F.when(is_order, F.col(c))
    of_product = lambda c: F.when(is_mapped, F.col(c))
    figures = (
        grains.join(mapped, ["product_id", "supplier_id"], "left")
        .groupBy("supplier_id")
        .agg(
            F.count_if(is_order).alias("total_orders"),
            F.sum(of_order("total_amount")).alias("total_purchase_value"),
            F.avg(of_order("late")).alias("avg_var"),
            F.stddev_samp(of_order("late")).alias("sd_var"),
            F.count_if(is_order & F.col("in_time")).alias("on_time"),
            round_to(pct(F.sum(of_product("received")), F.sum(of_product("ordered"))), 2).alias("fill_rate"),
        )
        .filter(F.col("total_orders") > 0)
    )
    on_time = ratio("on_time", "total_orders")
    filled = F.col("fill_rate_pct")
    score = on_time * 40 + filled * 0.4 + label_up_to(F.abs("avg_var"), CONSISTENCY_POINTS, LOWEST_POINTS)
    return (
        figures.join(t("suppliers", "supplier_id", "supplier_code", "supplier_name"), "supplier_id")
        .withColumn("fill_rate_pct", F.coalesce("fill_rate", F.lit(0.0)))
        .select(
            "supplier_id",
            "supplier_code",
            "supplier_name",
            "total_orders",
            "total_purchase_value",
            round_to("avg_var", 1).alias("avg_delivery_variance_days"),
            round_to("sd_var", 1).alias("delivery_variance_stddev"),
            round_to(on_time * 100, 2).alias("on_time_delivery_pct"),
            "fill_rate_pct",
            round_to(score, 1).alias("reliability_score"),
            tier(on_time, filled, [(a / 100, b, label) for a, b, label in TIERS], LOWEST_TIER).alias("supplier_tier"),
        )
    )


def supplier_scores(t: Tables, lookback_days: int = 365, as_of: DateLike = None) -> DataFrame:
    """Scores over recent deliveries, consistency judged by the spread of the variance."""
    since = F.date_sub(_purchase_anchor(t, as_of), lookback_days)
    recent = t(
        "purchase_orders", "po_id", "supplier_id", "status", "order_date", "expected_delivery_date",
        "actual_delivery_date",
    ).filter((F.col("status") == "Delivered") & (F.col("order_date") >= since))
    deliveries = recent.groupBy("supplier_id").agg(
        F.count("*").alias("total_orders"),
        pct(F.count_if(_on_time()), F.count("*")).alias("on_time"),
        F.avg(_variance()).alias("avg_var"),
        F.stddev_samp(_variance()).alias("sd_var"),
    )
    fill = (
        t("purchase_order_items", "po_id", "quantity_ordered", "quantity_received")
        .join(recent.select("po_id", "supplier_id"), "po_id")
        .groupBy("supplier_id")
        .agg(pct(F.sum("quantity_received"), F.sum("quantity_ordered")).alias("fill"))
    )
    spread = F.coalesce("sd_var", F.lit(0.0))  # a single delivery counts as consistent
    score = (
        F.col("on_time") * 0.4 + F.col("fill") * 0.4 + label_up_to(spread, CONSISTENCY_POINTS, LOWEST_POINTS)
    )
    return (
        deliveries.join(fill, "supplier_id")
        .join(t("suppliers", "supplier_id", "supplier_code", "supplier_name", "quality_rating"), "supplier_id")
        .select(
            "supplier_code",
            "supplier_name",
            "total_orders",
            round_to("on_time", 2).alias("on_time_rate"),
            round_to("fill", 2).alias("fill_rate"),
            round_to("avg_var", 1).alias("avg_variance"),
            "quality_rating",
            round_to(score, 1).alias("reliability_score"),
            tier(F.col("on_time"), F.col("fill"), TIERS, LOWEST_TIER).alias("tier"),
        )
    )


def supplier_scores_extract(t: Tables) -> DataFrame:
    """Scores over all purchase orders; one not delivered yet counts as late and unfilled."""
    per_order = (
        t("purchase_order_items", "po_id", "quantity_ordered", "quantity_received", "line_total")
        .groupBy("po_id")
        .agg(
            F.sum("quantity_ordered").alias("ordered"),
            F.sum("quantity_received").alias("received"),
            F.sum("line_total").alias("spend"),
        )
    )
    orders = t(
        "purchase_orders", "po_id", "supplier_id", "order_date", "expected_delivery_date", "actual_delivery_date"
    )
    lead = F.col("avg_lead_time")
    return (
        orders.join(per_order, "po_id")
        .groupBy("supplier_id")
        .agg(
            F.count("*").alias("total_orders"),
            F.sum("ordered").alias("total_ordered"),
            F.sum("received").alias("total_received"),
            F.sum("spend").alias("total_spend"),
            ratio(F.count_if(_on_time()), F.count("*")).alias("on_time_rate"),
            F.avg(_lead()).alias("avg_lead_time"),
            F.coalesce(F.stddev_samp(_lead()), F.lit(0.0)).alias("lead_time_std"),
        )
        .withColumn("fill_rate", ratio("total_received", "total_ordered"))
        .withColumn("consistency_score", within(1 - ratio("lead_time_std", at_least_value(lead, 1.0)), 0.0, 1.0))
        .withColumn(
            "reliability_score",
            F.col("on_time_rate") * 40 + F.col("fill_rate") * 40 + F.col("consistency_score") * 20,
        )
        .withColumn(
            "tier",
            tier(
                F.col("on_time_rate"),
                F.col("fill_rate"),
                [(a / 100, b / 100, label) for a, b, label in TIERS],
                LOWEST_TIER,
            ),
        )
    )


def lead_time_by_supplier(t: Tables) -> DataFrame:
    """Lead-time spread per supplier; an unknown variation counts as highly reliable."""
    delivered = t("purchase_orders", "supplier_id", "status", "order_date", "actual_delivery_date").filter(
        F.col("status") == "Delivered"
    )
    stats = delivered.groupBy("supplier_id").agg(
        F.count("*").alias("delivery_count"),
        F.avg(_lead()).alias("avg_lead"),
        F.stddev_samp(_lead()).alias("sd_lead"),
        F.min(_lead()).alias("min_lead_time"),
        F.max(_lead()).alias("max_lead_time"),
    )
    cv = F.col("cv")
    return (
        stats.withColumn("cv", pct("sd_lead", "avg_lead"))
        .join(t("suppliers", "supplier_id", "supplier_code", "supplier_name"), "supplier_id")
        .select(
            "supplier_code",
            "supplier_name",
            "delivery_count",
            round_to("avg_lead", 2).alias("avg_lead_time"),
            round_to("sd_lead", 2).alias("std_lead_time"),
            "min_lead_time",
            "max_lead_time",
            round_to(cv, 2).alias("cv_pct"),
            label_up_to(F.coalesce(cv, F.lit(0.0)), RELIABILITY_STEPS, UNRELIABLE).alias("reliability_category"),
        )
    )


def lead_time_by_supplier_product(
    t: Tables, as_of: DateLike = None, min_deliveries: int = 3, months: int = 12
) -> DataFrame:
    """Lead-time spread per supplier and product; an unknown variation is unreliable."""
    since = months_back(_purchase_anchor(t, as_of), months)
    delivered = t("purchase_orders", "po_id", "supplier_id", "status", "order_date", "actual_delivery_date").filter(
        F.col("actual_delivery_date").isNotNull()
        & (F.col("status") == "Delivered")
        & (F.col("order_date") >= since)
    )
    stats = (
        delivered.join(t("purchase_order_items", "po_id", "product_id"), "po_id")
        .groupBy("supplier_id", "product_id")
        .agg(
            F.count("*").alias("delivery_count"),
            F.avg(_lead()).alias("avg_lead"),
            F.min(_lead()).alias("min_lead_time"),
            F.max(_lead()).alias("max_lead_time"),
            F.stddev_samp(_lead()).alias("sd_lead"),
        )
        .filter(F.col("delivery_count") >= min_deliveries)
        .withColumn("cv", pct("sd_lead", "avg_lead"))
    )
    return (
        stats.join(t("suppliers", "supplier_id", "supplier_name"), "supplier_id")
        .join(t("products", "product_id", "sku", "product_name", "lead_time_days"), "product_id")
        .select(
            "supplier_id",
            "supplier_name",
            "product_id",
            "sku",
            "product_name",
            "delivery_count",
            F.col("lead_time_days").alias("expected_lead_time"),
            round_to("avg_lead", 1).alias("avg_actual_lead_time"),
            "min_lead_time",
            "max_lead_time",
            round_to("sd_lead", 2).alias("lead_time_stddev"),
            round_to("cv", 2).alias("lead_time_cv_pct"),
            label_up_to(
                ratio("sd_lead", "avg_lead"), [(b / 100, label) for b, label in RELIABILITY_STEPS], UNRELIABLE
            ).alias("reliability_category"),
        )
    )
