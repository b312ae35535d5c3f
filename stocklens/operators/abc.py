"""ABC classification: five variants that differ in revenue, scope, frame and labels.

All pre-aggregate lines to one row per product before anything is ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stocklens.functions.expr import DateLike, label_up_to, pct, ratio, round_to
from stocklens.functions.running import running_totals
from stocklens.operators.sales import live_lines, months_back, sales_anchor
from stocklens.sources.tables import Tables

# Cumulative revenue bounds of classes A and B, in percent.
A_BOUND, B_BOUND = 80.0, 95.0


def _classes(cumulative, a: float = A_BOUND, b: float = B_BOUND):
    return label_up_to(cumulative, [(a, "A"), (b, "B")], "C")


def _ranked_net(t: Tables, as_of: DateLike, months: int, position: bool = False) -> DataFrame:
    """Net revenue per product over the last months, with shared running totals."""
    since = months_back(sales_anchor(t, as_of), months)
    revenue = (
        live_lines(t, [], ["product_id", "quantity_ordered", "line_total"], since)
        .groupBy("product_id")
        .agg(F.sum("line_total").alias("total_revenue"), F.sum("quantity_ordered").alias("total_units_sold"))
    )
    named = revenue.join(t("products", "product_id", "sku", "product_name", "category_id"), "product_id").join(
        t("product_categories", "category_id", "category_name"), "category_id", "left"
    )
    ranked = running_totals(named, "total_revenue", "product_id", ties="share", position=position)
    return ranked.withColumn("cumulative_percentage", pct("running", "grand_total")).withColumn(
        "abc_class", _classes("cumulative_percentage")
    )


def abc_summary(t: Tables, as_of: DateLike = None, months: int = 12) -> DataFrame:
    """Products, revenue and shares per class; revenue net of discount."""
    per_class = (
        _ranked_net(t, as_of, months)
        .groupBy("abc_class")
        .agg(
            F.count("*").alias("product_count"),
            F.sum("total_revenue").alias("class_revenue"),
            F.avg("total_units_sold").alias("avg_units"),
        )
    )
    everything = W.partitionBy()  # three rows: the classes
    return per_class.select(
        "abc_class",
        "product_count",
        round_to(pct("product_count", F.sum("product_count").over(everything)), 2).alias("pct_of_products"),
        "class_revenue",
        round_to(pct("class_revenue", F.sum("class_revenue").over(everything)), 2).alias("pct_of_revenue"),
        round_to("avg_units", 0).alias("avg_units_per_product"),
    ).orderBy("abc_class")


def abc_detail(t: Tables, as_of: DateLike = None, months: int = 12) -> DataFrame:
    """The classified products behind :func:`abc_summary`, by revenue rank."""
    return (
        _ranked_net(t, as_of, months, position=True)
        .select(
            "product_id",
            "sku",
            "product_name",
            "category_name",
            "total_revenue",
            "total_units_sold",
            F.col("position").alias("revenue_rank"),
            round_to("cumulative_percentage", 2).alias("cumulative_pct"),
            "abc_class",
        )
        .orderBy("revenue_rank")
    )


def abc_line_gross(t: Tables) -> DataFrame:
    """Gross revenue of all lines, whatever the order's state or date."""
    gross = F.col("quantity_ordered").cast("decimal(10,0)") * F.col("unit_price")
    revenue = (
        t("sales_order_items", "product_id", "quantity_ordered", "unit_price")
        .groupBy("product_id")
        .agg(F.sum(gross).alias("total_revenue"))
        .join(t("products", "product_id", "product_name"), "product_id")
    )
    ranked = running_totals(revenue, "total_revenue", "product_id", ties="share")
    return ranked.select(
        "product_id",
        "product_name",
        "total_revenue",
        F.col("running").alias("cumulative_revenue"),
        "grand_total",
        round_to(pct("running", "grand_total"), 2).alias("cumulative_pct"),
        _classes(ratio("running", "grand_total"), 0.80, 0.95).alias("abc_class"),
    ).orderBy(F.desc("total_revenue"), "product_id")


def abc_mean_price(
    t: Tables,
    lookback_days: int = 365,
    a_threshold: float = A_BOUND,
    b_threshold: float = B_BOUND,
    as_of: DateLike = None,
) -> DataFrame:
    """Revenue as units times the unweighted mean price; discounts ignored."""
    since = F.date_sub(sales_anchor(t, as_of), lookback_days)
    mean_price = ratio(F.sum("unit_price"), F.count("unit_price"))
    revenue = (
        live_lines(t, [], ["product_id", "quantity_ordered", "unit_price"], since)
        .groupBy("product_id")
        .agg(F.sum("quantity_ordered").alias("quantity_ordered"), mean_price.alias("mean_price"))
        # DECIMAL, so that the running total does not depend on the order of summing.
        .withColumn("total_revenue", (F.col("quantity_ordered") * F.col("mean_price")).cast("decimal(24,6)"))
        .drop("mean_price")
    )
    ranked = running_totals(revenue, "total_revenue", "product_id", ties="split")
    cumulative = pct("running", "grand_total")
    return (
        ranked.withColumn("cumulative_pct", cumulative)
        .join(t("products", "product_id", "sku", "product_name"), "product_id")
        .select(
            "product_id",
            "sku",
            "product_name",
            "quantity_ordered",
            "total_revenue",
            "cumulative_pct",
            _classes("cumulative_pct", a_threshold, b_threshold).alias("abc_class"),
        )
        .orderBy(F.desc("total_revenue"), "product_id")
    )


def abc_extract(t: Tables) -> DataFrame:
    """Net revenue of all lines; outside (0, 100.01] percent there is no class."""
    revenue = (
        t("sales_order_items", "product_id", "quantity_ordered", "line_total")
        .groupBy("product_id")
        .agg(F.sum("line_total").alias("total_revenue"), F.sum("quantity_ordered").alias("total_quantity"))
    )
    ranked = running_totals(revenue, "total_revenue", "product_id", ties="split")
    share = F.col("cumulative_pct")
    return ranked.withColumn("cumulative_pct", pct("running", "grand_total")).select(
        "product_id",
        "total_revenue",
        "total_quantity",
        "cumulative_pct",
        F.when((share > 0) & (share <= 100.01), _classes("cumulative_pct")).alias("abc_class"),
    )
