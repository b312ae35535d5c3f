"""Denormalised extracts for BI tools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stocklens.functions.expr import (
    CARRYING_RATE,
    at_least_value,
    days_between,
    is_weekend,
    keep_present,
    label_from,
    pct,
    ratio,
    round_to,
)
from stocklens.operators.abc import abc_extract
from stocklens.operators.suppliers import supplier_scores_extract
from stocklens.sources.tables import Tables, write_extract

# Column lists of the extracts, label bounds.
SALES_COLUMNS = [
    "so_id", "so_item_id", "order_date", "order_year", "order_month", "order_month_name",
    "order_quarter", "order_week", "order_day_of_week", "is_weekend", "sku", "product_name",
    "category_name", "abc_class", "customer_name", "customer_type", "customer_city",
    "customer_state", "warehouse_name", "warehouse_city", "warehouse_state",
    "quantity_ordered", "quantity_shipped", "unit_price", "unit_cost", "discount_percent",
    "gross_amount", "discount_amount", "net_amount", "cost_amount", "profit_amount",
    "profit_margin_pct", "status",
]
INVENTORY_COLUMNS = [
    "warehouse_name", "city", "state", "sku", "product_name", "category_name", "abc_class",
    "quantity_on_hand", "quantity_reserved", "quantity_available", "reorder_point",
    "reorder_quantity", "unit_cost", "inventory_value", "annual_carrying_cost",
    "avg_daily_demand", "days_of_supply", "inventory_status", "movement_class",
    "is_below_reorder", "is_stockout", "is_overstock", "total_revenue",
]
SUPPLIER_COLUMNS = [
    "supplier_id", "supplier_name", "city", "state", "country", "payment_terms_days",
    "quality_rating", "is_preferred", "total_orders", "total_spend", "on_time_rate_pct",
    "fill_rate_pct", "reliability_score", "avg_lead_time", "lead_time_std", "tier",
    "performance_rating",
]
RATING_STEPS = [(90, "Excellent"), (75, "Good"), (60, "Fair")]
MIN_DAILY_DEMAND = 0.01
OVERSTOCK_DAYS = 90


def quantity(c: str) -> Column:
    return F.col(c).cast("decimal(10,0)")


def date_parts(day: str, prefix: str = "") -> dict[str, Column]:
    d = F.col(day)
    return {
        f"{prefix}year": F.year(d),
        f"{prefix}month": F.month(d),
        f"{prefix}month_name": F.date_format(d, "MMMM"),
        f"{prefix}quarter": F.quarter(d),
        f"{prefix}week": F.weekofyear(d),
        f"{prefix}day_of_week": F.date_format(d, "EEEE"),
    }


def _classes(t: Tables, classes: DataFrame | None) -> DataFrame:
    return abc_extract(t) if classes is None else classes


def with_line_amounts(lines: DataFrame) -> DataFrame:
    """Gross, discount, net, cost and profit of a line, exact in DECIMAL; no discount is zero."""
    hundredth = F.lit("0.01").cast("decimal(2,2)")
    discount = F.coalesce("discount_percent", F.lit(0).cast("decimal(5,2)"))
    return (
        lines.withColumn("gross_amount", quantity("quantity_ordered") * F.col("unit_price"))
        .withColumn("discount_amount", F.col("gross_amount") * discount * hundredth)
        .withColumn("net_amount", F.col("gross_amount") - F.col("discount_amount"))
        .withColumn("cost_amount", quantity("quantity_ordered") * F.col("unit_cost"))
        .withColumn("profit_amount", F.col("net_amount") - F.col("cost_amount"))
    )


def sales_extract(t: Tables, classes: DataFrame | None = None) -> DataFrame:
    """One row per order line with all its dimensions; uncategorised products drop out.

    ``classes`` is the result of ``abc_extract`` if it is at hand.

    Dimensions are joined to products and to orders first, so the lines themselves move
    only twice: once by order, which they do not if stored in buckets, and once by product. Sites
    are few and joined last: their texts need not move with the lines.
    """
    goods = (
        t("products", "product_id", "sku", "product_name", "category_id", "unit_cost")
        .join(t("product_categories", "category_id", "category_name"), "category_id")
        .join(_classes(t, classes).select("product_id", "abc_class"), "product_id", "left")
    )
    orders = (
        t("sales_orders", "so_id", "customer_id", "warehouse_id", "order_date", "status")
        .join(
            t("customers", "customer_id", "customer_name", "customer_type", "city", "state")
            .withColumnsRenamed({"city": "customer_city", "state": "customer_state"}),
            "customer_id",
        )
    )
    sites = t("warehouses", "warehouse_id", "warehouse_name", "city", "state").withColumnsRenamed(
        {"city": "warehouse_city", "state": "warehouse_state"}
    )
    lines = (
        t(
            "sales_order_items", "so_item_id", "so_id", "product_id", "quantity_ordered",
            "quantity_shipped", "unit_price", "discount_percent",
        )
        .join(orders, "so_id")
        .join(goods, "product_id")
        .join(sites, "warehouse_id")
    )
    full = (
        with_line_amounts(lines)
        .withColumn("profit_margin_pct", round_to(pct("profit_amount", "net_amount"), 2))
        .withColumns(date_parts("order_date", "order_"))
        .withColumn("is_weekend", is_weekend("order_date"))
    )
    return keep_present(full, SALES_COLUMNS)


def daily_demand_rate(t: Tables) -> DataFrame:
    """Units per day of each product over the days between the first and last order with a line."""
    # Both uses below read the same three figures of the same grouping, so that Spark shuffles
    # the joined lines once and reuses the result.
    per_product = (
        t("sales_order_items", "so_id", "product_id", "quantity_ordered")
        .filter(F.col("product_id").isNotNull())
        .join(t("sales_orders", "so_id", "order_date"), "so_id")
        .groupBy("product_id")
        .agg(F.sum("quantity_ordered").alias("units"), F.min("order_date").alias("lo"), F.max("order_date").alias("hi"))
    )
    counted = F.col("units").isNotNull() & (F.col("hi") >= F.col("lo"))
    span = per_product.filter(counted).agg(days_between(F.max("hi"), F.min("lo"))).scalar()
    return per_product.filter(counted).select(
        "product_id", ratio("units", at_least_value(span, 1)).alias("avg_daily_demand")
    )


def inventory_measures(t: Tables, *extra: str) -> DataFrame:
    """Stock rows with value, days of supply and flags; shared with the inventory fact."""
    available = F.col("quantity_available")
    rate = at_least_value("avg_daily_demand", MIN_DAILY_DEMAND)
    return (
        t(
            "inventory", "warehouse_id", "product_id", "quantity_on_hand", "quantity_reserved",
            "quantity_available", "reorder_point", *extra,
        )
        .join(t("products", "product_id", "sku", "product_name", "category_id", "unit_cost"), "product_id")
        .join(daily_demand_rate(t), "product_id", "left")
        .withColumn("inventory_value", F.col("quantity_on_hand").cast("decimal(18,0)") * F.col("unit_cost"))
        .withColumn("days_of_supply", round_to(ratio(available, rate), 1))
        .withColumn("is_below_reorder", F.coalesce(available < F.col("reorder_point"), F.lit(False)))
        .withColumn("is_stockout", available <= 0)
        .withColumn("is_overstock", F.coalesce(F.col("days_of_supply") > OVERSTOCK_DAYS, F.lit(False)))
    )


def stock_health(stockout: Column, below: Column, over: Column) -> Column:
    return (
        F.when(stockout, "Out of Stock")
        .when(below, "Below Reorder Point")
        .when(over, "Overstock")
        .otherwise("Healthy")
    )


def inventory_extract(t: Tables, classes: DataFrame | None = None) -> DataFrame:
    """One row per product and warehouse with stock health and movement class."""
    days = F.col("days_of_supply")
    full = (
        inventory_measures(t, "reorder_quantity")
        .join(t("product_categories", "category_id", "category_name"), "category_id")
        .join(t("warehouses", "warehouse_id", "warehouse_name", "city", "state"), "warehouse_id")
        .join(_classes(t, classes).select("product_id", "abc_class", "total_revenue"), "product_id", "left")
        .withColumn("annual_carrying_cost", F.col("inventory_value") * F.lit(CARRYING_RATE).cast("decimal(3,2)"))
        .withColumn(
            "inventory_status", stock_health(F.col("is_stockout"), F.col("is_below_reorder"), F.col("is_overstock"))
        )
        .withColumn(
            "movement_class",
            F.when(days < 30, "Fast Moving")
            .when(days < 90, "Normal")
            .when(days < 180, "Slow Moving")
            .otherwise("Dead Stock"),
        )
    )
    return keep_present(full, INVENTORY_COLUMNS)


def supplier_extract(t: Tables) -> DataFrame:
    """One row per supplier: scores, spend, attributes; rated on the rounded score."""
    full = (
        supplier_scores_extract(t)
        .join(
            t(
                "suppliers", "supplier_id", "supplier_name", "city", "state", "country",
                "payment_terms_days", "quality_rating", "is_preferred",
            ),
            "supplier_id",
        )
        .withColumn("on_time_rate_pct", round_to(F.col("on_time_rate") * 100, 1))
        .withColumn("fill_rate_pct", round_to(F.col("fill_rate") * 100, 1))
        .withColumn("reliability_score", round_to("reliability_score", 1))
        .withColumn("avg_lead_time", round_to("avg_lead_time", 1))
        .withColumn("performance_rating", label_from("reliability_score", RATING_STEPS, "Needs Improvement"))
    )
    return keep_present(full, SUPPLIER_COLUMNS)


def timeseries_extract(t: Tables) -> DataFrame:
    """Daily sales per warehouse and category with a seven-row moving average."""
    goods = t("products", "product_id", "category_id", "unit_cost").join(
        t("product_categories", "category_id", "category_name"), "category_id"
    )
    orders = t("sales_orders", "so_id", "warehouse_id", "order_date").join(
        t("warehouses", "warehouse_id", "warehouse_name"), "warehouse_id"
    )
    lines = t("sales_order_items", "so_id", "product_id", "quantity_ordered", "unit_price", "discount_percent").join(
        goods.select("product_id", F.col("category_name").alias("category"), "unit_cost"), "product_id"
    )
    # Lines are folded to one row per order and category before they meet their order: a
    # large order moves as a few rows, and the orders of a day are counted as rows.
    per_order = (
        with_line_amounts(lines)
        .groupBy("so_id", "category")
        .agg(
            F.sum("quantity_ordered").alias("units"),
            F.sum("net_amount").alias("revenue"),
            F.sum("cost_amount").alias("cost"),
        )
    )
    daily = (
        per_order.join(
            orders.select("so_id", F.col("warehouse_name").alias("warehouse"), F.col("order_date").alias("date")),
            "so_id",
        )
        .groupBy("date", "warehouse", "category")
        .agg(
            F.count("*").alias("order_count"),
            F.sum("units").alias("units_sold"),
            F.sum("revenue").alias("revenue"),
            F.sum("cost").alias("cost"),
        )
        .withColumn("profit", F.col("revenue") - F.col("cost"))
    )
    # At most one row per day in a window partition.
    week = W.partitionBy("warehouse", "category").orderBy("date").rowsBetween(-6, 0)
    return (
        daily.withColumns(date_parts("date"))
        .withColumn("is_weekend", is_weekend("date"))
        .withColumn("revenue_7d_ma", round_to(ratio(F.sum("revenue").over(week), F.count("revenue").over(week)), 2))
    )


EXTRACTS = {
    "sales": sales_extract,
    "inventory": inventory_extract,
    "supplier": supplier_extract,
    "timeseries": timeseries_extract,
}


def export_all(t: Tables, folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every extract as a folder of part files; returns the path of each.

    The ABC classes are worked out once, written beside the extracts and read by those that join
    them.
    """
    spark = t("products", "product_id").sparkSession
    classes = spark.read.parquet(write_extract(abc_extract(t), f"{folder}/abc_classes"))
    shared = {"sales": classes, "inventory": classes}
    return {
        name: write_extract(build(t, shared[name]) if name in shared else build(t), f"{folder}/{name}_extract", fmt)
        for name, build in EXTRACTS.items()
    }
