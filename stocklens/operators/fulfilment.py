"""Order fulfilment by warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions.expr import DateLike, label_from, pct, ratio, round_to
from stocklens.operators.sales import months_back, sales_anchor, from_first_key
from stocklens.sources.tables import Tables

# Unit fill bounds of the service grades.
GRADES = [(0.98, "A"), (0.95, "B"), (0.90, "C")]


def fill_rate_service(t: Tables, as_of: DateLike = None, months: int = 3) -> DataFrame:
    """Unit, line and order fill per warehouse.

    ``order_fill_rate`` counts orders with at least one complete line,
    ``order_fill_rate_strict`` those whose lines are all complete. Lines are folded to one
    row per order before the join: an order of any size then moves as one row, and counting
    orders needs no distinct.
    """
    since = months_back(sales_anchor(t, as_of), months)
    orders = t("sales_orders", "so_id", "warehouse_id", "order_date", "status").filter(
        ~F.col("status").isin("Cancelled", "Pending") & (F.col("order_date") >= since)
    )
    complete = F.col("quantity_shipped") >= F.col("quantity_ordered")
    per_order = (
        from_first_key(
            t("sales_order_items", "so_id", "product_id", "quantity_ordered", "quantity_shipped"), orders, "so_id"
        )
        .groupBy("so_id")
        .agg(
            F.count("*").alias("lines"),
            F.count("product_id").alias("items"),
            F.sum("quantity_ordered").alias("ordered"),
            F.sum("quantity_shipped").alias("shipped"),
            F.count_if(complete).alias("full"),
        )
        .join(orders.select("so_id", "warehouse_id"), "so_id")
    )
    per_site = per_order.groupBy("warehouse_id").agg(
        F.count("*").alias("total_orders"),
        F.sum("items").alias("total_line_items"),
        F.sum("ordered").alias("total_units_ordered"),
        F.sum("shipped").alias("total_units_shipped"),
        F.sum("lines").alias("lines"),
        F.sum("full").alias("full"),
        F.count_if(F.col("full") > 0).alias("some_full"),
        F.count_if(F.col("full") == F.col("lines")).alias("all_full"),
    )
    units = ratio("total_units_shipped", "total_units_ordered")
    return (
        per_site.join(t("warehouses", "warehouse_id", "warehouse_code", "warehouse_name"), "warehouse_id")
        .select(
            "warehouse_code",
            "warehouse_name",
            "total_orders",
            "total_line_items",
            "total_units_ordered",
            "total_units_shipped",
            round_to(units * 100, 2).alias("unit_fill_rate"),
            round_to(pct("full", "lines"), 2).alias("line_fill_rate"),
            round_to(pct("some_full", "total_orders"), 2).alias("order_fill_rate"),
            round_to(pct("all_full", "total_orders"), 2).alias("order_fill_rate_strict"),
            label_from(units, GRADES, "D").alias("service_grade"),
        )
        .orderBy(F.desc("unit_fill_rate"), "warehouse_code")
    )
