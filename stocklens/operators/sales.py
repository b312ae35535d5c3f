"""Shared sales and purchase line frames, and the daily sales view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.expr import DateLike, anchor, not_cancelled
from stocklens.sources.tables import Tables


def sales_anchor(t: Tables, as_of: DateLike = None) -> Column:
    return anchor(as_of, t("sales_orders", "order_date"), "order_date")


def months_back(day: Column, months: int) -> Column:
    return F.add_months(day, -months)


def from_first_key(lines: DataFrame, orders: DataFrame, key: str) -> DataFrame:
    """``lines`` from the least key of the (filtered) ``orders`` on that they are to be joined with.

    The key comes from the orders as a scalar subquery and reaches the scan of the lines, so where
    orders are numbered as they come in, a window of recent days reads its own row groups only.
    """
    return lines.filter(F.col(key) >= orders.agg(F.min(key)).scalar())


def live_lines(t: Tables, order_columns: list[str], item_columns: list[str], since: Column | None = None) -> DataFrame:
    """Lines of orders that were not cancelled, optionally from a date on.

    The order side is filtered before the join, so only surviving order keys are matched; with a
    date, lines before their first key are not read.
    """
    need = list(dict.fromkeys(["so_id", "status", "order_date", *order_columns]))
    orders = t("sales_orders", *need).filter(not_cancelled())
    if since is not None:
        orders = orders.filter(F.col("order_date") >= since)
    items = t("sales_order_items", "so_id", *item_columns)
    if since is not None:
        items = from_first_key(items, orders, "so_id")
    return items.join(orders.select("so_id", *[c for c in order_columns if c != "so_id"]), "so_id")


def daily_sales(t: Tables) -> DataFrame:
    """Units, revenue, cost and profit per day, warehouse and product.

    Lines are summed on the ids before names are looked up.
    """
    sums = (
        live_lines(t, ["order_date", "warehouse_id"], ["product_id", "quantity_ordered", "line_total"])
        .groupBy("order_date", "warehouse_id", "product_id")
        .agg(F.sum("quantity_ordered").alias("units_sold"), F.sum("line_total").alias("revenue"))
    )
    cost = F.col("units_sold").cast("decimal(18,0)") * F.col("unit_cost")
    return (
        sums.join(t("products", "product_id", "sku", "product_name", "unit_cost"), "product_id")
        .join(t("warehouses", "warehouse_id", "warehouse_code"), "warehouse_id")
        .select(
            "order_date",
            "warehouse_code",
            "sku",
            "product_name",
            "units_sold",
            "revenue",
            cost.alias("cost_of_goods_sold"),
            (F.col("revenue") - cost).alias("gross_profit"),
        )
    )
