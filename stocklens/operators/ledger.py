"""Tables derived from orders: stock ledger, order totals, policies, profiles, counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.functions.expr import DateLike, at_least_value, days_between, money, ratio
from stocklens.operators.sales import live_lines
from stocklens.sources.tables import Tables, kept

# Days of demand in a reorder, and the share of the reorder point below which
# a product is likely to run out.
REORDER_DAYS = 30
STOCKOUT_SHARE = 0.5


def inventory_ledger(t: Tables, folder: str | None = None) -> DataFrame:
    """Receipts of delivered purchases and issues of shipped sales, in one signed ledger.

    ``transaction_id`` names the movement's source line: it needs no global ordering, is unique
    as that line's id is, and stays the same when the ledger is rebuilt. With a ``folder``, receipts
    are written there, so that what they moved is gone before the issues move.
    """
    received = receipts(t)
    if folder is not None:
        received = kept(received, f"{folder}/receipts")
    return received.unionByName(issues(t))


def receipts(t: Tables) -> DataFrame:
    """What delivered purchases brought in."""
    return (
        t("purchase_order_items", "po_item_id", "po_id", "product_id", "quantity_received", "unit_cost")
        .filter(F.col("quantity_received") > 0)
        .join(
            t("purchase_orders", "po_id", "warehouse_id", "status", "actual_delivery_date").filter(
                F.col("status") == "Delivered"
            ),
            "po_id",
        )
        .select(
            F.concat(F.lit("PO-"), F.col("po_item_id").cast("string")).alias("transaction_id"),
            "warehouse_id",
            "product_id",
            F.lit("Receipt").alias("transaction_type"),
            F.col("quantity_received").alias("quantity"),
            F.lit("PO").alias("reference_type"),
            F.col("po_id").cast("string").alias("reference_id"),
            "unit_cost",
            F.col("actual_delivery_date").alias("transaction_date"),
        )
    )


def issues(t: Tables) -> DataFrame:
    """What shipped sales took out."""
    return (
        t("sales_order_items", "so_item_id", "so_id", "product_id", "quantity_shipped")
        .filter(F.col("quantity_shipped") > 0)
        .join(
            t("sales_orders", "so_id", "warehouse_id", "status", "actual_ship_date").filter(
                F.col("status").isin("Shipped", "Delivered")
            ),
            "so_id",
        )
        .join(t("products", "product_id", "unit_cost"), "product_id")
        .select(
            F.concat(F.lit("SO-"), F.col("so_item_id").cast("string")).alias("transaction_id"),
            "warehouse_id",
            "product_id",
            F.lit("Sale").alias("transaction_type"),
            (-F.col("quantity_shipped")).alias("quantity"),
            F.lit("SO").alias("reference_type"),
            F.col("so_id").cast("string").alias("reference_id"),
            "unit_cost",
            F.col("actual_ship_date").alias("transaction_date"),
        )
    )


def order_totals(t: Tables) -> DataFrame:
    """Order totals from lines against the header amount, for purchases and sales."""
    # Each line amount is exact at six decimals; only the order's sum is rounded.
    net = (
        F.col("quantity_ordered").cast("decimal(10,0)")
        * F.col("unit_price")
        * (F.lit(100).cast("decimal(3,0)") - F.coalesce("discount_percent", F.lit(0).cast("decimal(5,2)")))
        * F.lit("0.01").cast("decimal(2,2)")
    )
    cost = F.col("quantity_ordered").cast("decimal(10,0)") * F.col("unit_cost")

    def compare(kind: str, key: str, heads: DataFrame, sums: DataFrame) -> DataFrame:
        return heads.join(sums, key, "left").select(
            F.lit(kind).alias("order_kind"),
            F.col(key).cast("string").alias("order_id"),
            "total_amount",
            "lines_total",
            (F.col("total_amount") - F.col("lines_total")).alias("difference"),
        )

    sales = (
        t("sales_order_items", "so_id", "quantity_ordered", "unit_price", "discount_percent")
        .groupBy("so_id")
        .agg(money(F.sum(net)).cast("decimal(14,2)").alias("lines_total"))
    )
    purchases = (
        t("purchase_order_items", "po_id", "quantity_ordered", "unit_cost")
        .groupBy("po_id")
        .agg(money(F.sum(cost)).cast("decimal(14,2)").alias("lines_total"))
    )
    return compare("PO", "po_id", t("purchase_orders", "po_id", "total_amount"), purchases).unionByName(
        compare("SO", "so_id", t("sales_orders", "so_id", "total_amount"), sales)
    )


def reorder_policy(t: Tables) -> DataFrame:
    """Reorder point and quantity per warehouse and product from average daily demand.

    The average runs over the days between the first and last live sale of the whole table.
    """
    orders = t("sales_orders", "order_date", "status").filter(F.col("status") != "Cancelled")
    span = orders.agg(days_between(F.max("order_date"), F.min("order_date"))).scalar()
    demand = (
        live_lines(t, ["warehouse_id"], ["product_id", "quantity_ordered"])
        .groupBy("warehouse_id", "product_id")
        .agg(F.sum("quantity_ordered").alias("units"))
    )
    cover = F.col("lead_time_days") + F.col("safety_stock_days")
    # Whole numbers are multiplied before the division, so the truncation is exact.
    days = at_least_value(span, 1)
    return demand.join(t("products", "product_id", "lead_time_days", "safety_stock_days"), "product_id").select(
        "warehouse_id",
        "product_id",
        ratio("units", days).alias("avg_daily_demand"),
        F.floor(ratio(F.col("units") * cover, days)).cast("bigint").alias("reorder_point"),
        F.floor(ratio(F.col("units") * REORDER_DAYS, days)).cast("bigint").alias("reorder_quantity"),
    )


def stockout_candidates(t: Tables) -> DataFrame:
    """Stock below half its reorder point."""
    return t("inventory", "warehouse_id", "product_id", "quantity_on_hand", "reorder_point").filter(
        F.col("quantity_on_hand") < F.col("reorder_point") * STOCKOUT_SHARE
    )


def seasonality_profile(t: Tables) -> DataFrame:
    """Demand index per month and per weekday: mean daily units over the overall mean.

    The mean of a month or weekday runs over the days that had sales.
    """
    daily = (
        live_lines(t, ["order_date"], ["quantity_ordered"])
        .groupBy("order_date")
        .agg(F.sum("quantity_ordered").alias("units"))
    )
    # Both profiles come from one pass: a day contributes to its month and to its weekday.
    parts = F.explode(
        F.array(
            F.struct(F.lit("month").alias("period"), F.month("order_date").alias("number")),
            F.struct(F.lit("weekday").alias("period"), (F.dayofweek("order_date") - 1).alias("number")),
            F.struct(F.lit("all").alias("period"), F.lit(0).alias("number")),
        )
    )
    sums = (
        daily.select("units", parts.alias("p"))
        .groupBy("p.period", "p.number")
        .agg(F.count("*").alias("days"), F.sum("units").alias("units"))
    )
    overall = sums.filter(F.col("period") == "all").select(ratio("units", "days").alias("overall"))
    return (
        sums.filter(F.col("period") != "all")
        .withColumn("avg_daily_units", ratio("units", "days"))
        .withColumn("demand_index", ratio("avg_daily_units", overall.scalar()))
        .select("period", "number", "days", "units", "avg_daily_units", "demand_index")
    )


def table_counts(t: Tables) -> DataFrame:
    """Rows per table, and the sales date range where the table has one."""
    dated = {"sales_orders": "order_date", "purchase_orders": "order_date", "stockout_events": "stockout_start_date"}
    none = F.lit(None).cast("date")

    def one(name: str) -> DataFrame:
        day = dated.get(name)
        # Any one column counts rows; the first, the key, needs no join.
        df = t(name, day or t.columns(name)[0])
        first, last = (F.min(F.col(day).cast("date")), F.max(F.col(day).cast("date"))) if day else (none, none)
        return df.agg(F.count("*").alias("row_count"), first.alias("first_date"), last.alias("last_date")).select(
            F.lit(name).alias("table_name"), "row_count", "first_date", "last_date"
        )

    return reduce(DataFrame.unionByName, [one(n) for n in t.names()])
