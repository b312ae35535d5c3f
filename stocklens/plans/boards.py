"""The tables behind the dashboard pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stocklens.functions.expr import pct, ratio, whole_days
from stocklens.operators import abc, inventory, stockouts, suppliers
from stocklens.sources.tables import Tables

# Labels as charted, in chart order.
TIER_ORDER = ["Platinum", "Gold", "Silver", "Bronze"]
COMPONENT_LABELS = {
    "capital_cost": "Capital Cost (8%)",
    "storage_cost": "Storage (5%)",
    "insurance_cost": "Insurance (3%)",
    "obsolescence_cost": "Obsolescence (2%)",
    "handling_cost": "Handling (2%)",
}


def _stock_value(t: Tables, *columns: str) -> DataFrame:
    return (
        t("inventory", "product_id", "quantity_on_hand", *columns)
        .join(t("products", "product_id", "unit_cost"), "product_id")
        .withColumn("value", F.col("quantity_on_hand").cast("decimal(18,0)") * F.col("unit_cost"))
    )


def _counts(df: DataFrame, label: str, name: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias(name))


# ---- executive summary ----------------------------------------------------------------


def kpi_summary(t: Tables) -> DataFrame:
    """One row: stock value, stockout losses, fill rate, active suppliers, rows at risk."""
    available = F.col("quantity_on_hand") - F.col("quantity_reserved")
    stock = _stock_value(t, "quantity_reserved", "reorder_point").agg(
        F.sum("value").alias("total_inventory_value"),
        F.count_if(available < F.col("reorder_point")).alias("products_at_risk"),
    )
    losses = t("stockout_events", "lost_sales_amount").agg(F.sum("lost_sales_amount"))
    fill = t("purchase_order_items", "quantity_received", "quantity_ordered").agg(
        pct(F.sum("quantity_received"), F.sum("quantity_ordered"))
    )
    active = t("suppliers", "is_active").agg(F.count_if("is_active"))
    return stock.select(
        "total_inventory_value",
        losses.scalar().alias("stockout_losses"),
        fill.scalar().alias("fill_rate_pct"),
        active.scalar().alias("active_suppliers"),
        "products_at_risk",
    )


def monthly_sales(t: Tables) -> DataFrame:
    """Header amounts per month, cancelled orders included."""
    return (
        t("sales_orders", "order_date", "total_amount")
        .groupBy(F.date_format("order_date", "yyyy-MM").alias("month"))
        .agg(F.sum("total_amount").alias("total_amount"))
        .orderBy("month")
    )


def inventory_value_by_warehouse(t: Tables) -> DataFrame:
    return (
        _stock_value(t, "warehouse_id")
        .groupBy("warehouse_id")
        .agg(F.sum("value").alias("value"))
        .join(t("warehouses", "warehouse_id", "warehouse_code"), "warehouse_id")
        .select("warehouse_id", "warehouse_code", "value")
    )


# ---- ABC and turnover -----------------------------------------------------------------


def abc_class_share(t: Tables) -> DataFrame:
    """Products and revenue per class with their shares."""
    per_class = (
        abc.abc_mean_price(t)
        .groupBy("abc_class")
        .agg(F.count("product_id").alias("products"), F.sum("total_revenue").alias("revenue"))
    )
    everything = W.partitionBy()  # three rows: the classes
    return per_class.select(
        "abc_class",
        "products",
        "revenue",
        pct("revenue", F.sum("revenue").over(everything)).alias("revenue_pct"),
        pct("products", F.sum("products").over(everything)).alias("products_pct"),
    )


def top_a_products(t: Tables, n: int = 10) -> DataFrame:
    return (
        abc.abc_mean_price(t)
        .filter(F.col("abc_class") == "A")
        .orderBy(F.desc("total_revenue"), "product_id")
        .limit(n)
        .select("sku", "product_name", "quantity_ordered", "total_revenue")
    )


def turnover_category_counts(t: Tables) -> DataFrame:
    return _counts(inventory.turnover(t), "turnover_category", "product_count")


def turnover_metrics(t: Tables) -> DataFrame:
    """Mean ratio, mean finite days of supply, dead rows and their value."""
    days, dead = F.col("days_of_supply"), F.col("turnover_category") == inventory.DEAD_STOCK
    return inventory.turnover(t).agg(
        F.avg("turnover_ratio").alias("avg_turnover_ratio"),
        F.avg(F.when(days < float("inf"), days)).alias("avg_days_of_supply"),
        F.count_if(dead).alias("dead_stock_items"),
        F.coalesce(F.sum(F.when(dead, F.col("inventory_value"))), F.lit(0)).alias("dead_stock_value"),
    )


def dead_stock_top(t: Tables, n: int = 20) -> DataFrame:
    return (
        inventory.turnover(t)
        .filter(F.col("turnover_category") == inventory.DEAD_STOCK)
        .orderBy(F.desc_nulls_last("inventory_value"), "warehouse_code", "sku")
        .limit(n)
        .select("warehouse_code", "sku", "product_name", "quantity_on_hand", "inventory_value", "days_of_supply")
    )


# ---- suppliers ------------------------------------------------------------------------

_SUPPLIER_COLUMNS = ["supplier_name", "on_time_rate", "fill_rate", "reliability_score", "tier"]


def supplier_tier_counts(t: Tables, lookback_days: int = 365) -> DataFrame:
    """Suppliers per tier in fixed order, zero where a tier is empty."""
    counts = _counts(suppliers.supplier_scores(t, lookback_days), "tier", "n")
    labels = F.array(*[F.lit(x) for x in TIER_ORDER])
    tiers = counts.sparkSession.range(1).select(F.posexplode(labels).alias("tier_order", "tier"))
    return (
        tiers.join(counts, "tier", "left")
        .select("tier_order", "tier", F.coalesce("n", F.lit(0)).alias("supplier_count"))
        .orderBy("tier_order")
    )


def supplier_top(t: Tables, n: int = 5, lookback_days: int = 365) -> DataFrame:
    return (
        suppliers.supplier_scores(t, lookback_days)
        .orderBy(F.desc("reliability_score"), "supplier_code")
        .limit(n)
        .select(*_SUPPLIER_COLUMNS)
    )


def supplier_bottom(t: Tables, n: int = 5, lookback_days: int = 365) -> DataFrame:
    return (
        suppliers.supplier_scores(t, lookback_days)
        .orderBy(F.asc_nulls_last("reliability_score"), "supplier_code")
        .limit(n)
        .select(*_SUPPLIER_COLUMNS)
    )


def lead_time_cv_ranking(t: Tables) -> DataFrame:
    return (
        suppliers.lead_time_by_supplier(t)
        .orderBy(F.asc_nulls_last("cv_pct"), "supplier_code")
        .select("supplier_name", "cv_pct", "reliability_category")
    )


# ---- stockouts ------------------------------------------------------------------------


def root_cause_by_lost_revenue(t: Tables) -> DataFrame:
    return (
        stockouts.stockout_root_causes(t)
        .orderBy("total_lost_revenue", "root_cause")
        .select("root_cause", "total_lost_revenue")
    )


def stockout_kpis(t: Tables) -> DataFrame:
    events = t("stockout_events", "product_id", "stockout_start_date", "stockout_end_date", "lost_sales_amount")
    # Folded per product first: the distinct count becomes a row count, whatever the skew.
    per_product = (
        events.withColumn("days", whole_days("stockout_end_date", "stockout_start_date"))
        .groupBy("product_id")
        .agg(
            F.count("*").alias("events"),
            F.sum("lost_sales_amount").alias("lost"),
            F.sum("days").alias("days"),
            F.count("days").alias("closed"),
        )
    )
    return per_product.agg(
        F.sum("events").alias("total_events"),
        F.sum("lost").alias("total_lost_revenue"),
        ratio(F.sum("days"), F.sum("closed")).alias("avg_duration_days"),
        F.count("product_id").alias("products_affected"),
    )


def most_impacted(t: Tables, n: int = 10) -> DataFrame:
    return stockouts.stockout_impact(t).limit(n)


# ---- reorder points -------------------------------------------------------------------


def rop_recommendation_counts(t: Tables, service_level: float = 0.95) -> DataFrame:
    return _counts(inventory.reorder_points(t, service_level), "recommendation", "product_count")


def rop_needs_increase(t: Tables, n: int = 10, service_level: float = 0.95) -> DataFrame:
    """The rows to raise, widest gap first."""
    gap = F.col("calculated_rop") - F.col("current_rop")
    return (
        inventory.reorder_points(t, service_level)
        .filter(F.col("recommendation") == "Increase ROP")
        .orderBy(gap.desc(), "warehouse_code", "sku")
        .limit(n)
        .select(
            "warehouse_code",
            "sku",
            "product_name",
            "quantity_on_hand",
            "avg_daily_demand",
            "safety_stock",
            "current_rop",
            "calculated_rop",
        )
    )


# ---- order quantities -----------------------------------------------------------------


def _histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts in equal widths over min..max; the maximum falls in the last bin."""
    # Counted per value first: the ends and the bins are then read from those few rows.
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x"))
    counts = values.agg(F.count("*").alias("n"))
    ends = counts.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high"))).scalar()
    low, high = ends["low"], ends["high"]
    width = (high - low) / bins
    number = F.when(high == low, 1).otherwise(
        F.least(F.floor((F.col("x") - low) / F.nullif(width, F.lit(0.0))).cast("int") + 1, F.lit(bins))
    )
    return (
        counts.groupBy(number.cast("int").alias("bin"))
        .agg(F.sum("n").alias("product_count"))
        .select(
            "bin",
            (low + width * (F.col("bin") - 1)).alias("bin_start"),
            (low + width * F.col("bin")).alias("bin_end"),
            "product_count",
        )
    )


def eoq_histogram(t: Tables, bins: int = 50) -> DataFrame:
    return _histogram(inventory.eoq(t).select("eoq"), "eoq", bins)


def orders_per_year_histogram(t: Tables, bins: int = 30) -> DataFrame:
    return _histogram(inventory.eoq(t).select("orders_per_year"), "orders_per_year", bins)


def eoq_summary(t: Tables) -> DataFrame:
    return inventory.eoq(t).agg(
        F.sum("annual_inventory_cost").alias("total_annual_cost"),
        F.avg("orders_per_year").alias("avg_orders_per_year"),
        F.avg("days_between_orders").alias("avg_order_cycle_days"),
    )


def eoq_top(t: Tables, n: int = 10) -> DataFrame:
    return inventory.eoq(t).orderBy(F.desc_nulls_last("eoq"), "sku").limit(n)


# ---- carrying costs -------------------------------------------------------------------


def carrying_by_warehouse(t: Tables) -> DataFrame:
    sums = ["product_count", "total_units", "inventory_value", "total_carrying_cost"]
    return (
        inventory.carrying_costs(t)
        .groupBy("warehouse_code", "warehouse_name")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )


def carrying_components(t: Tables) -> DataFrame:
    """Total of each cost component, one row per component."""
    totals = inventory.carrying_costs(t).agg(*[F.sum(c).alias(c) for c in COMPONENT_LABELS])
    labels: Column = F.create_map(*[F.lit(x) for pair in COMPONENT_LABELS.items() for x in pair])
    return totals.unpivot([], list(COMPONENT_LABELS), "part", "amount").select(
        F.element_at(labels, F.col("part")).alias("component"), "amount"
    )


def carrying_totals(t: Tables) -> DataFrame:
    return inventory.carrying_costs(t).agg(
        F.sum("inventory_value").alias("total_value"),
        F.sum("total_carrying_cost").alias("total_carrying_cost"),
        F.sum("monthly_carrying_cost").alias("monthly_carrying_cost"),
    )


# ---- samples and console summaries ----------------------------------------------------


def _sample(df: DataFrame, n: int, seed: int, *key: str) -> DataFrame:
    """``n`` rows by the digest of seed and key: the same rows wherever the table lies."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), *key))
    return df.orderBy(draw, *key).limit(n)


def turnover_scatter_sample(t: Tables, n: int = 200, seed: int = 42) -> DataFrame:
    columns = ["sku", "product_name", "turnover_ratio", "inventory_value", "turnover_category"]
    return _sample(inventory.turnover(t), n, seed, "warehouse_code", "sku").select(*columns)


def reorder_scatter_sample(t: Tables, n: int = 100, seed: int = 42) -> DataFrame:
    columns = ["sku", "product_name", "current_rop", "calculated_rop", "recommendation"]
    return _sample(inventory.reorder_points(t), n, seed, "warehouse_code", "sku").select(*columns)


def abc_class_totals(t: Tables) -> DataFrame:
    return (
        abc.abc_mean_price(t)
        .groupBy("abc_class")
        .agg(F.count("product_id").alias("product_count"), F.sum("total_revenue").alias("total_revenue"))
    )


def supplier_summary_top10(t: Tables, lookback_days: int = 365) -> DataFrame:
    """The ten most reliable suppliers."""
    return supplier_top(t, 10, lookback_days).select("supplier_name", "reliability_score", "tier")


def carrying_cost_per_warehouse(t: Tables) -> DataFrame:
    return (
        inventory.carrying_costs(t)
        .groupBy("warehouse_code")
        .agg(F.sum("total_carrying_cost").alias("total_carrying_cost"))
    )
