"""Stock turnover, reorder points, order quantities, carrying costs, stock status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.expr import (
    CARRYING_RATE,
    DateLike,
    days_between,
    label_from,
    money,
    normal_quantile,
    ratio,
    round_int,
    round_to,
)
from stocklens.operators.sales import live_lines, months_back, sales_anchor
from stocklens.sources.tables import Tables

# Turnover classes, carrying cost components and the 95% service factor.
TURNOVER_STEPS = [(12, "Fast Moving"), (4, "Normal"), (1, "Slow Moving")]
DEAD_STOCK = "Dead Stock"
CARRYING_COMPONENTS = {
    "capital_cost": "0.08",
    "storage_cost": "0.05",
    "insurance_cost": "0.03",
    "obsolescence_cost": "0.02",
    "handling_cost": "0.02",
}
SERVICE_FACTOR_95 = 1.65


def _times(quantity: str, price: str) -> Column:
    return F.col(quantity).cast("decimal(18,0)") * F.col(price)


def _rate(r: str) -> Column:
    return F.lit(r).cast("decimal(3,2)")


# ---- turnover -------------------------------------------------------------------------


def _turnover_columns(stock: DataFrame) -> DataFrame:
    """Turnover figures from ``quantity_on_hand``, ``unit_cost`` and ``units_sold_12m``."""
    turned = ratio("cogs_12m", "current_inventory_value")
    return (
        stock.filter(F.col("quantity_on_hand") > 0)
        .withColumn("units_sold_12m", F.coalesce("units_sold_12m", F.lit(0)))
        .withColumn("current_inventory_value", _times("quantity_on_hand", "unit_cost"))
        .withColumn("cogs_12m", _times("units_sold_12m", "unit_cost"))
        .select(
            "product_id",
            "sku",
            "product_name",
            "warehouse_code",
            "quantity_on_hand",
            "current_inventory_value",
            "cogs_12m",
            "units_sold_12m",
            F.when(F.col("current_inventory_value") > 0, round_to(turned, 2))
            .otherwise(0.0)
            .alias("inventory_turnover_ratio"),
            F.when(
                F.col("cogs_12m") > 0,
                round_to(ratio(F.col("current_inventory_value") * 365, "cogs_12m"), 0),
            ).alias("days_inventory_on_hand"),
            label_from(turned, TURNOVER_STEPS, DEAD_STOCK).alias("turnover_category"),
        )
    )


def _stock(t: Tables, *stock_columns: str) -> DataFrame:
    return (
        t("inventory", "warehouse_id", "product_id", *stock_columns)
        .join(t("products", "product_id", "sku", "product_name", "unit_cost"), "product_id")
        .join(t("warehouses", "warehouse_id", "warehouse_code"), "warehouse_id")
    )


def turnover_sql(t: Tables) -> DataFrame:
    """Turnover per product and warehouse against the product's total demand.

    Demand counts every line of the product, at all warehouses, dates and order states;
    lines are summed per product first, so nothing multiplies in the join.
    """
    demand = (
        t("sales_order_items", "product_id", "quantity_ordered")
        .groupBy("product_id")
        .agg(F.sum("quantity_ordered").alias("units_sold_12m"))
    )
    return _turnover_columns(_stock(t, "quantity_on_hand").join(demand, "product_id", "left"))


def turnover_windowed(t: Tables, as_of: DateLike = None, months: int = 12) -> DataFrame:
    """Turnover per product and warehouse against that warehouse's recent live demand."""
    since = months_back(sales_anchor(t, as_of), months)
    demand = (
        live_lines(t, ["warehouse_id"], ["product_id", "quantity_ordered"], since)
        .groupBy("warehouse_id", "product_id")
        .agg(F.sum("quantity_ordered").alias("units_sold_12m"))
    )
    return _turnover_columns(_stock(t, "quantity_on_hand").join(demand, ["warehouse_id", "product_id"], "left"))


def turnover(t: Tables, warehouse_id: int | None = None) -> DataFrame:
    """Turnover on live demand per warehouse; days of supply are infinite without any.

    Stock that never sold has no cost on its demand row, hence no inventory value.
    """
    stock = t("inventory", "warehouse_id", "product_id", "quantity_on_hand")
    lines = live_lines(t, ["warehouse_id"], ["product_id", "quantity_ordered"])
    if warehouse_id is not None:
        stock = stock.filter(F.col("warehouse_id") == warehouse_id)
        lines = lines.filter(F.col("warehouse_id") == warehouse_id)
    cogs = (
        lines.groupBy("warehouse_id", "product_id")
        .agg(F.sum("quantity_ordered").alias("units"))
        .join(t("products", "product_id", "unit_cost"), "product_id")
        .select("warehouse_id", "product_id", "unit_cost", _times("units", "unit_cost").alias("cogs_annual"))
    )
    value = F.col("inventory_value")
    return (
        stock.join(cogs, ["warehouse_id", "product_id"], "left")
        .join(t("products", "product_id", "sku", "product_name"), "product_id")
        .join(t("warehouses", "warehouse_id", "warehouse_code"), "warehouse_id")
        .withColumn("inventory_value", _times("quantity_on_hand", "unit_cost"))
        .withColumn("cogs_annual", F.coalesce("cogs_annual", F.lit(0)))
        .withColumn("turnover_ratio", F.when(value > 0, ratio("cogs_annual", value)).otherwise(0.0))
        .withColumn(
            "days_of_supply",
            F.when(F.col("turnover_ratio") > 0, ratio(F.lit(365), "turnover_ratio")).otherwise(float("inf")),
        )
        .select(
            "warehouse_code",
            "sku",
            "product_name",
            "quantity_on_hand",
            "inventory_value",
            "cogs_annual",
            "turnover_ratio",
            "days_of_supply",
            label_from("turnover_ratio", TURNOVER_STEPS, DEAD_STOCK).alias("turnover_category"),
        )
    )


# ---- reorder points -------------------------------------------------------------------


def _daily_demand_stats(t: Tables, since: Column) -> DataFrame:
    """Mean and deviation of demand per warehouse and product, over days with demand."""
    daily = (
        live_lines(t, ["warehouse_id", "order_date"], ["product_id", "quantity_ordered"], since)
        .groupBy("warehouse_id", "product_id", "order_date")
        .agg(F.sum("quantity_ordered").alias("daily_qty"))
    )
    return daily.groupBy("warehouse_id", "product_id").agg(
        F.avg("daily_qty").alias("avg_demand"),
        F.coalesce(F.stddev_samp("daily_qty"), F.avg("daily_qty") * 0.3).alias("sd_demand"),
    )


def _safety_stock(z: float, lead: Column, sd_lead: Column) -> Column:
    avg, sd = F.col("avg_demand"), F.col("sd_demand")
    return z * F.sqrt(lead * sd * sd + avg * avg * (sd_lead * sd_lead))


def reorder_points_sql(t: Tables, as_of: DateLike = None, days: int = 90, lead_months: int = 12) -> DataFrame:
    """Reorder points from observed demand and observed supplier lead times.

    Without any delivery in the lead-time window the safety stock is unknown, and the
    recommendation stays ``Optimal``.
    """
    today = sales_anchor(t, as_of)
    delivered = t("purchase_orders", "po_id", "supplier_id", "order_date", "actual_delivery_date").filter(
        F.col("actual_delivery_date").isNotNull() & (F.col("order_date") >= months_back(today, lead_months))
    )
    lead_times = (
        delivered.join(t("purchase_order_items", "po_id", "product_id"), "po_id")
        .join(t("product_suppliers", "product_id", "supplier_id"), ["product_id", "supplier_id"])
        .groupBy("product_id")
        .agg(
            F.avg(days_between("actual_delivery_date", "order_date")).alias("avg_lead"),
            F.stddev_samp(days_between("actual_delivery_date", "order_date")).alias("sd_lead"),
        )
    )
    lead = F.coalesce("avg_lead", F.col("lead_time_days").cast("double"))
    sd_lead = F.coalesce("sd_lead", F.col("avg_lead") * 0.2)
    now = F.coalesce("reorder_point", F.lit(0)).cast("double")
    rop = F.col("calculated_reorder_point")
    return (
        _daily_demand_stats(t, F.date_sub(today, days))
        .join(t("inventory", "warehouse_id", "product_id", "quantity_on_hand", "reorder_point"), ["warehouse_id", "product_id"])
        .join(t("products", "product_id", "sku", "product_name", "lead_time_days"), "product_id")
        .join(t("warehouses", "warehouse_id", "warehouse_code"), "warehouse_id")
        .join(lead_times, "product_id", "left")
        .withColumn("safety", _safety_stock(SERVICE_FACTOR_95, lead, sd_lead))
        .withColumn("calculated_reorder_point", round_int(F.col("avg_demand") * lead + F.col("safety")))
        .select(
            "product_id",
            "sku",
            "product_name",
            "warehouse_code",
            "quantity_on_hand",
            round_to("avg_demand", 2).alias("avg_daily_demand"),
            round_to(lead, 0).alias("lead_time_days"),
            round_int("safety").alias("safety_stock"),
            "calculated_reorder_point",
            F.col("reorder_point").alias("current_reorder_point"),
            F.when(rop > now * 1.2, "Increase ROP")
            .when(rop < now * 0.8, "Decrease ROP")
            .otherwise("Optimal")
            .alias("recommendation"),
        )
    )


def reorder_points(
    t: Tables, service_level: float = 0.95, lookback_days: int = 90, as_of: DateLike = None
) -> DataFrame:
    """Reorder points for a service level, on each product's planned lead time."""
    since = F.date_sub(sales_anchor(t, as_of), lookback_days)
    lead = F.col("lead_time_days").cast("double")
    current, change = F.col("current_rop"), F.col("calculated_rop") - F.col("current_rop")
    return (
        _daily_demand_stats(t, since)
        .join(t("inventory", "warehouse_id", "product_id", "quantity_on_hand", "reorder_point"), ["warehouse_id", "product_id"])
        .join(t("products", "product_id", "sku", "product_name", "lead_time_days"), "product_id")
        .join(t("warehouses", "warehouse_id", "warehouse_code"), "warehouse_id")
        .withColumn("safety", _safety_stock(normal_quantile(service_level), lead, lead * 0.2))
        .withColumn("calculated_rop", round_int(F.col("avg_demand") * lead + F.col("safety")))
        .withColumn("current_rop", F.col("reorder_point"))
        .select(
            "warehouse_code",
            "sku",
            "product_name",
            "quantity_on_hand",
            F.col("avg_demand").alias("avg_daily_demand"),
            F.col("lead_time_days").alias("avg_lead_time"),
            round_int("safety").alias("safety_stock"),
            "current_rop",
            "calculated_rop",
            F.when(change > current * 0.2, "Increase ROP")
            .when(change < current * -0.2, "Decrease ROP")
            .otherwise("Optimal")
            .alias("recommendation"),
        )
    )


# ---- economic order quantity ----------------------------------------------------------


def eoq_sql(
    t: Tables, as_of: DateLike = None, ordering_cost: str = "50.00", holding_rate: str = "0.25", months: int = 12
) -> DataFrame:
    """Economic order quantity on recent demand; every figure from the unrounded optimum."""
    since = months_back(sales_anchor(t, as_of), months)
    demand = (
        live_lines(t, [], ["product_id", "quantity_ordered"], since)
        .groupBy("product_id")
        .agg(F.sum("quantity_ordered").alias("annual_demand"))
        .filter(F.col("annual_demand") > 0)
    )
    order_cost = F.lit(ordering_cost).cast("decimal(10,2)")
    holding = F.col("unit_cost") * F.lit(holding_rate).cast("decimal(6,4)")
    d, s, h = (c.cast("double") for c in (F.col("annual_demand"), order_cost, holding))
    best = F.col("best")
    return (
        demand.join(t("products", "product_id", "sku", "product_name", "unit_cost"), "product_id")
        .withColumn("best", F.sqrt(ratio(2 * d * s, h)))
        .select(
            "product_id",
            "sku",
            "product_name",
            "unit_cost",
            "annual_demand",
            order_cost.alias("ordering_cost"),
            money(holding).alias("annual_holding_cost_per_unit"),
            round_int(best).alias("economic_order_quantity"),
            round_to(ratio(d, best), 1).alias("orders_per_year"),
            round_int(ratio(F.lit(365), ratio(d, best))).alias("days_between_orders"),
            round_to(F.sqrt(2 * d * s * h), 2).alias("optimal_annual_cost"),
        )
    )


def eoq(t: Tables, ordering_cost: float = 50.0, holding_cost_rate: float = 0.25) -> DataFrame:
    """Economic order quantity on all demand; each figure from the rounded one before it."""
    demand = (
        live_lines(t, [], ["product_id", "quantity_ordered"])
        .groupBy("product_id")
        .agg(F.sum("quantity_ordered").alias("annual_demand"))
    )
    d = F.col("annual_demand").cast("double")
    h = F.col("unit_cost").cast("double") * F.lit(float(holding_cost_rate))
    s = F.lit(float(ordering_cost))
    return (
        demand.join(t("products", "product_id", "sku", "product_name", "unit_cost"), "product_id")
        .withColumn("eoq", round_int(F.sqrt(ratio(2 * d * s, h))))
        .withColumn("orders_per_year", round_to(ratio(d, "eoq"), 1))
        .select(
            "product_id",
            "sku",
            "product_name",
            "unit_cost",
            "annual_demand",
            "eoq",
            "orders_per_year",
            round_to(ratio(F.lit(365), "orders_per_year"), 0).alias("days_between_orders"),
            round_to(F.sqrt(2 * d * s * h), 2).alias("annual_inventory_cost"),
        )
    )


# ---- carrying costs -------------------------------------------------------------------


def _valued_stock(t: Tables) -> DataFrame:
    return (
        t("inventory", "warehouse_id", "product_id", "quantity_on_hand")
        .join(t("products", "product_id", "category_id", "unit_cost"), "product_id")
        .withColumn("value", _times("quantity_on_hand", "unit_cost"))
    )


def _named_groups(t: Tables, sums: DataFrame) -> DataFrame:
    return sums.join(t("warehouses", "warehouse_id", "warehouse_code", "warehouse_name"), "warehouse_id").join(
        t("product_categories", "category_id", "category_name"), "category_id", "left"
    )


def carrying_costs_sql(t: Tables) -> DataFrame:
    """Carrying cost per warehouse and category of stock on hand; a missing category counts."""
    # A product has one category, so distinct products add up over categories and names; the
    # inner grouping does the distinct once, on the stock grain.
    sums = (
        _valued_stock(t)
        .filter(F.col("quantity_on_hand") > 0)
        .groupBy("warehouse_id", "category_id", "product_id")
        .agg(F.sum("quantity_on_hand").alias("units"), F.sum("value").alias("value"))
        .groupBy("warehouse_id", "category_id")
        .agg(F.count("*").alias("products"), F.sum("units").alias("units"), F.sum("value").alias("value"))
    )
    value = F.col("inventory_value")
    total = value * _rate(CARRYING_RATE)
    names = {"obsolescence_cost": "obsolescence_risk"}
    parts = [money(value * _rate(r)).alias(names.get(c, c)) for c, r in CARRYING_COMPONENTS.items()]
    return (
        _named_groups(t, sums)
        .groupBy("warehouse_code", "warehouse_name", "category_name")
        .agg(
            F.sum("products").alias("product_count"),
            F.sum("units").alias("total_units"),
            F.sum("value").alias("inventory_value"),
        )
        .select(
            "warehouse_code",
            "warehouse_name",
            "category_name",
            "product_count",
            "total_units",
            "inventory_value",
            *parts,
            money(total).alias("total_carrying_cost"),
            round_to(ratio(total, F.lit(12)), 2).alias("monthly_carrying_cost"),
        )
    )


def carrying_costs(t: Tables) -> DataFrame:
    """Carrying cost per warehouse and category of all stock; a missing category is left out."""
    sums = (
        _valued_stock(t)
        .groupBy("warehouse_id", "category_id")
        .agg(
            F.count("product_id").alias("product_count"),
            F.sum("quantity_on_hand").alias("total_units"),
            F.sum("value").alias("inventory_value"),
        )
    )
    value = F.col("inventory_value")
    total = value * _rate(CARRYING_RATE)
    return (
        _named_groups(t, sums)
        .filter(F.col("category_name").isNotNull())
        .groupBy("warehouse_code", "warehouse_name", "category_name")
        .agg(*[F.sum(c).alias(c) for c in ("product_count", "total_units", "inventory_value")])
        .select(
            "warehouse_code",
            "warehouse_name",
            "category_name",
            "product_count",
            "total_units",
            money(value).alias("inventory_value"),
            *[money(value * _rate(r)).alias(c) for c, r in CARRYING_COMPONENTS.items()],
            money(total).alias("total_carrying_cost"),
            round_to(ratio(total, F.lit(12)), 2).alias("monthly_carrying_cost"),
        )
    )


# ---- status view ----------------------------------------------------------------------


def inventory_status(t: Tables) -> DataFrame:
    """Stock rows with value and status; without a reorder point a row is in stock."""
    free, rop = F.col("quantity_available"), F.col("reorder_point")
    status = (
        F.when(free <= 0, "Out of Stock")
        .when(free <= rop, "Reorder")
        .when(free <= rop * 1.5, "Low Stock")
        .otherwise("In Stock")
    )
    dates = [c for c in ("last_received_date", "last_sold_date") if c in t.columns("inventory")]
    return (
        t(
            "inventory", "inventory_id", "warehouse_id", "product_id", "quantity_on_hand",
            "quantity_reserved", "quantity_available", "reorder_point", *dates,
        )
        .join(t("warehouses", "warehouse_id", "warehouse_code", "warehouse_name"), "warehouse_id")
        .join(t("products", "product_id", "sku", "product_name", "category_id", "unit_cost"), "product_id")
        .join(t("product_categories", "category_id", "category_name"), "category_id", "left")
        .select(
            "inventory_id", "warehouse_code", "warehouse_name", "sku", "product_name",
            "category_name", "quantity_on_hand", "quantity_reserved", "quantity_available",
            "reorder_point", "unit_cost",
            _times("quantity_on_hand", "unit_cost").alias("inventory_value"),
            status.alias("stock_status"),
            *dates,
        )
    )
