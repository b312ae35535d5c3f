"""Stockout, fulfilment, forecast, ledger and data-quality queries."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from stocklens.operators import forecast, fulfilment, ledger, quality, stockouts
from stocklens.sources.tables import Tables
from suite.core import SHARED, band, query, rounded, shared_folder


def _folder(t: Tables) -> str:
    return shared_folder(t("products", "product_id").sparkSession)


# ---- stockouts ------------------------------------------------------------------------

# The year up to the latest event; an event still open lasts until then.
SHARED["recent_stockouts"] = """
    WITH latest AS (SELECT max(stockout_start_date) AS now FROM stockout_events)
    SELECT e.*, (epoch_us(COALESCE(stockout_end_date, now)) - epoch_us(stockout_start_date)) / 86400000000.0 AS lasted
    FROM stockout_events e, latest
    WHERE CAST(stockout_start_date AS DATE) >= CAST(now AS DATE) - INTERVAL 12 MONTH"""

query(
    "stockout_impact_sql",
    "warehouse_code:s sku:s product_name:s category_name:s stockout_count:i avg_stockout_duration_days:r1 lost_units:i "
    "lost_revenue:m last_stockout_date:t severity_score:f",
    stockouts.stockout_impact_sql,
    f"""
    WITH harm AS (
      SELECT warehouse_id, product_id, COUNT(*) AS stockout_count, max(stockout_start_date) AS last_stockout_date,
             AVG(CAST(lasted AS DOUBLE)) AS avg_stockout_duration_days, SUM(demand_during_stockout) AS lost_units,
             SUM(lost_sales_amount) AS lost_revenue
      FROM recent_stockouts GROUP BY ALL)
    SELECT harm.*, warehouse_code, sku, product_name,
           (SELECT category_name FROM product_categories k WHERE k.category_id = p.category_id) AS category_name,
           {rounded("stockout_count * 30 + avg_stockout_duration_days * 10 + CAST(COALESCE(lost_revenue, 0) AS DOUBLE) / 100", 0)}
             AS severity_score
    FROM harm JOIN products p USING (product_id) JOIN warehouses USING (warehouse_id)
    ORDER BY severity_score DESC, warehouse_code, sku LIMIT 50""",
)

query(
    "stockouts_by_weekday",
    "day_of_week:s dow_num:i stockout_count:i lost_revenue:m",
    stockouts.stockouts_by_weekday,
    """
    SELECT dow_num, strftime(any_value(stockout_start_date), '%A') AS day_of_week, COUNT(*) AS stockout_count,
           SUM(lost_sales_amount) AS lost_revenue
    FROM (SELECT *, isodow(stockout_start_date) % 7 AS dow_num FROM recent_stockouts) GROUP BY dow_num""",
)

SHARED["stockout_rows"] = f"""
    SELECT warehouse_code, sku, product_name, stockout_count, {rounded("days", 1)} AS avg_duration_days,
           total_lost_units, total_lost_revenue,
           {rounded("stockout_count * 30 + days * 10 + CAST(total_lost_revenue AS DOUBLE) / 100", 0)} AS severity_score
    FROM (SELECT warehouse_id, product_id, COUNT(stockout_id) AS stockout_count,
                 AVG(CAST(floor((epoch_us(stockout_end_date) - epoch_us(stockout_start_date))
                                / CAST(86400000000 AS DOUBLE)) AS BIGINT)) AS days,
                 SUM(demand_during_stockout) AS total_lost_units, SUM(lost_sales_amount) AS total_lost_revenue
          FROM stockout_events GROUP BY ALL)
    JOIN products USING (product_id) JOIN warehouses USING (warehouse_id)"""
STOCKOUT_COLUMNS = (
    "warehouse_code:s sku:s product_name:s stockout_count:i avg_duration_days:f total_lost_units:i "
    "total_lost_revenue:m severity_score:f"
)
query("stockout_impact", STOCKOUT_COLUMNS, stockouts.stockout_impact, "SELECT * FROM stockout_rows")

SHARED["root_cause_rows"] = f"""
    SELECT root_cause, COUNT(stockout_id) AS occurrence_count, SUM(lost_sales_amount) AS total_lost_revenue,
           SUM(demand_during_stockout) AS total_lost_units,
           {rounded('''CAST(COUNT(stockout_id) AS DOUBLE)
             / (SELECT COUNT(*) FROM stockout_events WHERE root_cause IS NOT NULL) * 100''', 2)} AS pct_of_stockouts
    FROM stockout_events WHERE root_cause IS NOT NULL GROUP BY root_cause"""
query(
    "stockout_root_causes",
    "root_cause:s occurrence_count:i total_lost_revenue:m total_lost_units:i pct_of_stockouts:f",
    stockouts.stockout_root_causes,
    "SELECT * FROM root_cause_rows",
)

# ---- fulfilment and forecasts ---------------------------------------------------------

query(
    "fill_rate_service",
    "warehouse_code:s warehouse_name:s total_orders:i total_line_items:i total_units_ordered:i total_units_shipped:i "
    "unit_fill_rate:r2 line_fill_rate:r2 order_fill_rate:r2 order_fill_rate_strict:r2 service_grade:s",
    fulfilment.fill_rate_service,
    f"""
    WITH orders_seen AS (
      SELECT warehouse_id, so_id, COUNT(*) AS lines, SUM(quantity_ordered) AS wanted, SUM(quantity_shipped) AS sent,
             COUNT(*) FILTER (quantity_shipped >= quantity_ordered) AS full_lines
      FROM sales_order_items JOIN sales_orders USING (so_id)
      WHERE NOT status IN ('Pending', 'Cancelled') AND order_date >= (SELECT d - INTERVAL 3 MONTH FROM anchor)
      GROUP BY ALL),
    sites AS (
      SELECT warehouse_id, COUNT(*) AS total_orders, SUM(lines) AS total_line_items, SUM(wanted) AS total_units_ordered,
             SUM(sent) AS total_units_shipped, CAST(SUM(sent) AS DOUBLE) / NULLIF(SUM(wanted), 0) AS served,
             CAST(SUM(full_lines) AS DOUBLE) / SUM(lines) * 100 AS line_fill_rate,
             AVG(CAST(full_lines > 0 AS INT)) * 100 AS order_fill_rate,
             AVG(CAST(full_lines = lines AS INT)) * 100 AS order_fill_rate_strict
      FROM orders_seen GROUP BY warehouse_id)
    SELECT sites.*, warehouse_code, warehouse_name, served * 100 AS unit_fill_rate,
           {band("served", [(0.98, "A"), (0.95, "B"), (0.90, "C")], "D", rising=False)} AS service_grade
    FROM sites JOIN warehouses USING (warehouse_id)""",
)

SHARED["daily_demand_rows"] = """
    SELECT order_date, product_id, SUM(quantity_ordered) AS quantity_ordered
    FROM sales_order_items JOIN sales_orders USING (so_id)
    WHERE status <> 'Cancelled' GROUP BY order_date, product_id"""
# The gap-filled series the forecasts are defined on: one row per product and day.
SHARED["demand_series"] = """
    SELECT s.product_id, s.day, COALESCE(dd.quantity_ordered, 0) AS q,
           ROW_NUMBER() OVER (PARTITION BY s.product_id ORDER BY s.day DESC) AS from_end
    FROM (SELECT product_id, CAST(unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS DATE)
                 AS day
          FROM daily_demand_rows GROUP BY product_id) s
    LEFT JOIN daily_demand_rows dd ON dd.product_id = s.product_id AND dd.order_date = s.day"""

query("daily_demand", "order_date:d product_id:i quantity_ordered:i", forecast.daily_demand, "SELECT * FROM daily_demand_rows")

_AHEAD = "CAST(unnest(generate_series(last_day + 1, last_day + 30, INTERVAL 1 DAY)) AS DATE) AS date"

query(
    "moving_average_forecast",
    "product_id:i date:d forecasted_quantity:i method:s",
    forecast.moving_average_forecast,
    f"""
    SELECT product_id, {_AHEAD}, CAST(round_even(level, 0) AS BIGINT) AS forecasted_quantity,
           'Moving Average' AS method
    FROM (SELECT product_id, max(day) AS last_day, avg(q) AS level
          FROM demand_series WHERE from_end <= 7 GROUP BY product_id)""",
)

query(
    "exponential_smoothing_forecast",
    "product_id:i date:d forecasted_quantity:i method:s",
    forecast.exponential_smoothing_forecast,
    f"""
    SELECT product_id, {_AHEAD}, CAST(round_even(level, 0) AS BIGINT) AS forecasted_quantity,
           'Exponential Smoothing' AS method
    FROM (SELECT product_id, max(day) AS last_day,
                 list_reduce(list(CAST(q AS DOUBLE) ORDER BY day),
                             lambda s, x: CAST(0.3 AS DOUBLE) * x + CAST(0.7 AS DOUBLE) * s) AS level
          FROM demand_series GROUP BY product_id)""",
)



def _accuracy_sql(days: int) -> str:
    """Demand is what the live orders of the forecast's day and site hold, nothing being zero."""
    return f"""
    WITH sold AS (
      SELECT product_id, warehouse_id, order_date, SUM(quantity_ordered) AS units
      FROM sales_orders JOIN sales_order_items USING (so_id)
      WHERE status <> 'Cancelled' GROUP BY ALL),
    scored AS (
      SELECT d.product_id, d.warehouse_id, d.model_used, d.forecasted_quantity - COALESCE(s.units, 0) AS over, s.units
      FROM (SELECT * FROM demand_forecasts
            WHERE forecast_period = 'Daily' AND (SELECT d FROM anchor) - forecast_date BETWEEN 0 AND {days}) d
      LEFT JOIN sold s ON (s.product_id, s.warehouse_id, s.order_date)
                        = (d.product_id, d.warehouse_id, d.forecast_date)),
    graded AS (
      SELECT product_id, warehouse_id, model_used, COUNT(*) AS forecast_periods,
             AVG(100 * ABS(over) / CAST(units AS DOUBLE)) FILTER (WHERE units > 0) AS mape,
             AVG(ABS(over)) AS mae, AVG(over) AS forecast_bias
      FROM scored GROUP BY ALL)
    SELECT sku, product_name, warehouse_code, g.* EXCLUDE (product_id, warehouse_id),
           CASE WHEN mape IS NULL OR mape > 30 THEN 'Poor' WHEN mape > 20 THEN 'Fair' WHEN mape > 10 THEN 'Good'
                ELSE 'Excellent' END AS accuracy_grade
    FROM graded g JOIN products USING (product_id) JOIN warehouses USING (warehouse_id)"""


_ACCURACY_COLUMNS = (
    "sku:s product_name:s warehouse_code:s model_used:s forecast_periods:i mape:r2 mae:r2 forecast_bias:r2 "
    "accuracy_grade:s"
)
query("forecast_accuracy", _ACCURACY_COLUMNS, forecast.forecast_accuracy, _accuracy_sql(90))
query(
    "forecast_accuracy_year",
    _ACCURACY_COLUMNS,
    lambda t: forecast.forecast_accuracy(t, days=365),
    _accuracy_sql(365),
)

# ---- ledger and derived tables --------------------------------------------------------

SHARED["ledger_rows"] = """
    SELECT 'PO-' || po_item_id AS transaction_id, warehouse_id, product_id, 'Receipt' AS transaction_type, quantity_received AS quantity,
           'PO' AS reference_type, CAST(po_id AS VARCHAR) AS reference_id, unit_cost, actual_delivery_date AS transaction_date
    FROM purchase_order_items JOIN purchase_orders USING (po_id)
    WHERE status = 'Delivered' AND quantity_received > 0
    UNION ALL
    SELECT 'SO-' || so_item_id, warehouse_id, product_id, 'Sale', -quantity_shipped, 'SO', CAST(so_id AS VARCHAR), products.unit_cost,
           actual_ship_date
    FROM sales_order_items JOIN sales_orders USING (so_id) JOIN products USING (product_id)
    WHERE status IN ('Shipped', 'Delivered') AND quantity_shipped > 0"""

query(
    "inventory_ledger",
    "transaction_id:s warehouse_id:i product_id:i transaction_type:s quantity:i reference_type:s reference_id:s unit_cost:m "
    "transaction_date:d",
    lambda t: ledger.inventory_ledger(t, _folder(t)),
    "SELECT * FROM ledger_rows",
)

query(
    "order_totals",
    "order_kind:s order_id:s total_amount:m lines_total:m difference:m",
    ledger.order_totals,
    """
    WITH s AS (
      SELECT so_id, CAST(ROUND(SUM(CAST(quantity_ordered AS DECIMAL(10,0)) * unit_price
               * (CAST(100 AS DECIMAL(3,0)) - discount_percent) * CAST(0.01 AS DECIMAL(2,2))), 2)
             AS DECIMAL(14,2)) AS lines_total
      FROM sales_order_items GROUP BY so_id),
    p AS (SELECT po_id, CAST(SUM(CAST(quantity_ordered AS DECIMAL(10,0)) * unit_cost) AS DECIMAL(14,2)) AS lines_total
          FROM purchase_order_items GROUP BY po_id)
    SELECT 'SO' AS order_kind, CAST(so_id AS VARCHAR) AS order_id, total_amount, lines_total,
           total_amount - lines_total AS difference
    FROM sales_orders LEFT JOIN s USING (so_id)
    UNION ALL
    SELECT 'PO', CAST(po_id AS VARCHAR), total_amount, lines_total, total_amount - lines_total
    FROM purchase_orders LEFT JOIN p USING (po_id)""",
)

query(
    "reorder_policy",
    "warehouse_id:i product_id:i avg_daily_demand:f reorder_point:i reorder_quantity:i",
    ledger.reorder_policy,
    """
    WITH span AS (SELECT greatest(max(order_date) - min(order_date), 1) AS days FROM sales_orders
                  WHERE status <> 'Cancelled')
    SELECT warehouse_id, product_id, CAST(SUM(quantity_ordered) AS DOUBLE) / (SELECT days FROM span) AS avg_daily_demand,
           SUM(quantity_ordered) * (lead_time_days + safety_stock_days) // (SELECT days FROM span) AS reorder_point,
           SUM(quantity_ordered) * 30 // (SELECT days FROM span) AS reorder_quantity
    FROM sales_order_items JOIN sales_orders USING (so_id) JOIN products USING (product_id)
    WHERE status <> 'Cancelled'
    GROUP BY warehouse_id, product_id, lead_time_days, safety_stock_days""",
)

query(
    "stockout_candidates",
    "warehouse_id:i product_id:i quantity_on_hand:i reorder_point:i",
    ledger.stockout_candidates,
    "SELECT * FROM inventory WHERE quantity_on_hand < reorder_point * 0.5",
)

query(
    "seasonality_profile",
    "period:s number:i days:i units:i avg_daily_units:f demand_index:f",
    ledger.seasonality_profile,
    """
    WITH daily AS (
      SELECT order_date, SUM(quantity_ordered) AS u FROM sales_order_items JOIN sales_orders USING (so_id)
      WHERE status <> 'Cancelled' GROUP BY order_date),
    p AS (SELECT 'month' AS period, month(order_date) AS number, u FROM daily
          UNION ALL SELECT 'weekday', dayofweek(order_date), u FROM daily)
    SELECT period, number, COUNT(*) AS days, SUM(u) AS units, CAST(SUM(u) AS DOUBLE) / COUNT(*) AS avg_daily_units,
           CAST(SUM(u) AS DOUBLE) / COUNT(*) / (SELECT CAST(SUM(u) AS DOUBLE) / COUNT(*) FROM daily) AS demand_index
    FROM p GROUP BY period, number""",
)

# The ledger stands for the movements table.
def with_ledger(t: Tables, folder: str | None = None) -> Tables:
    return t.replaced(inventory_transactions=ledger.inventory_ledger(t, folder))


SHARED["inventory_transactions"] = "SELECT * FROM ledger_rows"

# Tables of the mapping, and the date column of those that have one.
_TABLES = [
    "warehouses", "product_categories", "products", "suppliers", "product_suppliers", "customers",
    "sales_orders", "sales_order_items", "purchase_orders", "purchase_order_items", "inventory",
    "stockout_events", "demand_forecasts", "inventory_transactions",
]
_DATED = {"sales_orders": "order_date", "purchase_orders": "order_date", "stockout_events": "stockout_start_date"}


def _count_sql(name: str) -> str:
    day = f"CAST({_DATED[name]} AS DATE)" if name in _DATED else "CAST(NULL AS DATE)"
    return (
        f"SELECT '{name}' AS table_name, COUNT(*) AS row_count, MIN({day}) AS first_date, MAX({day}) AS last_date "
        f"FROM {name}"
    )


query(
    "table_counts",
    "table_name:s row_count:i first_date:d last_date:d",
    lambda t: ledger.table_counts(with_ledger(t)),
    "\nUNION ALL ".join(_count_sql(n) for n in _TABLES),
)

# ---- data quality ---------------------------------------------------------------------


# What the data model declares, written down once more for the checks: the columns of the mapping.
_KEYS = """
warehouses: warehouse_id / warehouse_code
product_categories: category_id
products: product_id / sku
suppliers: supplier_id / supplier_code
product_suppliers: product_id,supplier_id
customers: customer_id / customer_code
purchase_orders: po_id / po_number
purchase_order_items: po_item_id
sales_orders: so_id / so_number
sales_order_items: so_item_id
inventory: inventory_id / warehouse_id,product_id
demand_forecasts: product_id,warehouse_id,forecast_date,forecast_period
stockout_events: stockout_id
inventory_transactions: transaction_id"""
_MANDATORY = """
warehouses: warehouse_code warehouse_name city state capacity_units
product_categories: category_name
products: sku product_name unit_cost unit_price
suppliers: supplier_code supplier_name
product_suppliers: unit_cost lead_time_days
customers: customer_code customer_name
purchase_orders: po_number order_date expected_delivery_date
purchase_order_items: quantity_ordered unit_cost
sales_orders: so_number order_date
sales_order_items: quantity_ordered unit_price
inventory: quantity_on_hand quantity_reserved
demand_forecasts: forecast_date forecasted_quantity
stockout_events: stockout_start_date
inventory_transactions: quantity transaction_date"""
_POINTS_TO = """
product_categories.parent_category_id product_categories.category_id
products.category_id product_categories.category_id
product_suppliers.product_id products.product_id
product_suppliers.supplier_id suppliers.supplier_id
purchase_orders.supplier_id suppliers.supplier_id
purchase_orders.warehouse_id warehouses.warehouse_id
purchase_order_items.po_id purchase_orders.po_id
purchase_order_items.product_id products.product_id
sales_orders.customer_id customers.customer_id
sales_orders.warehouse_id warehouses.warehouse_id
sales_order_items.so_id sales_orders.so_id
sales_order_items.product_id products.product_id
inventory.warehouse_id warehouses.warehouse_id
inventory.product_id products.product_id
inventory_transactions.warehouse_id warehouses.warehouse_id
inventory_transactions.product_id products.product_id
demand_forecasts.product_id products.product_id
demand_forecasts.warehouse_id warehouses.warehouse_id
stockout_events.warehouse_id warehouses.warehouse_id
stockout_events.product_id products.product_id"""
_VALUES = {
    "customers.customer_type": "Retail Wholesale Distributor Direct",
    "purchase_orders.status": "Draft Submitted Confirmed Shipped Delivered Cancelled",
    "sales_orders.status": "Pending Confirmed Picking Shipped Delivered Cancelled",
    "inventory_transactions.transaction_type": "Receipt Sale Transfer_In Transfer_Out Adjustment Return Damaged",
    "demand_forecasts.forecast_period": "Daily Weekly Monthly",
}
# Lengths of texts; digits and decimals of numbers.
_SIZES = """
warehouses: warehouse_code 10, warehouse_name 100, city 100, state 50, latitude 10.8, longitude 11.8
warehouses: operating_cost_per_unit 10.2
product_categories: category_name 100
products: sku 50, product_name 200, unit_cost 12.2, unit_price 12.2
suppliers: supplier_code 20, supplier_name 200, city 100, state 50, country 50, quality_rating 3.2
product_suppliers: unit_cost 12.2
customers: customer_code 20, customer_name 200, customer_type 50, city 100, state 50, country 50, credit_limit 12.2
purchase_orders: po_number 30, status 30, total_amount 14.2
purchase_order_items: unit_cost 12.2, line_total 14.2
sales_orders: so_number 30, status 30, total_amount 14.2, shipping_cost 10.2
sales_order_items: unit_price 12.2, discount_percent 5.2, line_total 14.2
inventory_transactions: transaction_type 30, reference_type 30, unit_cost 12.2
demand_forecasts: forecast_period 20, model_used 50
stockout_events: lost_sales_amount 14.2, root_cause 100"""


def _listed(text: str) -> list[tuple[str, str]]:
    return [tuple(line.split(": ")) for line in text.strip().split("\n")]


def _all(selects: Iterable[str]) -> str:
    return "\nUNION ALL ".join(selects)


def _unique_sql() -> str:
    return _all(
        f"SELECT '{table}' AS table_name, '{key}' AS columns, COUNT(*) FILTER (n > 1) AS duplicated_keys, "
        f"COALESCE(SUM(n - 1), 0) AS surplus_rows FROM (SELECT COUNT(*) AS n FROM {table} "
        f"WHERE ({key.replace(',', ' IS NOT NULL) AND (')} IS NOT NULL) GROUP BY {key})"
        for table, keys in _listed(_KEYS)
        for key in keys.split(" / ")
    )


def _required_sql() -> str:
    return _all(
        f"SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT(*) - COUNT({c}) AS violations FROM {table}"
        for table, columns in _listed(_MANDATORY)
        for c in columns.split()
    )


def _references_sql() -> str:
    out = []
    for line in _POINTS_TO.strip().split("\n"):
        (child, c), (parent, key) = (x.split(".") for x in line.split())
        out.append(
            f"SELECT '{child}' AS table_name, '{c}' AS column_name, '{parent}' AS parent_table, COUNT(*) AS orphan_rows "
            f"FROM (SELECT {c} AS v FROM {child} WHERE {c} IS NOT NULL) ANTI JOIN (SELECT {key} AS v FROM {parent}) USING (v)"
        )
    return _all(out)


def _allowed_sql() -> str:
    out = []
    for where, values in _VALUES.items():
        table, c = where.split(".")
        out.append(
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, {c} AS value, COUNT(*) AS violations FROM {table} "
            f"WHERE NOT list_contains(string_split('{values}', ' '), {c}) GROUP BY {c}"
        )
    return _all(out)


def _fits_sql() -> str:
    out = []
    for table, sizes in _listed(_SIZES):
        for size in sizes.split(", "):
            c, limit = size.split()
            digits, _, scale = limit.partition(".")
            bad = f"length({c}) > {digits}"
            if scale:
                bad = f"abs({c}) >= {10 ** (int(digits) - int(scale))} OR {c} <> round({c}, {scale})"
            out.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT(*) FILTER ({bad}) AS violations FROM {table}")
    return _all(out)


_RATING_SQL = """
    SELECT 'suppliers' AS table_name, 'quality_rating' AS column_name,
           COUNT(*) FILTER (quality_rating < 0 OR quality_rating > 5) AS violations FROM suppliers"""

def _unique(t: Tables) -> DataFrame:
    folder = _folder(t)
    return quality.check_unique(with_ledger(t, f"{folder}/ledger"), folder=f"{folder}/counts")


query("dq_unique", "table_name:s columns:s duplicated_keys:i surplus_rows:i", _unique, _unique_sql())
query("dq_required", "table_name:s column_name:s violations:i", lambda t: quality.check_required(with_ledger(t)), _required_sql())
query(
    "dq_references",
    "table_name:s column_name:s parent_table:s orphan_rows:i",
    lambda t: quality.check_references(with_ledger(t)),
    _references_sql(),
)
query(
    "dq_allowed",
    "table_name:s column_name:s value:s violations:i",
    lambda t: quality.check_allowed(with_ledger(t)),
    _allowed_sql(),
)
query("dq_ranges", "table_name:s column_name:s violations:i", quality.check_ranges, _RATING_SQL)
query("dq_fits", "table_name:s column_name:s violations:i", lambda t: quality.check_fits(with_ledger(t)), _fits_sql())
