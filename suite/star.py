"""Star schema queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.functions.expr import days_between, round_int
from stocklens.operators.sales import sales_anchor
from stocklens.plans import star, versions
from stocklens.sources.tables import Tables, kept
from suite.core import SHARED, band, query, rated, rounded, shared_folder

# The mapping's warehouses lie in one state per region; a fixed mapping names the regions.
REGIONS = {"AFRICA": "South", "AMERICA": "West", "ASIA": "East", "EUROPE": "North"}


def _day(t: Tables) -> Column:
    return sales_anchor(t)


def _folder(t: Tables) -> str:
    return shared_folder(t("products", "product_id").sparkSession)


def _products(t: Tables) -> DataFrame:
    return star.product_versions(t, _day(t))


def _fact_sales(t: Tables) -> DataFrame:
    return star.fact_sales(t, _products(t), star.customer_versions(t, _day(t)), star.dim_warehouse(t, REGIONS))


def _fact_purchases(t: Tables, folder: str | None = None) -> DataFrame:
    keys = _products(t), star.supplier_versions(t, _day(t)), star.dim_warehouse(t, REGIONS)
    return star.fact_purchases(t, *keys, folder=folder)


def _fact_inventory(t: Tables) -> DataFrame:
    return star.fact_inventory_daily(t, _products(t), star.dim_warehouse(t, REGIONS))


_EPOCH = "(SELECT d FROM anchor) - DATE '1970-01-01'"


def _key(business_key: str) -> str:
    return f"{business_key} * 100000 + ({_EPOCH})"


_VERSION = "(SELECT d FROM anchor) AS effective_date, CAST(NULL AS DATE) AS expiration_date, TRUE AS is_current"
_VERSION_COLUMNS = "effective_date:d expiration_date:d is_current:b"


def _date_key(d: str) -> str:
    return f"CAST(strftime({d}, '%Y%m%d') AS INT)"


# ---- dimensions -----------------------------------------------------------------------

SHARED["dim_date"] = f"""
    SELECT {_date_key("f")} AS date_key, f AS full_date, dayofweek(f) AS day_of_week, strftime(f, '%a') AS day_name,
           day(f) AS day_of_month, dayofyear(f) AS day_of_year, weekofyear(f) AS week_of_year, month(f) AS month_num,
           strftime(f, '%b') AS month_name, quarter(f) AS quarter, year(f) AS year,
           dayofweek(f) IN (0, 6) AS is_weekend, FALSE AS is_holiday, quarter(f) AS fiscal_quarter,
           year(f) AS fiscal_year
    FROM (SELECT CAST(unnest(generate_series(min(order_date), max(order_date), INTERVAL 1 DAY)) AS DATE) AS f
          FROM sales_orders)"""
query(
    "dim_date",
    "date_key:i full_date:d day_of_week:i day_name:s day_of_month:i day_of_year:i week_of_year:i month_num:i "
    "month_name:s quarter:i year:i is_weekend:b is_holiday:b fiscal_quarter:i fiscal_year:i",
    star.order_calendar,
    "SELECT * FROM dim_date",
)

SHARED["dim_product"] = f"""
    SELECT {_key("p.product_id")} AS product_key, p.*, pc.category_name,
           {rounded("CAST(unit_price - unit_cost AS DOUBLE) / NULLIF(CAST(unit_price AS DOUBLE), 0) * 100", 2)}
             AS profit_margin,
           a.abc_class, r.reorder_point,
           CAST({rounded("d.avg_daily_demand * p.safety_stock_days", 0)} AS BIGINT) AS safety_stock, {_VERSION}
    FROM products p LEFT JOIN product_categories pc ON pc.category_id = p.category_id
    LEFT JOIN abc_all_lines a ON a.product_id = p.product_id
    LEFT JOIN demand_rate d ON d.product_id = p.product_id
    LEFT JOIN (SELECT product_id, SUM(reorder_point) AS reorder_point FROM inventory GROUP BY product_id) r
           ON r.product_id = p.product_id"""
query(
    "dim_product",
    "product_key:i product_id:i sku:s product_name:s category_name:s unit_cost:m unit_price:m profit_margin:m "
    f"abc_class:s lead_time_days:i reorder_point:i safety_stock:i is_active:b {_VERSION_COLUMNS}",
    lambda t: star.dim_product(t, _day(t)),
    "SELECT * FROM dim_product",
)

SHARED["dim_supplier"] = f"""
    SELECT {_key("s.supplier_id")} AS supplier_key, s.*, r.reliability_score, r.tier AS reliability_tier, {_VERSION}
    FROM suppliers s LEFT JOIN supplier_score_rows r ON r.supplier_id = s.supplier_id"""
query(
    "dim_supplier",
    "supplier_key:i supplier_id:i supplier_code:s supplier_name:s city:s state:s country:s payment_terms_days:i "
    f"quality_rating:m reliability_score:m reliability_tier:s is_preferred:b is_active:b {_VERSION_COLUMNS}",
    lambda t: star.dim_supplier(t, _day(t)),
    "SELECT * FROM dim_supplier",
)

SHARED["dim_customer"] = f"SELECT {_key('customer_id')} AS customer_key, *, {_VERSION} FROM customers"
query(
    "dim_customer",
    "customer_key:i customer_id:i customer_code:s customer_name:s customer_type:s city:s state:s country:s "
    f"credit_limit:m is_active:b {_VERSION_COLUMNS}",
    lambda t: star.dim_customer(t, _day(t)),
    "SELECT * FROM dim_customer",
)

_REGION = "CASE state " + " ".join(f"WHEN '{s}' THEN '{r}'" for s, r in REGIONS.items()) + " END"
SHARED["dim_warehouse"] = f"SELECT warehouse_id AS warehouse_key, *, {_REGION} AS region FROM warehouses"
query(
    "dim_warehouse",
    "warehouse_key:i warehouse_id:i warehouse_code:s warehouse_name:s city:s state:s region:s latitude:f longitude:f "
    "capacity_units:i operating_cost_per_unit:m is_active:b",
    lambda t: star.dim_warehouse(t, REGIONS),
    "SELECT * FROM dim_warehouse",
)


def _observed_lead_times(t: Tables) -> DataFrame:
    """A snapshot of changed rows: each delivered product's lead time as observed."""
    delivered = t("purchase_orders", "po_id", "order_date", "actual_delivery_date").filter(
        F.col("actual_delivery_date").isNotNull()
    )
    lead = F.avg(days_between("actual_delivery_date", "order_date"))
    return (
        t("purchase_order_items", "po_id", "product_id")
        .join(delivered, "po_id")
        .groupBy("product_id")
        .agg(round_int(lead).alias("lead_time_days"))
    )


def _scd2(t: Tables) -> DataFrame:
    first = F.date_sub(_day(t), 365)
    rows = t("products", "product_id", "sku", "lead_time_days")
    return versions.scd2_merge(
        versions.first_versions(rows, "product_id", first), _observed_lead_times(t), "product_id", ["lead_time_days"], _day(t)
    )


query(
    "scd2_merge",
    "product_key:i product_id:i sku:s lead_time_days:i effective_date:d expiration_date:d is_current:b",
    _scd2,
    f"""
    WITH u AS (
      SELECT product_id, CAST({rounded("AVG(actual_delivery_date - order_date)", 0)} AS BIGINT) AS observed
      FROM purchase_order_items JOIN purchase_orders USING (po_id)
      WHERE actual_delivery_date IS NOT NULL GROUP BY product_id),
    j AS (SELECT p.product_id, p.sku, p.lead_time_days, u.observed,
                 u.observed IS NOT NULL AND u.observed <> p.lead_time_days AS changed, (SELECT d FROM anchor) AS today
          FROM products p LEFT JOIN u ON u.product_id = p.product_id)
    SELECT product_id * 100000 + (today - 365 - DATE '1970-01-01') AS product_key, product_id, sku, lead_time_days,
           today - 365 AS effective_date, CASE WHEN changed THEN today END AS expiration_date,
           NOT changed AS is_current
    FROM j
    UNION ALL
    SELECT product_id * 100000 + (today - DATE '1970-01-01'), product_id, sku, observed, today, NULL, TRUE
    FROM j WHERE changed""",
)

# ---- facts ----------------------------------------------------------------------------

SHARED["fact_sales"] = f"""
    SELECT {_date_key("so.order_date")} AS date_key, {_key("l.product_id")} AS product_key,
           {_key("so.customer_id")} AS customer_key, so.warehouse_id AS warehouse_key,
           so.so_number AS sales_order_number, l.so_item_id AS sales_fact_key, l.quantity_ordered,
           ROW_NUMBER() OVER (PARTITION BY l.so_id ORDER BY l.line_number, l.so_item_id) AS line_item_number,
           l.quantity_shipped, l.unit_price, l.discount_percent,
           CAST(ROUND(l.gross_amount, 2) AS DECIMAL(12,2)) AS gross_amount,
           CAST(ROUND(l.discount_amount, 2) AS DECIMAL(12,2)) AS discount_amount,
           CAST(ROUND(l.net_amount, 2) AS DECIMAL(12,2)) AS net_amount,
           CAST(ROUND(l.cost_amount, 2) AS DECIMAL(12,2)) AS cost_amount,
           CAST(ROUND(l.profit_amount, 2) AS DECIMAL(12,2)) AS profit_amount,
           so.actual_ship_date - so.order_date AS days_to_ship,
           so.actual_ship_date <= so.requested_delivery_date AS is_on_time
    FROM line_amounts l JOIN sales_orders so ON so.so_id = l.so_id"""
query(
    "fact_sales",
    "sales_fact_key:s date_key:i product_key:i customer_key:i warehouse_key:i sales_order_number:s line_item_number:i "
    "quantity_ordered:i quantity_shipped:i unit_price:m discount_percent:m gross_amount:m discount_amount:m "
    "net_amount:m cost_amount:m profit_amount:m days_to_ship:i is_on_time:b",
    _fact_sales,
    "SELECT * FROM fact_sales",
)

SHARED["fact_inventory_daily"] = f"""
    SELECT {_date_key("(SELECT d FROM anchor)")} AS date_key, {_key("product_id")} AS product_key,
           warehouse_id AS warehouse_key, *,
           concat_ws('-', {_date_key("(SELECT d FROM anchor)")}, warehouse_id, product_id) AS inventory_fact_key
    FROM stock_measures"""
query(
    "fact_inventory_daily",
    "inventory_fact_key:s date_key:i product_key:i warehouse_key:i quantity_on_hand:i quantity_reserved:i quantity_available:i "
    "reorder_point:i inventory_value:m days_of_supply:f is_below_reorder:b is_stockout:b is_overstock:b",
    _fact_inventory,
    "SELECT * FROM fact_inventory_daily",
)

SHARED["fact_purchases"] = f"""
    SELECT {_date_key("po.order_date")} AS order_date_key, {_date_key("po.actual_delivery_date")} AS delivery_date_key,
           {_key("i.product_id")} AS product_key, {_key("po.supplier_id")} AS supplier_key,
           po.warehouse_id AS warehouse_key, po.po_number AS purchase_order_number, i.po_item_id AS purchase_fact_key,
           ROW_NUMBER() OVER (PARTITION BY i.po_id ORDER BY i.line_number, i.po_item_id) AS line_item_number,
           i.quantity_ordered, i.quantity_received, i.unit_cost, i.line_total AS total_cost,
           po.expected_delivery_date - po.order_date AS expected_lead_days,
           po.actual_delivery_date - po.order_date AS actual_lead_days,
           po.actual_delivery_date - po.expected_delivery_date AS lead_time_variance,
           po.actual_delivery_date <= po.expected_delivery_date AS is_on_time,
           i.quantity_received >= i.quantity_ordered AS is_complete, po.order_date, po.supplier_id
    FROM purchase_order_items i JOIN purchase_orders po ON po.po_id = i.po_id"""
query(
    "fact_purchases",
    "purchase_fact_key:s order_date_key:i delivery_date_key:i product_key:i supplier_key:i warehouse_key:i purchase_order_number:s "
    "line_item_number:i quantity_ordered:i quantity_received:i unit_cost:m total_cost:m expected_lead_days:i "
    "actual_lead_days:i lead_time_variance:i is_on_time:b is_complete:b",
    lambda t: _fact_purchases(t, _folder(t)),
    "SELECT * FROM fact_purchases",
)

query(
    "fact_stockouts",
    "stockout_fact_key:i start_date_key:i end_date_key:i product_key:i warehouse_key:i duration_days:i "
    "estimated_lost_units:i estimated_lost_revenue:m root_cause:s",
    lambda t: star.fact_stockouts(t, _products(t), star.dim_warehouse(t, REGIONS)),
    f"""
    SELECT stockout_id AS stockout_fact_key, {_date_key("stockout_start_date")} AS start_date_key,
           {_date_key("stockout_end_date")} AS end_date_key, {_key("product_id")} AS product_key,
           warehouse_id AS warehouse_key,
           CAST(floor((epoch_us(stockout_end_date) - epoch_us(stockout_start_date)) / CAST(86400000000 AS DOUBLE))
                AS BIGINT) AS duration_days,
           demand_during_stockout AS estimated_lost_units, lost_sales_amount AS estimated_lost_revenue, root_cause
    FROM stockout_events JOIN products USING (product_id) JOIN warehouses USING (warehouse_id)""",
)



def _two_versions(t: Tables) -> DataFrame:
    """Products with a second version where the observed lead time differs, 400 days back."""
    opened = F.date_sub(_day(t), 400)
    rows = t("products", "product_id", "sku", "lead_time_days")
    first = versions.first_versions(rows, "product_id", F.date_sub(_day(t), 2000))
    return versions.scd2_merge(first, _observed_lead_times(t), "product_id", ["lead_time_days"], opened)


def _sales_by_version(t: Tables) -> DataFrame:
    fact = star.fact_sales(t, _two_versions(t), star.customer_versions(t, _day(t)), star.dim_warehouse(t, REGIONS))
    return fact.groupBy("product_key").agg(
        F.count("*").alias("lines"), F.min("date_key").alias("first_day"), F.max("date_key").alias("last_day")
    )


# Each line counts for the version valid on its date; days before the first belong to the first.
query(
    "sales_by_version",
    "product_key:i lines:i first_day:i last_day:i",
    _sales_by_version,
    f"""
    WITH seen AS (
      SELECT product_id, CAST({rounded("AVG(wait)", 0)} AS BIGINT) AS observed FROM bought
      WHERE wait IS NOT NULL GROUP BY product_id),
    sold AS (
      SELECT product_id, order_date, d AS today,
             COALESCE(observed <> lead_time_days AND order_date >= d - 400, FALSE) AS later
      FROM sales_order_items JOIN sales_orders USING (so_id) JOIN products USING (product_id)
      LEFT JOIN seen USING (product_id), anchor)
    SELECT product_id * 100000 + (today - IF(later, 400, 2000) - DATE '1970-01-01') AS product_key,
           COUNT(*) AS lines, {_date_key("min(order_date)")} AS first_day, {_date_key("max(order_date)")} AS last_day
    FROM sold GROUP BY ALL""",
)

# ---- aggregates -----------------------------------------------------------------------

query(
    "agg_sales_monthly",
    "year:i month:i product_key:i warehouse_key:i total_orders:i total_quantity:i gross_revenue:m net_revenue:m "
    "total_cost:m total_profit:m avg_order_value:r2",
    lambda t: star.agg_sales_monthly(_fact_sales(t)),
    """
    SELECT date_key // 10000 AS year, date_key // 100 % 100 AS month, product_key, warehouse_key,
           COUNT(DISTINCT sales_order_number) AS total_orders, SUM(quantity_ordered) AS total_quantity,
           SUM(gross_amount) AS gross_revenue, SUM(net_amount) AS net_revenue, SUM(cost_amount) AS total_cost,
           SUM(profit_amount) AS total_profit,
           CAST(SUM(net_amount) AS DOUBLE) / NULLIF(COUNT(DISTINCT sales_order_number), 0) AS avg_order_value
    FROM fact_sales GROUP BY 1, 2, 3, 4""",
)

SHARED["agg_supplier_performance"] = f"""
    SELECT year, quarter, supplier_key, COUNT(*) AS total_orders, SUM(o) AS total_units_ordered,
           SUM(r) AS total_units_received, SUM(s) AS total_spend, COUNT(*) FILTER (WHERE ot) AS on_time_deliveries,
           COUNT(*) FILTER (WHERE NOT ot) AS late_deliveries,
           {rounded("CAST(COUNT(*) FILTER (WHERE ot) AS DOUBLE) / NULLIF(COUNT(ot), 0) * 100", 2)} AS on_time_rate,
           {rounded("CAST(SUM(r) AS DOUBLE) / NULLIF(SUM(o), 0) * 100", 2)} AS fill_rate,
           {rounded("AVG(lead)", 2)} AS avg_lead_time, {rounded("STDDEV_SAMP(lead)", 2)} AS lead_time_std_dev
    FROM (SELECT year(order_date) AS year, quarter(order_date) AS quarter, supplier_key, purchase_order_number,
                 SUM(quantity_ordered) AS o, SUM(quantity_received) AS r, SUM(total_cost) AS s,
                 bool_and(is_on_time) AS ot, max(actual_lead_days) AS lead
          FROM fact_purchases GROUP BY ALL)
    GROUP BY year, quarter, supplier_key"""
query(
    "agg_supplier_performance",
    "year:i quarter:i supplier_key:i total_orders:i total_units_ordered:i total_units_received:i total_spend:m "
    "on_time_deliveries:i late_deliveries:i on_time_rate:f fill_rate:f avg_lead_time:f lead_time_std_dev:f",
    lambda t: star.agg_supplier_performance(_fact_purchases(t)),
    "SELECT * FROM agg_supplier_performance",
)

query(
    "refresh_abc",
    "analysis_date:d product_key:i total_revenue:m revenue_rank:i cumulative_revenue:m cumulative_pct:r2 abc_class:s",
    lambda t: star.refresh_abc(_fact_sales(t), _day(t)),
    f"""
    WITH year AS (
      SELECT product_key, SUM(net_amount) AS total_revenue FROM fact_sales
      WHERE date_key >= (SELECT {_date_key("d - INTERVAL 12 MONTH")} FROM anchor) GROUP BY product_key),
    reach AS (
      SELECT mine.*, SUM(theirs.total_revenue) AS cumulative_revenue,
             COUNT(*) FILTER (theirs.total_revenue > mine.total_revenue OR theirs.product_key <= mine.product_key)
               AS revenue_rank
      FROM year mine JOIN year theirs ON theirs.total_revenue >= mine.total_revenue GROUP BY ALL),
    shares AS (
      SELECT *, CAST(cumulative_revenue AS DOUBLE) / (SELECT CAST(SUM(total_revenue) AS DOUBLE) FROM year) AS part
      FROM reach)
    SELECT shares.*, d AS analysis_date, part * 100 AS cumulative_pct,
           {band("part", [(0.80, "A"), (0.95, "B")], "C")} AS abc_class
    FROM shares, anchor""",
)

# ---- views and comparison queries -----------------------------------------------------

query(
    "vw_sales_dashboard",
    "full_date:d year:i quarter:i month_name:s week_of_year:i day_name:s is_weekend:b sku:s product_name:s "
    "category_name:s abc_class:s customer_name:s customer_type:s customer_state:s warehouse_name:s region:s "
    "quantity_ordered:i quantity_shipped:i net_amount:m profit_amount:m is_on_time:b",
    lambda t: star.vw_sales_dashboard(
        _fact_sales(t),
        star.order_calendar(t),
        star.dim_product(t, _day(t)),
        star.dim_customer(t, _day(t)),
        star.dim_warehouse(t, REGIONS),
    ),
    """
    WITH sold AS (
      SELECT product_key, customer_key, warehouse_key, quantity_ordered, quantity_shipped, net_amount, profit_amount,
             is_on_time, strptime(CAST(date_key AS VARCHAR), '%Y%m%d') AS day
      FROM fact_sales)
    SELECT sold.*, CAST(day AS DATE) AS full_date, year(day) AS year, quarter(day) AS quarter,
           strftime(day, '%b') AS month_name, weekofyear(day) AS week_of_year, strftime(day, '%a') AS day_name,
           isodow(day) > 5 AS is_weekend, sku, product_name, category_name, abc_class, customer_name, customer_type,
           k.state AS customer_state, warehouse_name, region
    FROM sold NATURAL JOIN (SELECT product_key, sku, product_name, category_name, abc_class FROM dim_product)
    JOIN dim_customer k USING (customer_key)
    NATURAL JOIN (SELECT warehouse_key, warehouse_name, region FROM dim_warehouse)""",
)

query(
    "vw_inventory_health",
    "full_date:d year:i month_name:s sku:s product_name:s category_name:s abc_class:s warehouse_name:s region:s "
    "quantity_on_hand:i quantity_available:i reorder_point:i inventory_value:m days_of_supply:f is_below_reorder:b "
    "is_stockout:b inventory_status:s",
    lambda t: star.vw_inventory_health(
        _fact_inventory(t), star.order_calendar(t), star.dim_product(t, _day(t)), star.dim_warehouse(t, REGIONS)
    ),
    """
    SELECT s.*, strftime(day, '%b') AS month_name, year(day) AS year, day AS full_date, sku, product_name,
           category_name, abc_class, warehouse_name, region,
           CASE WHEN is_stockout THEN 'Out of Stock' WHEN is_below_reorder THEN 'Below Reorder Point'
                WHEN is_overstock THEN 'Overstock' ELSE 'Healthy' END AS inventory_status
    FROM (SELECT *, CAST(strptime(CAST(date_key AS VARCHAR), '%Y%m%d') AS DATE) AS day FROM fact_inventory_daily) s
    NATURAL JOIN (SELECT product_key, sku, product_name, category_name, abc_class FROM dim_product)
    NATURAL JOIN (SELECT warehouse_key, warehouse_name, region FROM dim_warehouse)""",
)



def _supplier_scorecard(t: Tables) -> DataFrame:
    figures = kept(star.agg_supplier_performance(_fact_purchases(t)), f"{_folder(t)}/agg_supplier_performance")
    return star.vw_supplier_scorecard(figures, star.dim_supplier(t, _day(t)))


query(
    "vw_supplier_scorecard",
    "supplier_name:s reliability_tier:s quality_rating:m is_preferred:b year:i quarter:i total_orders:i total_spend:m "
    "on_time_rate:f fill_rate:f avg_lead_time:f performance_rating:s",
    _supplier_scorecard,
    f"""
    SELECT *, {rated("on_time_rate", "fill_rate", ["Excellent", "Good", "Fair", "Needs Improvement"])}
             AS performance_rating
    FROM agg_supplier_performance
    NATURAL JOIN (SELECT supplier_key, supplier_name, reliability_tier, quality_rating, is_preferred
                  FROM dim_supplier)""",
)

query(
    "monthly_revenue_by_abc",
    "year:i month_name:s abc_class:s total_revenue:m order_count:i",
    lambda t: star.monthly_revenue_by_abc(_fact_sales(t), star.order_calendar(t), star.dim_product(t, _day(t))),
    """
    WITH per_order AS (
      SELECT date_key // 100 AS month, abc_class, sales_order_number, SUM(net_amount) AS net
      FROM fact_sales NATURAL JOIN (SELECT product_key, abc_class FROM dim_product) GROUP BY ALL)
    SELECT month // 100 AS year, strftime(make_date(2000, month % 100, 1), '%b') AS month_name, abc_class,
           SUM(net) AS total_revenue, COUNT(*) AS order_count
    FROM per_order GROUP BY ALL""",
)

query(
    "supplier_comparison",
    "supplier_name:s reliability_tier:s total_orders:i avg_lead_time:r1 on_time_pct:r1 fill_rate_pct:r1",
    lambda t: star.supplier_comparison(_fact_purchases(t), star.dim_supplier(t, _day(t))),
    """
    WITH named AS (
      SELECT supplier_name, reliability_tier, p.* FROM fact_purchases p
      JOIN (SELECT supplier_key, supplier_name, reliability_tier FROM dim_supplier) USING (supplier_key))
    SELECT supplier_name, reliability_tier, COUNT(*) AS total_orders, AVG(actual_lead_days) AS avg_lead_time,
           CAST(COUNT(*) FILTER (is_on_time) AS DOUBLE) / COUNT(*) * 100 AS on_time_pct,
           CAST(SUM(quantity_received) AS DOUBLE) / SUM(quantity_ordered) * 100 AS fill_rate_pct
    FROM named GROUP BY ALL""",
)
