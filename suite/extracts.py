"""Denormalised extract queries."""

from __future__ import annotations

from stocklens.plans import extracts
from suite.core import SHARED, query, rounded

SHARED["line_amounts"] = """
    SELECT *, gross_amount * discount_percent * CAST(0.01 AS DECIMAL(2,2)) AS discount_amount,
           gross_amount - gross_amount * discount_percent * CAST(0.01 AS DECIMAL(2,2)) AS net_amount,
           cost_amount AS cost,
           gross_amount - gross_amount * discount_percent * CAST(0.01 AS DECIMAL(2,2)) - cost_amount AS profit_amount
    FROM (SELECT i.*, p.sku, p.product_name, p.category_id, p.unit_cost,
                 CAST(quantity_ordered AS DECIMAL(10,0)) * i.unit_price AS gross_amount,
                 CAST(quantity_ordered AS DECIMAL(10,0)) * p.unit_cost AS cost_amount
          FROM sales_order_items i JOIN products p ON p.product_id = i.product_id)"""

query(
    "sales_extract",
    "so_id:i so_item_id:s order_date:d order_year:i order_month:i order_month_name:s order_quarter:i order_week:i "
    "order_day_of_week:s is_weekend:b sku:s product_name:s category_name:s abc_class:s customer_name:s "
    "customer_type:s customer_city:s customer_state:s warehouse_name:s warehouse_city:s warehouse_state:s "
    "quantity_ordered:i quantity_shipped:i unit_price:m unit_cost:m discount_percent:m gross_amount:m "
    "discount_amount:m net_amount:m cost_amount:m profit_amount:m profit_margin_pct:r2 status:s",
    extracts.sales_extract,
    """
    SELECT l.*, so.order_date, so.status, year(so.order_date) AS order_year, month(so.order_date) AS order_month,
           monthname(so.order_date) AS order_month_name, quarter(so.order_date) AS order_quarter,
           weekofyear(so.order_date) AS order_week, dayname(so.order_date) AS order_day_of_week,
           dayofweek(so.order_date) IN (0, 6) AS is_weekend, pc.category_name, a.abc_class, c.customer_name,
           c.customer_type, c.city AS customer_city, c.state AS customer_state, w.warehouse_name,
           w.city AS warehouse_city, w.state AS warehouse_state,
           CAST(l.profit_amount AS DOUBLE) / NULLIF(CAST(l.net_amount AS DOUBLE), 0) * 100 AS profit_margin_pct
    FROM line_amounts l
    JOIN sales_orders so ON so.so_id = l.so_id
    JOIN product_categories pc ON pc.category_id = l.category_id
    JOIN customers c ON c.customer_id = so.customer_id
    JOIN warehouses w ON w.warehouse_id = so.warehouse_id
    LEFT JOIN abc_all_lines a ON a.product_id = l.product_id""",
)

SHARED["demand_rate"] = """
    SELECT product_id, CAST(SUM(quantity_ordered) AS DOUBLE)
             / (SELECT greatest(max(order_date) - min(order_date), 1)
                FROM sales_order_items JOIN sales_orders USING (so_id)) AS avg_daily_demand
    FROM sales_order_items JOIN sales_orders USING (so_id) GROUP BY product_id"""
SHARED["stock_measures"] = f"""
    SELECT *, CAST(quantity_on_hand AS DECIMAL(10,0)) * unit_cost AS inventory_value,
           quantity_available < reorder_point AS is_below_reorder, quantity_available <= 0 AS is_stockout,
           COALESCE(days_of_supply > 90, FALSE) AS is_overstock
    FROM (SELECT i.*, p.sku, p.product_name, p.category_id, p.unit_cost, d.avg_daily_demand,
                 {rounded('''CAST(quantity_available AS DOUBLE)
                   / CASE WHEN d.avg_daily_demand < 0.01 THEN 0.01 ELSE d.avg_daily_demand END''', 1)} AS days_of_supply
          FROM inventory i JOIN products p ON p.product_id = i.product_id
          LEFT JOIN demand_rate d ON d.product_id = i.product_id)"""

query(
    "inventory_extract",
    "warehouse_name:s city:s state:s sku:s product_name:s category_name:s abc_class:s quantity_on_hand:i "
    "quantity_reserved:i quantity_available:i reorder_point:i reorder_quantity:i unit_cost:m inventory_value:m "
    "annual_carrying_cost:m avg_daily_demand:f days_of_supply:f inventory_status:s movement_class:s "
    "is_below_reorder:b is_stockout:b is_overstock:b total_revenue:m",
    extracts.inventory_extract,
    """
    SELECT m.*, w.warehouse_name, w.city, w.state, pc.category_name, a.abc_class, a.total_revenue,
           inventory_value * 0.20 AS annual_carrying_cost,
           CASE WHEN is_stockout THEN 'Out of Stock' WHEN is_below_reorder THEN 'Below Reorder Point'
                WHEN is_overstock THEN 'Overstock' ELSE 'Healthy' END AS inventory_status,
           CASE WHEN days_of_supply < 30 THEN 'Fast Moving' WHEN days_of_supply < 90 THEN 'Normal'
                WHEN days_of_supply < 180 THEN 'Slow Moving' ELSE 'Dead Stock' END AS movement_class
    FROM stock_measures m
    JOIN product_categories pc ON pc.category_id = m.category_id
    JOIN warehouses w ON w.warehouse_id = m.warehouse_id
    LEFT JOIN abc_all_lines a ON a.product_id = m.product_id""",
)

query(
    "supplier_extract",
    "supplier_id:i supplier_name:s city:s state:s country:s payment_terms_days:i quality_rating:m is_preferred:b "
    "total_orders:i total_spend:m on_time_rate_pct:r1 fill_rate_pct:r1 reliability_score:f avg_lead_time:r1 "
    "lead_time_std:f tier:s performance_rating:s",
    extracts.supplier_extract,
    f"""
    SELECT *, otr * 100 AS on_time_rate_pct, fr * 100 AS fill_rate_pct, alt AS avg_lead_time, lts AS lead_time_std,
           CASE WHEN reliability_score >= 90 THEN 'Excellent' WHEN reliability_score >= 75 THEN 'Good'
                WHEN reliability_score >= 60 THEN 'Fair' ELSE 'Needs Improvement' END AS performance_rating
    FROM (SELECT r.*, s.* EXCLUDE (supplier_id), {rounded("score", 1)} AS reliability_score
          FROM supplier_extract_rows r JOIN suppliers s ON s.supplier_id = r.supplier_id)
    LEFT JOIN (SELECT supplier_id, SUM(line_total) AS total_spend
               FROM purchase_order_items JOIN purchase_orders USING (po_id) GROUP BY supplier_id) USING (supplier_id)""",
)

query(
    "timeseries_extract",
    "date:d warehouse:s category:s order_count:i units_sold:i revenue:m cost:m profit:m year:i month:i month_name:s "
    "quarter:i week:i day_of_week:s is_weekend:b revenue_7d_ma:r2",
    extracts.timeseries_extract,
    """
    SELECT *, year(date) AS year, month(date) AS month, monthname(date) AS month_name, quarter(date) AS quarter,
           weekofyear(date) AS week, dayname(date) AS day_of_week, dayofweek(date) IN (0, 6) AS is_weekend,
           CAST(SUM(revenue) OVER win AS DOUBLE) / COUNT(*) OVER win AS revenue_7d_ma
    FROM (SELECT so.order_date AS date, w.warehouse_name AS warehouse, pc.category_name AS category,
                 COUNT(DISTINCT l.so_id) AS order_count, SUM(l.quantity_ordered) AS units_sold,
                 SUM(l.net_amount) AS revenue, SUM(l.cost_amount) AS cost, SUM(l.profit_amount) AS profit
          FROM line_amounts l JOIN sales_orders so ON so.so_id = l.so_id
          JOIN product_categories pc ON pc.category_id = l.category_id
          JOIN warehouses w ON w.warehouse_id = so.warehouse_id
          GROUP BY ALL)
    WINDOW win AS (PARTITION BY warehouse, category ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
