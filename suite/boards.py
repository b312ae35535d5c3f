"""Dashboard table queries."""

from __future__ import annotations

from stocklens.plans import boards
from suite.core import query
from suite.orders import STOCKOUT_COLUMNS

query(
    "kpi_summary",
    "total_inventory_value:m stockout_losses:m fill_rate_pct:f active_suppliers:i products_at_risk:i",
    boards.kpi_summary,
    """
    SELECT (SELECT SUM(CAST(quantity_on_hand AS DECIMAL(10,0)) * unit_cost)
            FROM inventory JOIN products USING (product_id)) AS total_inventory_value,
           (SELECT SUM(lost_sales_amount) FROM stockout_events) AS stockout_losses,
           (SELECT CAST(SUM(quantity_received) AS DOUBLE) / SUM(quantity_ordered) * 100
            FROM purchase_order_items) AS fill_rate_pct,
           (SELECT COUNT(*) FROM suppliers WHERE is_active) AS active_suppliers,
           (SELECT COUNT(*) FROM inventory JOIN products USING (product_id)
            WHERE quantity_on_hand - quantity_reserved < reorder_point) AS products_at_risk""",
)
query(
    "monthly_sales",
    "month:s total_amount:m",
    boards.monthly_sales,
    "SELECT strftime(order_date, '%Y-%m') AS month, SUM(total_amount) AS total_amount FROM sales_orders GROUP BY 1",
)
query(
    "inventory_value_by_warehouse",
    "warehouse_id:i warehouse_code:s value:m",
    boards.inventory_value_by_warehouse,
    """
    SELECT warehouse_id, warehouse_code, SUM(CAST(quantity_on_hand AS DECIMAL(10,0)) * unit_cost) AS value
    FROM inventory JOIN products USING (product_id) JOIN warehouses USING (warehouse_id) GROUP BY ALL""",
)
query(
    "abc_class_share",
    "abc_class:s products:i revenue:f2 revenue_pct:f products_pct:f",
    boards.abc_class_share,
    """
    SELECT abc_class, COUNT(*) AS products, SUM(total_revenue) AS revenue,
           SUM(total_revenue) / SUM(SUM(total_revenue)) OVER () * 100 AS revenue_pct,
           CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER () * 100 AS products_pct
    FROM abc_mean GROUP BY abc_class""",
)
query(
    "top_a_products",
    "sku:s product_name:s quantity_ordered:i total_revenue:f",
    boards.top_a_products,
    "SELECT * FROM abc_mean WHERE abc_class = 'A' ORDER BY total_revenue DESC, product_id LIMIT 10",
)
query(
    "turnover_category_counts",
    "turnover_category:s product_count:i",
    boards.turnover_category_counts,
    "SELECT turnover_category, COUNT(*) AS product_count FROM turnover_rows GROUP BY 1",
)
query(
    "turnover_metrics",
    "avg_turnover_ratio:f avg_days_of_supply:f dead_stock_items:i dead_stock_value:m",
    boards.turnover_metrics,
    """
    SELECT AVG(turnover_ratio) AS avg_turnover_ratio,
           AVG(days_of_supply) FILTER (WHERE days_of_supply < CAST('inf' AS DOUBLE)) AS avg_days_of_supply,
           COUNT(*) FILTER (WHERE turnover_category = 'Dead Stock') AS dead_stock_items,
           COALESCE(SUM(inventory_value) FILTER (WHERE turnover_category = 'Dead Stock'), 0) AS dead_stock_value
    FROM turnover_rows""",
)
query(
    "dead_stock_top",
    "warehouse_code:s sku:s product_name:s quantity_on_hand:i inventory_value:m days_of_supply:f",
    boards.dead_stock_top,
    """
    SELECT * FROM turnover_rows WHERE turnover_category = 'Dead Stock'
    ORDER BY inventory_value DESC NULLS LAST, warehouse_code, sku LIMIT 20""",
)
query(
    "supplier_tier_counts",
    "tier_order:i tier:s supplier_count:i",
    boards.supplier_tier_counts,
    """
    SELECT tier_order, o.tier, COUNT(s.supplier_id) AS supplier_count
    FROM (VALUES (0, 'Platinum'), (1, 'Gold'), (2, 'Silver'), (3, 'Bronze')) o(tier_order, tier)
    LEFT JOIN supplier_score_rows s ON s.tier = o.tier GROUP BY ALL""",
)
_SUPPLIERS = "supplier_name:s on_time_rate:f fill_rate:f reliability_score:f tier:s"
query(
    "supplier_top5",
    _SUPPLIERS,
    boards.supplier_top,
    "SELECT * FROM supplier_score_rows ORDER BY reliability_score DESC, supplier_code LIMIT 5",
)
query(
    "supplier_bottom5",
    _SUPPLIERS,
    boards.supplier_bottom,
    "SELECT * FROM supplier_score_rows ORDER BY reliability_score, supplier_code LIMIT 5",
)
query(
    "lead_time_cv_ranking",
    "supplier_name:s cv_pct:r2 reliability_category:s",
    boards.lead_time_cv_ranking,
    "SELECT *, cv AS cv_pct FROM lead_time_rows",
)
query(
    "root_cause_by_lost_revenue",
    "root_cause:s total_lost_revenue:m",
    boards.root_cause_by_lost_revenue,
    "SELECT * FROM root_cause_rows",
)
query(
    "stockout_kpis",
    "total_events:i total_lost_revenue:m avg_duration_days:f products_affected:i",
    boards.stockout_kpis,
    """
    SELECT COUNT(*) AS total_events, SUM(lost_sales_amount) AS total_lost_revenue,
           AVG(floor((epoch_us(stockout_end_date) - epoch_us(stockout_start_date)) / CAST(86400000000 AS DOUBLE)))
             AS avg_duration_days,
           COUNT(DISTINCT product_id) AS products_affected
    FROM stockout_events""",
)
query(
    "most_impacted",
    STOCKOUT_COLUMNS,
    boards.most_impacted,
    "SELECT * FROM stockout_rows ORDER BY severity_score DESC NULLS LAST, warehouse_code, sku LIMIT 10",
)
query(
    "rop_recommendation_counts",
    "recommendation:s product_count:i",
    boards.rop_recommendation_counts,
    "SELECT recommendation, COUNT(*) AS product_count FROM rop_rows GROUP BY 1",
)
query(
    "rop_needs_increase",
    "warehouse_code:s sku:s product_name:s quantity_on_hand:i avg_daily_demand:f safety_stock:ri current_rop:i "
    "calculated_rop:i",
    boards.rop_needs_increase,
    """
    SELECT * FROM rop_rows WHERE recommendation = 'Increase ROP'
    ORDER BY calculated_rop - current_rop DESC, warehouse_code, sku LIMIT 10""",
)


def _histogram_sql(column: str, bins: int) -> str:
    return f"""
    WITH e AS (SELECT MIN(CAST({column} AS DOUBLE)) AS low, MAX(CAST({column} AS DOUBLE)) AS high FROM eoq_rows),
    b AS (SELECT CASE WHEN high = low THEN 1
                      ELSE least(CAST(floor((CAST({column} AS DOUBLE) - low) / ((high - low) / {bins})) AS INT) + 1,
                                 {bins}) END AS bin, low, (high - low) / {bins} AS width
          FROM eoq_rows CROSS JOIN e WHERE {column} IS NOT NULL)
    SELECT bin, low + width * (bin - 1) AS bin_start, low + width * bin AS bin_end, COUNT(*) AS product_count
    FROM b GROUP BY bin, low, width"""


_BINS = "bin:i bin_start:f bin_end:f product_count:i"
query("eoq_histogram", _BINS, boards.eoq_histogram, _histogram_sql("eoq", 50))
query("orders_per_year_histogram", _BINS, boards.orders_per_year_histogram, _histogram_sql("orders_per_year", 30))
query(
    "eoq_summary",
    "total_annual_cost:f2 avg_orders_per_year:f avg_order_cycle_days:f",
    boards.eoq_summary,
    """
    SELECT SUM(annual_inventory_cost) AS total_annual_cost, AVG(orders_per_year) AS avg_orders_per_year,
           AVG(days_between_orders) AS avg_order_cycle_days FROM eoq_rows""",
)
query(
    "eoq_top",
    "sku:s product_name:s unit_cost:m annual_demand:i eoq:i orders_per_year:f days_between_orders:f "
    "annual_inventory_cost:f",
    boards.eoq_top,
    "SELECT * FROM eoq_rows ORDER BY eoq DESC NULLS LAST, sku LIMIT 10",
)
query(
    "carrying_by_warehouse",
    "warehouse_code:s warehouse_name:s product_count:i total_units:i inventory_value:m total_carrying_cost:m",
    boards.carrying_by_warehouse,
    """
    SELECT warehouse_code, warehouse_name, SUM(product_count) AS product_count, SUM(total_units) AS total_units,
           SUM(inventory_value) AS inventory_value, SUM(total_carrying_cost) AS total_carrying_cost
    FROM carrying_rows GROUP BY ALL""",
)
query(
    "carrying_components",
    "component:s amount:m",
    boards.carrying_components,
    "\nUNION ALL ".join(
        f"SELECT '{label}' AS component, SUM({c}) AS amount FROM carrying_rows"
        for c, label in boards.COMPONENT_LABELS.items()
    ),
)
query(
    "carrying_totals",
    "total_value:m total_carrying_cost:m monthly_carrying_cost:f2",
    boards.carrying_totals,
    """
    SELECT SUM(inventory_value) AS total_value, SUM(total_carrying_cost) AS total_carrying_cost,
           SUM(monthly_carrying_cost) AS monthly_carrying_cost FROM carrying_rows""",
)
# Random samples: no equal result on another engine.


def _sample_sql(rows: str, n: int) -> str:
    return f"SELECT * FROM {rows} ORDER BY md5('42|' || warehouse_code || '|' || sku) LIMIT {n}"


query(
    "turnover_scatter_sample",
    "sku:s product_name:s turnover_ratio:f inventory_value:m turnover_category:s",
    boards.turnover_scatter_sample,
    _sample_sql("turnover_rows", 200),
)
query(
    "reorder_scatter_sample",
    "sku:s product_name:s current_rop:i calculated_rop:i recommendation:s",
    boards.reorder_scatter_sample,
    _sample_sql("rop_rows", 100),
)
query(
    "abc_class_totals",
    "abc_class:s product_count:i total_revenue:f2",
    boards.abc_class_totals,
    "SELECT abc_class, COUNT(*) AS product_count, SUM(total_revenue) AS total_revenue FROM abc_mean GROUP BY 1",
)
query(
    "supplier_summary_top10",
    "supplier_name:s reliability_score:f tier:s",
    boards.supplier_summary_top10,
    "SELECT * FROM supplier_score_rows ORDER BY reliability_score DESC, supplier_code LIMIT 10",
)
query(
    "carrying_cost_per_warehouse",
    "warehouse_code:s total_carrying_cost:m",
    boards.carrying_cost_per_warehouse,
    "SELECT warehouse_code, SUM(total_carrying_cost) AS total_carrying_cost FROM carrying_rows GROUP BY 1",
)
