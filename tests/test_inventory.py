from __future__ import annotations

import math
from decimal import Decimal as D

import pytest
from shop import PRODUCTS, SALES, TODAY, by, day, line, product, sale, shop
from pyspark.sql import functions as F

from stocklens.functions.expr import normal_quantile
from stocklens.operators import abc, inventory, sales


@pytest.fixture(scope="module")
def t(spark):
    return shop(spark)


def test_abc_shares_a_tied_total(t):
    rows = by(abc.abc_detail(t), "product_id")
    # Net of discount, one year, not cancelled: 0: 200 + 40 + 40, 1 and 2: 40, 3: 0.
    assert {k: r["total_revenue"] for k, r in rows.items()} == {0: D(280), 1: D(40), 2: D(40), 3: D(0)}
    assert rows[1]["cumulative_pct"] == rows[2]["cumulative_pct"] == 100.0
    assert [rows[k]["abc_class"] for k in (0, 1, 2, 3)] == ["A", "C", "C", "C"]
    assert {k: r["revenue_rank"] for k, r in rows.items()} == {0: 1, 1: 2, 2: 3, 3: 4}
    assert rows[3]["category_name"] is None


def test_abc_row_frame_splits_the_tie(t):
    rows = by(abc.abc_extract(t), "product_id")
    assert rows[1]["cumulative_pct"] < rows[2]["cumulative_pct"]
    assert rows[4]["total_revenue"] == D(36)  # cancelled orders count here
    assert rows[3]["abc_class"] == "C"


def test_abc_without_any_revenue_has_no_class(spark):
    t = shop(spark, sales_order_items=[line(1, 1, 0, 1, 1, "2.00", "100")])
    assert by(abc.abc_extract(t), "product_id")[0]["abc_class"] is None


def test_abc_lone_product_is_c(spark):
    t = shop(spark, sales_order_items=[line(1, 1, 0, 1, 1, "2.00")])
    assert [(r.abc_class, r.pct_of_products) for r in abc.abc_summary(t).collect()] == [("C", 100.0)]


def test_abc_mean_price_ignores_discount(t):
    rows = by(abc.abc_mean_price(t), "product_id")
    assert rows[0]["total_revenue"] == 16 * 20.0
    assert 4 not in rows


def test_abc_summary_shares_add_up(t):
    rows = abc.abc_summary(t).collect()
    assert sum(r.product_count for r in rows) == 4
    assert sum(r.pct_of_revenue for r in rows) == pytest.approx(100, abs=0.02)


def test_turnover_counts_all_demand_on_every_warehouse(t):
    rows = by(inventory.turnover_sql(t), "product_id", "warehouse_code")
    assert rows[0, "W0"]["units_sold_12m"] == 116
    assert rows[4, "W1"]["units_sold_12m"] == 9  # cancelled
    assert (0, "W1") not in rows  # nothing on hand
    assert rows[0, "W0"]["inventory_turnover_ratio"] == 1.16


def test_turnover_windowed_is_live_and_local(t):
    rows = by(inventory.turnover_windowed(t), "product_id", "warehouse_code")
    assert rows[0, "W0"]["units_sold_12m"] == 16
    assert rows[4, "W1"]["units_sold_12m"] == 0
    assert rows[4, "W1"]["days_inventory_on_hand"] is None
    assert rows[4, "W1"]["turnover_category"] == "Dead Stock"


def test_turnover_of_unsold_stock_has_no_value(t):
    rows = by(inventory.turnover(t), "sku", "warehouse_code")
    unsold = rows["SKU-4", "W1"]
    assert unsold["inventory_value"] is None and unsold["turnover_ratio"] == 0.0
    assert math.isinf(unsold["days_of_supply"]) and unsold["turnover_category"] == "Dead Stock"


def test_warehouse_zero_is_a_filter(t):
    assert {r.warehouse_code for r in inventory.turnover(t, warehouse_id=0).collect()} == {"W0"}


def test_reorder_points(t):
    row = by(inventory.reorder_points(t), "sku", "warehouse_code")["SKU-0", "W0"]
    daily = [10, 4, 2]
    avg = sum(daily) / 3
    sd = math.sqrt(sum((x - avg) ** 2 for x in daily) / 2)
    safety = normal_quantile(0.95) * math.sqrt(4 * sd**2 + avg**2 * 0.8**2)
    assert row["safety_stock"] == round(safety)
    assert row["calculated_rop"] == round(avg * 4 + safety)
    assert row["recommendation"] == "Increase ROP"


def test_single_day_of_demand_falls_back_to_thirty_percent(t):
    row = by(inventory.reorder_points(t), "sku", "warehouse_code")["SKU-1", "W0"]
    safety = normal_quantile(0.95) * math.sqrt(4 * 1.2**2 + 4**2 * 0.8**2)
    assert row["safety_stock"] == round(safety)


def test_reorder_points_sql_without_deliveries_is_optimal(t):
    rows = by(inventory.reorder_points_sql(t, as_of=TODAY), "sku", "warehouse_code")
    none = rows["SKU-3", "W1"]
    assert (none["safety_stock"], none["calculated_reorder_point"], none["recommendation"]) == (None, None, "Optimal")
    assert rows["SKU-0", "W0"]["lead_time_days"] == 10.0


def test_eoq_rounds_in_a_chain(t):
    row = by(inventory.eoq(t), "sku")["SKU-0"]
    assert row["annual_demand"] == 116
    eoq = round(math.sqrt(2 * 116 * 50 / 2.5))
    assert row["eoq"] == eoq
    assert row["orders_per_year"] == round(116 / eoq, 1)
    assert row["days_between_orders"] == round(365 / round(116 / eoq, 1))


def test_eoq_of_a_free_product_is_null(spark):
    t = shop(spark, sales_order_items=[line(1, 1, 5, 3, 3, "1.00")])
    row = inventory.eoq(t).collect()[0]
    assert (row.eoq, row.orders_per_year, row.days_between_orders) == (None, None, None)
    assert inventory.eoq_sql(t).collect()[0].economic_order_quantity is None


def test_carrying_costs_and_the_missing_category(t):
    with_null = by(inventory.carrying_costs_sql(t), "warehouse_code", "category_name")
    assert with_null["W1", None]["total_units"] == 7
    without = by(inventory.carrying_costs(t), "warehouse_code", "category_name")
    assert ("W1", None) not in without
    assert without["W1", "Tools"]["product_count"] == 2  # the empty row counts
    assert with_null["W1", "Tools"]["product_count"] == 1
    row = without["W0", "Tools"]
    parts = [row[c] for c in inventory.CARRYING_COMPONENTS]
    assert sum(parts) == row["total_carrying_cost"]


def test_inventory_status(t):
    rows = by(inventory.inventory_status(t), "inventory_id")
    assert [rows[i]["stock_status"] for i in range(1, 7)] == [
        "In Stock", "Out of Stock", "Reorder", "Low Stock", "In Stock", "Out of Stock",
    ]


def test_daily_sales(t):
    rows = by(sales.daily_sales(t), "order_date", "sku")
    assert rows[day(3), "SKU-0"]["gross_profit"] == D("0.00")  # half price
    assert (day(20), "SKU-4") not in rows


def test_null_status_is_not_live(spark):
    t = shop(spark, sales_orders=[{**SALES[0], "status": None}, sale(2, 3)])
    assert {r.order_date for r in sales.daily_sales(t).collect()} == {day(3)}


def test_hot_product_matches_small_ones(spark):
    """A third of all lines on one product: same totals as by hand."""
    products = PRODUCTS + [product(i, "1.00") for i in range(10, 40)]
    lines = [line(i, 1, 0 if i % 3 == 0 else 10 + i % 30, 1, 1, "1.00") for i in range(900)]
    t = shop(spark, products=products, sales_order_items=lines)
    rows = by(abc.abc_line_gross(t), "product_id")
    assert rows[0]["total_revenue"] == 300 and rows[0]["cumulative_revenue"] == 300
    assert max(r["cumulative_revenue"] for r in rows.values()) == 900


def test_line_total_is_rounded_half_up(spark):
    t = shop(spark, sales_order_items=[line(1, 1, 0, 1, 1, "0.05", "10"), line(2, 1, 0, 3, 3, "1.15", "50")])
    totals = t("sales_order_items", "line_total").orderBy(F.asc("line_total")).collect()
    assert [r[0] for r in totals] == [D("0.05"), D("1.73")]
