from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from shop import TODAY, by, shop
from pyspark.sql import functions as F

from stocklens.plans import boards, extracts, star
from stocklens.plans.versions import first_versions, scd2_merge


@pytest.fixture(scope="module")
def t(spark):
    return shop(spark)


def _effective(d=TODAY):
    return F.lit(str(d)).cast("date")


def test_sales_extract(t):
    rows = by(extracts.sales_extract(t), "so_item_id")
    assert 31 not in rows  # product without a category
    half = rows[21]
    assert (half["gross_amount"], half["discount_amount"], half["net_amount"]) == (D(80), D(40), D(40))
    assert half["profit_margin_pct"] == 0.0
    assert list(half) == extracts.SALES_COLUMNS


def test_margin_of_a_free_line_is_null(spark):
    from shop import line

    t = shop(spark, sales_order_items=[line(1, 1, 0, 1, 1, "2.00", "100")])
    assert extracts.sales_extract(t).collect()[0].profit_margin_pct is None


def test_inventory_extract(t):
    rows = by(extracts.inventory_extract(t), "warehouse_name", "sku")
    assert rows["Zero", "SKU-0"]["avg_daily_demand"] == 116 / 400
    assert rows["Zero", "SKU-0"]["inventory_status"] == "Overstock"
    assert rows["Zero", "SKU-1"]["inventory_status"] == "Out of Stock"
    assert rows["Zero", "SKU-2"]["is_below_reorder"] is False  # equal is not below
    assert rows["One", "SKU-4"]["is_below_reorder"] is False  # no reorder point


def test_supplier_extract_rates_the_rounded_score(t):
    rows = by(extracts.supplier_extract(t), "supplier_id")
    assert rows[0]["total_spend"] == D(100)
    assert rows[0]["on_time_rate_pct"] == 75.0
    assert rows[3]["performance_rating"] == "Needs Improvement"


def test_timeseries_average_starts_with_what_there_is(t):
    rows = extracts.timeseries_extract(t).filter("warehouse = 'Zero' and category = 'Tools'").orderBy("date").collect()
    revenue = [float(r.revenue) for r in rows]
    assert [r.revenue_7d_ma for r in rows] == [round(sum(revenue[: i + 1]) / (i + 1), 2) for i in range(len(rows))]


def test_export_all(spark, t, tmp_path):
    paths = extracts.export_all(t, str(tmp_path), "csv")
    assert set(paths) == {"sales", "inventory", "supplier", "timeseries"}
    assert spark.read.option("header", True).csv(paths["supplier"]).columns == extracts.SUPPLIER_COLUMNS


def test_dim_date_is_inclusive(spark):
    rows = by(star.build_dim_date(spark, "2024-12-28", "2025-01-02"), "date_key")
    assert list(rows) == [20241228, 20241229, 20241230, 20241231, 20250101, 20250102]
    assert rows[20241229]["day_of_week"] == 0 and rows[20241229]["is_weekend"]
    assert rows[20241230]["week_of_year"] == 1 and rows[20241230]["day_name"] == "Mon"
    assert rows[20250101]["month_name"] == "Jan"


def _dim(spark, t):
    rows = t("products", "product_id", "sku", "lead_time_days")
    return first_versions(rows, "product_id", _effective(dt.date(2025, 1, 1)))


def _updates(spark, rows):
    return spark.createDataFrame(rows, "product_id int, sku string, lead_time_days int")


def test_scd2_merge(spark, t):
    dim = _dim(spark, t)
    updates = _updates(spark, [(0, "SKU-0", 9), (1, "SKU-1", 4), (77, "NEW", None)])
    merged = scd2_merge(dim, updates, "product_id", ["sku", "lead_time_days"], _effective())
    versions = {}
    for r in merged.collect():
        versions.setdefault(r.product_id, []).append((r.lead_time_days, r.effective_date, r.expiration_date, r.is_current))
    start = dt.date(2025, 1, 1)
    assert sorted(versions[0], key=str) == sorted([(4, start, TODAY, False), (9, TODAY, None, True)], key=str)
    assert versions[1] == [(4, start, None, True)]  # unchanged
    assert versions[2] == [(4, start, None, True)]  # not in the snapshot
    assert versions[77] == [(None, TODAY, None, True)]
    keys = [r.product_key for r in merged.collect()]
    assert len(set(keys)) == len(keys)


def test_scd2_merge_again_changes_nothing(spark, t):
    updates = _updates(spark, [(0, "SKU-0", 9), (77, "NEW", 1)])
    once = scd2_merge(_dim(spark, t), updates, "product_id", ["sku", "lead_time_days"], _effective())
    twice = scd2_merge(once, updates, "product_id", ["sku", "lead_time_days"], _effective())
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    corrected = scd2_merge(
        twice, _updates(spark, [(0, "SKU-0", 8)]), "product_id", ["sku", "lead_time_days"], _effective()
    )
    assert sorted(r.lead_time_days for r in corrected.collect() if r.product_id == 0) == [4, 8]


def _keys(t):
    e = _effective()
    return star.product_versions(t, e), star.customer_versions(t, e), star.supplier_versions(t, e), star.dim_warehouse(t)


def test_fact_sales_numbers_lines_within_the_order(t):
    products, customers, _s, sites = _keys(t)
    rows = star.fact_sales(t, products, customers, sites).collect()
    numbers = sorted((r.sales_order_number, r.line_item_number) for r in rows)
    assert numbers == [("SO-1", 1), ("SO-1", 2), ("SO-2", 1), ("SO-2", 2), ("SO-3", 1), ("SO-4", 1), ("SO-5", 1), ("SO-6", 1)]
    assert len({r.sales_fact_key for r in rows}) == len(rows)
    assert all(r.days_to_ship == 2 and r.is_on_time for r in rows)


def test_fact_purchases_and_quarterly_aggregate(t):
    products, _c, sups, sites = _keys(t)
    fact = star.fact_purchases(t, products, sups, sites)
    open_line = by(fact, "purchase_order_number", "line_item_number")["PO-4", 1]
    assert open_line["delivery_date_key"] is None and open_line["is_on_time"] is None
    agg = star.agg_supplier_performance(fact).collect()
    assert sum(r.total_orders for r in agg) == 8  # two lines of one order are one order


def test_dense_inventory_fills_missing_pairs(t):
    products, _c, _s, sites = _keys(t)
    fact = star.fact_inventory_daily(t, products, sites, as_of=TODAY, dense=True)
    assert fact.count() == 12
    assert star.fact_inventory_daily(t, products, sites, as_of=TODAY).count() == 6
    assert fact.filter("quantity_on_hand = 0").count() == 7


def test_refresh_abc_replaces_its_own_day(spark, t, tmp_path):
    products, customers, _s, sites = _keys(t)
    classes = star.refresh_abc(star.fact_sales(t, products, customers, sites), as_of=TODAY)
    path = str(tmp_path / "abc")
    for _ in range(2):
        star.save_by_partition(classes, path, "analysis_date")
    star.save_by_partition(classes.withColumn("analysis_date", _effective(dt.date(2025, 1, 1))), path, "analysis_date")
    assert spark.read.parquet(path).groupBy("analysis_date").count().orderBy("analysis_date").collect() == [
        (dt.date(2025, 1, 1), 5),
        (TODAY, 5),
    ]


def test_save_fact_keeps_all_rows_and_replaces_its_months(spark, t, tmp_path):
    products, customers, _s, sites = _keys(t)
    fact = star.fact_sales(t, products, customers, sites)
    path = str(tmp_path / "fact")
    for _ in range(2):
        star.save_fact(fact, path, "date_key", "product_key")
    saved = spark.read.parquet(path)
    assert sorted(map(str, saved.select(fact.columns).collect())) == sorted(map(str, fact.collect()))
    assert {r.month_key for r in saved.collect()} == {202405, 202506}


def test_regions_come_from_the_mapping(t):
    assert by(star.dim_warehouse(t, {"S": "South"}), "warehouse_code")["W0"]["region"] == "South"
    assert by(star.dim_warehouse(t, {"S": "South"}), "warehouse_code")["W1"]["region"] is None


def test_histogram_covers_every_product(t):
    rows = boards.eoq_histogram(t, bins=3).collect()
    assert sum(r.product_count for r in rows) == 4
    assert {r.bin for r in rows} <= {1, 2, 3}


def test_samples_have_their_size(t):
    assert boards.turnover_scatter_sample(t, n=3).count() == 3
    assert boards.reorder_scatter_sample(t).count() <= 100


def test_carrying_components_add_up(t):
    total = boards.carrying_totals(t).collect()[0].total_carrying_cost
    assert sum(r.amount for r in boards.carrying_components(t).collect()) == total


def test_kpis(t):
    row = boards.kpi_summary(t).collect()[0]
    assert row.active_suppliers == 3
    assert row.products_at_risk == 2  # equal to the reorder point is not at risk
    assert row.stockout_losses == D(150)


def test_facts_keep_lines_of_unknown_members(spark, t):
    orders = t("sales_orders").withColumn("customer_id", F.lit(None).cast("int"))
    changed = t.replaced(sales_orders=orders)
    products, customers, _s, sites = _keys(t)
    some = products.filter("product_id != 0")
    rows = star.fact_sales(changed, some, customers, sites).collect()
    assert len(rows) == 8
    assert {r.customer_key for r in rows} == {star.UNKNOWN}
    assert any(r.product_key == star.UNKNOWN for r in rows) and all(r.warehouse_key >= 0 for r in rows)


def test_facts_take_the_version_valid_on_their_date(spark, t):
    dates = sorted({r.order_date for r in t("sales_orders").collect()})
    turn = dates[-1]
    rows = t("products", "product_id", "sku", "lead_time_days")
    first = first_versions(rows, "product_id", _effective(turn - dt.timedelta(days=1)))
    updates = rows.withColumn("lead_time_days", F.lit(50))
    both = scd2_merge(first, updates, "product_id", ["lead_time_days"], _effective(turn))
    _p, customers, _s, sites = _keys(t)
    got = star.fact_sales(t, both, customers, sites)
    named = got.join(both.select("product_key", "lead_time_days"), "product_key")
    day = int(turn.strftime("%Y%m%d"))
    assert named.count() == 8
    for r in named.collect():
        assert (r.lead_time_days == 50) == (r.date_key >= day)


def test_sums_beyond_a_trillion(spark, t):
    products, customers, _s, sites = _keys(t)
    sales = star.fact_sales(t, products, customers, sites)
    big = sales.withColumn("net_amount", F.lit("7000000000000.00").cast("decimal(18,2)"))
    rows = star.refresh_abc(big, as_of=TODAY).collect()
    assert max(r.cumulative_revenue for r in rows) > 10**13
    assert star.agg_sales_monthly(big).agg(F.sum("net_revenue")).first()[0] > 10**13
