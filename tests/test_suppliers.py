from __future__ import annotations

import pytest
from shop import by, purchase, po_line, shop

from stocklens.operators import suppliers
from stocklens.plans import boards


@pytest.fixture(scope="module")
def t(spark):
    return shop(spark)


def test_performance_keeps_suppliers_without_orders(t):
    rows = by(suppliers.supplier_performance(t), "supplier_id")
    assert rows[2]["total_orders"] == 0 and rows[2]["on_time_delivery_rate"] is None
    assert rows[0]["total_orders"] == 4 and rows[0]["delivered_orders"] == 3
    assert rows[0]["on_time_delivery_rate"] == 100.0  # the open order is not counted


def test_scorecard_uses_mapped_products_only(t):
    rows = by(suppliers.supplier_scorecard_sql(t), "supplier_id")
    assert rows[3]["fill_rate_pct"] == 50.0  # product 0 is not mapped to supplier 3
    assert rows[0]["supplier_tier"] == "Platinum"
    assert rows[0]["reliability_score"] == 100.0
    assert rows[1]["delivery_variance_stddev"] is None
    assert 2 not in rows


def test_scores_over_all_items(t):
    rows = by(suppliers.supplier_scores(t), "supplier_code")
    assert rows["S3"]["fill_rate"] == 62.5
    # A single delivery has no spread and gets the full 20 points.
    assert rows["S1"]["reliability_score"] == pytest.approx(0 * 0.4 + 90 * 0.4 + 20)


def test_extract_scores_count_open_orders_as_late(t):
    rows = by(suppliers.supplier_scores_extract(t), "supplier_id")
    assert rows[0]["on_time_rate"] == 0.75 and rows[0]["fill_rate"] == 0.75
    assert rows[1]["lead_time_std"] == 0.0 and rows[1]["consistency_score"] == 1.0
    assert rows[3]["consistency_score"] == 0.0  # clipped


def test_supplier_with_only_open_orders_has_no_score(spark):
    t = shop(spark, purchase_orders=[purchase(1, 0, 5, 10, None)], purchase_order_items=[po_line(1, 1, 0, 10, 0)])
    row = suppliers.supplier_scores_extract(t).collect()[0]
    assert (row.avg_lead_time, row.consistency_score, row.reliability_score) == (None, None, None)


def test_lead_time_labels_for_unknown_spread_differ(spark):
    t = shop(spark)
    rows = by(suppliers.lead_time_by_supplier(t), "supplier_code")
    assert rows["S1"]["cv_pct"] is None and rows["S1"]["reliability_category"] == "Highly Reliable"
    assert rows["S3"]["reliability_category"] == "Unreliable"
    pairs = by(suppliers.lead_time_by_supplier_product(t, min_deliveries=1), "supplier_id", "product_id")
    assert pairs[1, 1]["reliability_category"] == "Unreliable"
    assert pairs[0, 0]["reliability_category"] == "Highly Reliable"


def test_minimum_deliveries(t):
    rows = by(suppliers.lead_time_by_supplier_product(t), "supplier_id", "product_id")
    assert set(rows) == {(0, 0), (3, 2)}


def test_tier_counts_list_every_tier(t):
    assert [r.tier for r in boards.supplier_tier_counts(t).collect()] == ["Platinum", "Gold", "Silver", "Bronze"]
    assert sum(r.supplier_count for r in boards.supplier_tier_counts(t).collect()) == 3
