from __future__ import annotations

import datetime as dt

import pytest
from shop import FORECASTS, TODAY, by, day, line, sale, shop

from stocklens.operators import forecast, fulfilment, ledger, stockouts


@pytest.fixture(scope="module")
def t(spark):
    return shop(spark)


def test_stockout_impact_sql_closes_open_events_now(t):
    rows = by(stockouts.stockout_impact_sql(t, as_of="2025-06-30 00:00:00"), "warehouse_code", "sku")
    row = rows["W0", "SKU-0"]
    days = (47 / 24 + 2) / 2
    assert row["avg_stockout_duration_days"] == round(days, 1)
    assert row["severity_score"] == round(2 * 30 + days * 10 + 1)
    assert ("W1", "SKU-1") not in rows  # over a year ago


def test_stockout_impact_uses_whole_days_of_closed_events(t):
    rows = by(stockouts.stockout_impact(t), "warehouse_code", "sku")
    assert rows["W0", "SKU-0"]["avg_duration_days"] == 1.0
    open_only = rows["W1", "SKU-1"]
    assert (open_only["avg_duration_days"], open_only["severity_score"]) == (None, None)


def test_events_that_end_before_they_start_floor_down(spark):
    bad = dict(stockout_id=1, warehouse_id=0, product_id=0, stockout_start_date=dt.datetime(2025, 6, 2, 1),
               stockout_end_date=dt.datetime(2025, 6, 2), demand_during_stockout=1, lost_sales_amount=None)
    t = shop(spark, stockout_events=[bad])
    assert stockouts.stockout_impact(t).collect()[0].avg_duration_days == -1.0


def test_weekdays_start_on_sunday(t):
    rows = by(stockouts.stockouts_by_weekday(t, as_of="2025-06-30 00:00:00"), "dow_num")
    assert {k: r["day_of_week"] for k, r in rows.items()} == {0: "Sunday", 6: "Saturday"}


def test_root_causes_leave_out_the_unknown(t):
    rows = stockouts.stockout_root_causes(t).collect()
    assert [(r.root_cause, r.occurrence_count, r.pct_of_stockouts) for r in rows] == [("Demand spike", 2, 100.0)]


@pytest.mark.parametrize("shipped, grade", [(98, "A"), (97, "B"), (94, "C"), (89, "D")])
def test_fill_grades(spark, shipped, grade):
    lines = [line(1, 1, 0, 50, 50, "1.00"), line(2, 1, 1, 50, shipped - 50, "1.00")]
    row = fulfilment.fill_rate_service(shop(spark, sales_order_items=lines)).collect()[0]
    assert row.service_grade == grade and row.unit_fill_rate == float(shipped)
    assert row.order_fill_rate == 100.0  # one complete line is enough
    assert row.order_fill_rate_strict == 0.0


def test_pending_orders_are_not_fulfilment(t):
    rows = by(fulfilment.fill_rate_service(t), "warehouse_code")
    assert rows["W0"]["total_orders"] == 2 and rows["W0"]["total_line_items"] == 4


SERIES = {0: [(30, 10), (28, 4), (27, 7), (20, 9), (9, 1), (3, 6)], 1: [(5, 3)], 2: [(4, 5), (3, 2)]}


def _series_shop(spark):
    orders, lines = [], []
    for p, points in SERIES.items():
        for back, q in points:
            n = 100 * p + back
            orders.append(sale(n, back))
            lines.append(line(n, n, p, q, q, "1.00"))
    return shop(spark, sales_orders=orders, sales_order_items=lines)


def _filled(points):
    days = dict(points)
    first, last = max(days), min(days)
    return last, [days.get(b, 0) for b in range(first, last - 1, -1)]


@pytest.mark.parametrize("window", [1, 2, 7, 50])
def test_moving_average_equals_the_filled_series(spark, window):
    got = forecast.moving_average_forecast(_series_shop(spark), window=window, forecast_days=3).collect()
    for p, points in SERIES.items():
        last, values = _filled(points)
        tail = values[-window:]
        mine = sorted((r.date, r.forecasted_quantity) for r in got if r.product_id == p)
        assert mine == [(day(last - k), round(sum(tail) / len(tail))) for k in (1, 2, 3)]


@pytest.mark.parametrize("alpha", [0.1, 0.3, 0.9, 1.0])
def test_exponential_smoothing_equals_the_recursion(spark, alpha):
    got = forecast.exponential_smoothing_forecast(_series_shop(spark), alpha=alpha, forecast_days=1).collect()
    for p, points in SERIES.items():
        last, values = _filled(points)
        level = values[0]
        for x in values[1:]:
            level = alpha * x + (1 - alpha) * level
        mine = [(r.date, r.forecasted_quantity) for r in got if r.product_id == p]
        assert mine == [(day(last - 1), round(level))]


def test_forecast_of_an_unknown_product_is_empty(spark):
    assert forecast.moving_average_forecast(_series_shop(spark), product_id=99).collect() == []


def test_daily_demand_filters_accept_zero(t):
    assert {r.product_id for r in forecast.daily_demand(t, product_id=0).collect()} == {0}
    assert {r.product_id for r in forecast.daily_demand(t, warehouse_id=1).collect()} == {3}


def test_forecast_accuracy(t):
    rows = by(forecast.forecast_accuracy(t, as_of=TODAY), "sku")
    hit = rows["SKU-0"]
    assert hit["forecast_periods"] == 2  # the weekly one is left out
    assert hit["mape"] == 10.0 and hit["accuracy_grade"] == "Excellent"  # 11 against 10
    assert (hit["mae"], hit["forecast_bias"]) == (2.0, 2.0)
    miss = rows["SKU-4"]  # only a cancelled order that day
    assert miss["mape"] is None and miss["accuracy_grade"] == "Poor"


def test_forecast_join_does_not_fan_out(spark):
    """Several orders and lines on the forecast's day still make one period."""
    t = shop(
        spark,
        sales_orders=[sale(1, 0), sale(2, 0)],
        sales_order_items=[line(1, 1, 0, 3, 3, "1.00"), line(2, 1, 1, 8, 8, "1.00"), line(3, 2, 0, 7, 7, "1.00")],
        demand_forecasts=FORECASTS[:1],
    )
    row = forecast.forecast_accuracy(t, as_of=TODAY).collect()[0]
    assert (row.forecast_periods, row.mae) == (1, 1.0)


def test_ledger(t):
    rows = ledger.inventory_ledger(t).collect()
    received = sum(r.quantity for r in rows if r.transaction_type == "Receipt")
    assert received == 64 and all(r.quantity < 0 for r in rows if r.transaction_type == "Sale")
    assert len({r.transaction_id for r in rows}) == len(rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, ledger.inventory_ledger(t).collect()))


def test_order_totals(t):
    rows = by(ledger.order_totals(t), "order_kind", "order_id")
    assert rows["SO", "2"]["lines_total"] == 80 and rows["SO", "2"]["difference"] == -80
    assert rows["PO", "8"]["lines_total"] == 50


def test_reorder_policy(t):
    rows = by(ledger.reorder_policy(t), "warehouse_id", "product_id")
    assert rows[0, 0]["reorder_point"] == 116 * 6 // 400
    assert rows[0, 0]["reorder_quantity"] == 116 * 30 // 400


def test_stockout_candidates(t):
    assert [(r.warehouse_id, r.product_id) for r in ledger.stockout_candidates(t).collect()] == [(1, 0)]


def test_seasonality_index_averages_to_the_mean(t):
    rows = [r for r in ledger.seasonality_profile(t).collect() if r.period == "weekday"]
    days = sum(r.days for r in rows)
    assert sum(r.demand_index * r.days for r in rows) / days == pytest.approx(1.0)


def test_table_counts(t):
    rows = by(ledger.table_counts(t), "table_name")
    assert rows["sales_orders"]["row_count"] == 6
    assert (rows["sales_orders"]["first_date"], rows["sales_orders"]["last_date"]) == (day(400), TODAY)
    assert rows["products"]["first_date"] is None
