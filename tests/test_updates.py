"""Loads of changes against whole loads; versions in any order; stock of past days."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import itertools
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from shop import LINES, PO_LINES, PURCHASES, SALES, STOCK, STOCKOUTS, TODAY, day, line, po_line, purchase, sale, shop, stock

from stocklens.plans import loads, star, stock_history, versions
from stocklens.plans.warehouse import build_star, update_star
from suite.core import load_all

D1, D2, D3, D4 = (dt.date(2024, m, 5) for m in (1, 3, 6, 9))
DIM = "product_id int, sku string, lead_time_days int"


def _dim(spark, first=D1):
    rows = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], DIM)
    return versions.first_versions(rows, "product_id", F.lit(str(first)).cast("date"))


def _history(dim):
    rows = dim.orderBy("product_id", "effective_date").collect()
    return [(r.product_key, r.product_id, r.sku, r.lead_time_days, r.effective_date, r.expiration_date, r.is_current) for r in rows]


def test_changes_in_any_order_give_the_same_intervals(spark):
    # Back to an earlier value, the same value twice, a new member, two values on a day.
    changes = [(1, D2, 11), (1, D3, 10), (1, D4, 10), (3, D2, 7)]
    schema = "product_id int, effective_date date, lead_time_days int"
    whole = versions.scd2_apply(_dim(spark), spark.createDataFrame(changes, schema), "product_id", ["lead_time_days"])
    want = _history(whole)
    assert [(r[3], r[4], r[5], r[6]) for r in want if r[1] == 1] == [
        (10, D1, D2, False), (11, D2, D3, False), (10, D3, D4, False), (10, D4, None, True),
    ]
    for order in list(itertools.permutations(changes))[::5]:
        dim = _dim(spark)
        for change in order:
            dim = versions.scd2_apply(dim, spark.createDataFrame([change], schema), "product_id", ["lead_time_days"])
        assert _history(dim) == want
    again = versions.scd2_apply(whole, spark.createDataFrame(changes + [(1, D2, 9)], schema), "product_id", ["lead_time_days"])
    assert _history(again) == want


def test_an_earlier_snapshot_lies_between_the_versions(spark):
    def merge(dim, lead, when):
        snapshot = spark.createDataFrame([(1, "x", lead)], DIM)
        return versions.scd2_merge(dim, snapshot, "product_id", ["lead_time_days"], F.lit(str(when)).cast("date"))

    dim = merge(merge(_dim(spark), 12, D4), 11, D2)
    mine = [r for r in _history(dim) if r[1] == 1]
    assert [(r[3], r[4], r[5]) for r in mine] == [(10, D1, D2), (11, D2, D4), (12, D4, None)]
    assert {r[2] for r in mine} == {"a"}  # not tracked
    assert _history(merge(dim, 11, D3)) == _history(dim)  # what holds on that day already
    before_first = merge(dim, 5, dt.date(2023, 1, 1))
    assert [(r[3], r[4], r[5]) for r in _history(before_first) if r[1] == 1][0] == (5, dt.date(2023, 1, 1), D1)
    assert len(_history(merge(dim, 10, dt.date(2023, 1, 1)))) == len(_history(dim))
    moved = versions.opened_since(dim, before_first, "product_id").first()
    assert moved.moved_from == dt.date(1, 1, 1) and not moved.has_new
    moved = versions.opened_since(_dim(spark), dim, "product_id").first()
    assert moved.moved_from == D2 and not moved.has_new


def _facts(t, dims=None):
    dims = dims or t
    first = F.lit("2020-01-01").cast("date")
    products, sites = star.product_versions(dims, first), star.dim_warehouse(dims)
    customers, suppliers = star.customer_versions(dims, first), star.supplier_versions(dims, first)
    return {
        loads.SALES: lambda s: star.fact_sales(s, products, customers, sites),
        loads.PURCHASES: lambda s: star.fact_purchases(s, products, suppliers, sites),
        loads.STOCKOUTS: lambda s: star.fact_stockouts(s, products, sites),
    }


def _rows(df):
    df = df.select(sorted(c for c in df.columns if c != "month_key"))
    return sorted((tuple(map(str, r)) for r in df.collect()))


def _changed(spark):
    """The shop after late news: (changed tables, months that changed per fact)."""
    shipped = [dict(s, actual_ship_date=day(1)) if s["so_id"] == 5 else s for s in SALES if s["so_id"] != 3]
    delivered = [dict(p, actual_delivery_date=day(1)) if p["po_id"] == 6 else p for p in PURCHASES]
    ended = [dict(s, stockout_end_date=dt.datetime(2025, 6, 29)) if s["stockout_id"] == 3 else s for s in STOCKOUTS]
    t = shop(
        spark,
        sales_orders=shipped + [sale(7, 700)],
        sales_order_items=LINES + [line(71, 7, 1, 1, 1, "9.00"), line(72, 99, 1, 2, 2, "9.00")],
        purchase_orders=delivered,
        purchase_order_items=PO_LINES[:-1],
        stockout_events=ended,
    )
    month = lambda back: day(back).year * 100 + day(back).month
    return t, {
        loads.SALES: {month(10), month(400), month(700), None},
        loads.PURCHASES: {month(200), month(120)},
        loads.STOCKOUTS: {202401},
    }


def _files(folder, name):
    return {str(p) for p in Path(folder, name).rglob("*.parquet")}


def test_only_the_months_that_changed_are_written(spark, tmp_path):
    t, (after, want) = shop(spark), _changed(spark)
    for load, build in _facts(t).items():
        loads.load_fact(t, str(tmp_path), load, build)
        before = _files(tmp_path, load.name)
        assert loads.update_fact(t, str(tmp_path), load, build) == set()
        assert _files(tmp_path, load.name) == before
        assert loads.update_fact(after, str(tmp_path), load, build) == want[load]
        months = {"__HIVE_DEFAULT_PARTITION__" if m is None else str(m) for m in want[load]}
        same = {f for f in before if f.split("month_key=")[1].split("/")[0] not in months}
        assert same <= _files(tmp_path, load.name) and bool(same) == (load is not loads.SALES)
        stored = spark.read.parquet(f"{tmp_path}/{load.name}")
        assert _rows(stored) == _rows(build(after))
    # The line without an order, and the line whose order is gone, have no date.
    loose = {r.sales_fact_key for r in spark.read.parquet(f"{tmp_path}/fact_sales").filter("date_key is null").collect()}
    assert loose == {"31", "72"}


def test_a_month_without_rows_left_is_empty(spark, tmp_path):
    t = shop(spark)
    build = _facts(t)[loads.SALES]
    loads.load_fact(t, str(tmp_path), loads.SALES, build)
    gone = t.replaced(sales_order_items=t("sales_order_items").where("so_id <> 5"))
    (month,) = loads.update_fact(gone, str(tmp_path), loads.SALES, build)
    assert month == day(400).year * 100 + day(400).month
    assert _rows(spark.read.parquet(f"{tmp_path}/fact_sales")) == _rows(build(gone))
    nothing = t.replaced(sales_order_items=t("sales_order_items").where("false"))
    assert loads.update_fact(nothing, str(tmp_path), loads.SALES, build) == {202506}
    assert spark.read.parquet(f"{tmp_path}/fact_sales").count() == 0


def test_members_that_come_late_and_versions_that_move(spark, tmp_path):
    t = shop(spark)
    few = t.replaced(products=t("products").where("product_id <> 2"))
    load, folder = loads.SALES, str(tmp_path)
    # Costs come from the sources, so only the keys change here.
    loads.load_fact(t, folder, load, _facts(t, few)[load])
    assert spark.read.parquet(f"{folder}/fact_sales").where("product_key = -1").count() == 1
    build = _facts(t)[load]
    assert loads.update_fact(t, folder, load, build) == set()
    new = [loads.Moved("product_id", None, True)]
    assert loads.update_fact(t, folder, load, build, new) == {202506}
    assert _rows(spark.read.parquet(f"{folder}/fact_sales")) == _rows(build(t))
    moved = [loads.Moved("customer_id", dt.date(2025, 6, 15), False), loads.Moved("supplier_id", dt.date(2020, 1, 1), True)]
    assert loads.update_fact(t, folder, load, build, moved) == {202506}
    assert loads.update_fact(t, folder, load, build, since=202401) == {202405, 202506}


def test_digests_do_not_depend_on_order_and_see_every_change(spark):
    t = shop(spark)
    base = loads.collected(loads.source_digests(t, loads.SALES))
    shuffled = t.replaced(**{n: t(n).repartition(5).orderBy(F.rand(3)) for n in ("sales_orders", "sales_order_items")})
    assert loads.collected(loads.source_digests(shuffled, loads.SALES)) == base
    assert sum(n for n, _, _ in base.values()) == len(LINES)
    swapped = t("sales_orders").withColumns(
        {"requested_delivery_date": F.col("actual_ship_date"), "actual_ship_date": F.col("requested_delivery_date")}
    )
    assert loads.collected(loads.source_digests(t.replaced(sales_orders=swapped), loads.SALES)) != base
    one, two = spark.createDataFrame([(None, 1), (1, None)], "a int, b int").select(*loads.row_hashes("ab")).collect()
    assert one[0] != two[0] and one[1] != two[1] and one[0] != one[1]
    cost = t("products").withColumn("unit_cost", F.when(F.col("product_id") == 2, 9).otherwise(F.col("unit_cost")))
    now = loads.collected(loads.source_digests(t.replaced(products=cost), loads.SALES))
    assert {m for m in now if now[m] != base[m]} == {202506}
    doubled = t.replaced(sales_order_items=t("sales_order_items").unionByName(t("sales_order_items")))
    now = loads.collected(loads.source_digests(doubled, loads.SALES))
    assert all(now[m] != base[m] for m in base)


def test_lines_move_to_their_products_as_hashes(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        loads.source_digests(shop(spark), loads.SALES).explain("formatted")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [p for p in out.getvalue().split("\n\n") if "Exchange" in p and "hashpartitioning(product_id" in p]
    assert any("_line_one" in p for p in moved)
    assert not any("so_item_id" in p or "quantity_ordered" in p for p in moved), moved


def test_update_star_equals_a_whole_load(spark, tmp_path):
    t, (after, _) = shop(spark), _changed(spark)
    build_star(t, f"{tmp_path}/star", as_of=TODAY)
    # Suppliers' scores follow from the deliveries: their dimension gets versions of today.
    for _ in range(2):
        updated = update_star(after, f"{tmp_path}/star", as_of=TODAY)
    whole = build_star(after, f"{tmp_path}/whole", as_of=TODAY)
    for name, key in [("fact_sales", "sales_fact_key"), ("fact_purchases", "purchase_fact_key"), ("fact_stockouts", "stockout_fact_key")]:
        plain = [c for c in whole[name].columns if not c.endswith("_key") or c == key or "date_key" in c]
        assert _rows(updated[name].select(plain)) == _rows(whole[name].select(plain)), name
    # Keys and aggregates are those of the stored dimensions.
    d = updated
    want = star.fact_sales(after, d["dim_product"], d["dim_customer"], d["dim_warehouse"])
    assert _rows(d["fact_sales"]) == _rows(want)
    assert _rows(d["agg_sales_monthly"]) == _rows(star.agg_sales_monthly(d["fact_sales"]))
    assert _rows(d["agg_supplier_performance"]) == _rows(star.agg_supplier_performance(d["fact_purchases"]))
    assert _rows(d["agg_abc_classification"]) == _rows(star.refresh_abc(d["fact_sales"], TODAY))


def test_snapshots_of_other_days_stay(spark, tmp_path):
    t = shop(spark)
    build_star(t, str(tmp_path), as_of=day(1))
    sold = t.replaced(inventory=t("inventory").withColumn("quantity_on_hand", F.col("quantity_on_hand") + 1))
    for _ in range(2):
        after = update_star(sold, str(tmp_path), as_of=TODAY)["fact_inventory_daily"]
    counts = {r.date_key: (r.n, r.q) for r in after.groupBy("date_key").agg(F.count("*").alias("n"), F.sum("quantity_on_hand").alias("q")).collect()}
    held = sum(s["quantity_on_hand"] for s in STOCK)
    assert counts == {20250629: (6, held), 20250630: (6, held + 6)}


def test_months_of_the_aggregates_that_are_read(spark, tmp_path):
    t = shop(spark)
    build_star(t, str(tmp_path), as_of=TODAY)
    monthly, fact = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("agg_sales_monthly", "fact_sales"))
    plan = star.refresh_abc_from_months(monthly, fact, TODAY)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month_key" in plan and "PartitionFilters: [isnotnull(year" in plan


def _by_hand(rows, moves, start, days):
    pairs = {(r["warehouse_id"], r["product_id"]): r["quantity_on_hand"] for r in rows}
    pairs |= {(w, p): 0 for w, p, _, _ in moves if (w, p) not in pairs}
    return sorted(
        (d, w, p, held - sum(q for mw, mp, when, q in moves if (mw, mp) == (w, p) and when > d))
        for (w, p), held in pairs.items() for d in days if d >= start
    )


def test_stock_of_past_days_by_brute_force(spark, tmp_path):
    rng = random.Random(2)
    moves = [(rng.randrange(2), rng.randrange(6), day(rng.randrange(200)), rng.randint(-9, 9)) for _ in range(400)]
    moves.append((1, 77, day(50), 3))  # no stock row
    ledger = spark.createDataFrame(moves + [(0, 0, None, 5), (0, 0, TODAY + dt.timedelta(3), 5)], "warehouse_id int, product_id int, transaction_date date, quantity int")
    t = shop(spark, inventory=STOCK + [stock(9, 1, 5, 4, 0, 1)]).replaced(inventory_transactions=ledger)
    intervals = stock_history.stock_intervals(t, TODAY)
    start = min(m[2] for m in moves)
    days = [TODAY, day(1), day(30), day(31), day(50), day(51), day(120), start]
    lits = [F.lit(str(d)).cast("date") for d in days]
    whole = STOCK + [stock(9, 1, 5, 4, 0, 1)]
    got = sorted(map(tuple, stock_history.stock_on(intervals, lits).collect()))
    want = _by_hand(whole, moves, start, days)
    assert got == want
    stock_history.save_history(intervals, str(tmp_path / "h"))
    stored = spark.read.parquet(str(tmp_path / "h"))
    assert sorted(map(tuple, stock_history.stock_on(stored, lits).collect())) == want
    assert stored.where("until_date <= from_date or trunc(from_date, 'month') <> trunc(date_sub(until_date, 1), 'month')").count() == 0
    # A snapshot of a past day is a fact like that of today.
    past = stock_history.as_of_day(t, intervals, lits[2])
    fact = star.fact_inventory_daily(past, star.product_versions(t, lits[-1]), star.dim_warehouse(t), day(30))
    assert fact.count() == sum(r[0] == day(30) and r[2] != 77 for r in want)


@pytest.mark.parametrize("name", ["update_fact_sales", "scd2_out_of_order", "stock_history"])
def test_registered_with_sql(name):
    assert load_all()[name].sql
