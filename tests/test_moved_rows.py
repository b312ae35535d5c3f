"""What moves between tasks, and that it gives the same rows."""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import time

import pytest
from pyspark.sql import functions as F
from shop import TODAY, shop

from stocklens.operators import ledger, quality
from stocklens.plans import extracts, loads, star, stock_history, warehouse
from stocklens.sources import tables
from suite import round_trips, updates
from suite import star as star_queries
from suite.orderbook import OrderBook

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def explained(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def exchanges(df):
    return [p for p in explained(df).split("\n\n") if p.strip().startswith("(") and "Exchange" in p.strip().split("\n")[0]]


def _stored(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _facts(spark, path):
    t, since = shop(spark), F.lit(str(TODAY)).cast("date")
    products, sites = star.product_versions(t, since), star.dim_warehouse(t)
    sales = star.fact_sales(t, products, star.customer_versions(t, since), sites)
    bought = star.fact_purchases(t, products, star.supplier_versions(t, since), sites)
    return _stored(sales, f"{path}/sales"), _stored(bought, f"{path}/bought")


def test_lines_move_once_for_a_months_figures(spark, tmp_path):
    sales, bought = _facts(spark, tmp_path)
    for df in (star.agg_sales_monthly(sales), star.supplier_months(bought)):
        assert len(exchanges(df)) == 1
    # An order with two lines of a product counts once; lines without an order count for none.
    twice = sales.unionByName(sales).unionByName(sales.withColumn("sales_order_number", F.lit(None).cast("string")))
    key = ["year", "month", "product_key", "warehouse_key"]
    one = {tuple(r[k] for k in key): r for r in star.agg_sales_monthly(sales).collect()}
    many = {tuple(r[k] for k in key): r for r in star.agg_sales_monthly(twice).collect()}
    assert one.keys() == many.keys()
    for k, r in one.items():
        assert many[k].total_orders == r.total_orders and many[k].net_revenue == 3 * r.net_revenue


def test_digests_move_hashes_of_lines_and_orders(spark, no_broadcast):
    t = shop(spark)
    for load in (loads.SALES, loads.PURCHASES):
        moved = [p for p in exchanges(loads.source_digests(t, load)) if f"hashpartitioning({load.order_key}" in p]
        assert len(moved) == 2
        for p in moved:
            given = p.split("]: [")[1].split("]")[0]
            assert {c.split("#")[0].strip() for c in given.split(",")} <= {load.order_key, "_line_one", "month", "_order"}, given


def test_still_stock_moves_once_a_year(spark, tmp_path):
    days = [(0, 1, dt.date(2023, 5, 5), dt.date(2025, 2, 3), 7), (0, 2, dt.date(2024, 1, 31), dt.date(2024, 2, 1), 3)]
    df = spark.createDataFrame(days, "warehouse_id int, product_id int, from_date date, until_date date, quantity_on_hand long")
    tree = explained(stock_history.monthly(df)).split("\n\n")[0]
    assert tree.count("Generate") == 2 and tree.index("Generate") < tree.index("Exchange") < tree.rindex("Generate")
    stock_history.save_history(df, f"{tmp_path}/h")
    got = sorted((r.product_id, r.from_date, r.until_date, r.month_key) for r in spark.read.parquet(f"{tmp_path}/h").collect())
    assert len(got) == 22 + 1 and got[-1] == (2, dt.date(2024, 1, 31), dt.date(2024, 2, 1), 202401)
    assert got[0][1:] == (dt.date(2023, 5, 5), dt.date(2023, 6, 1), 202305)
    assert got[21][1:] == (dt.date(2025, 2, 1), dt.date(2025, 2, 3), 202502)
    assert all(a[2] == b[1] for a, b in zip(got[:21], got[1:22], strict=True))


def test_movements_move_once_for_their_intervals(spark, no_broadcast):
    moves = spark.createDataFrame([(0, 1, TODAY, 5)], "warehouse_id int, product_id int, transaction_date date, quantity int")
    tree = explained(stock_history.stock_intervals(shop(spark).replaced(inventory_transactions=moves), TODAY)).split("Subqueries")[0]
    assert sum("Arguments: hashpartitioning(warehouse_id" in line for line in tree.split("\n")) == 1


def test_updates_read_their_sources_from_files(spark):
    t = OrderBook(spark, FOLDER).tables()
    kept = updates._sources(t, loads.SALES, loads.PURCHASES)
    for load in (loads.SALES, loads.PURCHASES):
        for name in (load.lines, load.orders):
            assert not exchanges(kept(name)) and "Join" not in explained(kept(name))
            was = t(name, *kept(name).columns)
            assert was.exceptAll(kept(name)).count() == kept(name).exceptAll(was).count() == 0


def test_the_ledger_is_made_of_stored_tables(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(round_trips, "with_ledger", lambda t, made=round_trips.with_ledger: seen.append(t) or made(t))
    round_trips._reopened(OrderBook(spark, FOLDER).tables())
    assert len(seen) == 1 and not exchanges(seen[0]("purchase_orders")) and "Join" not in explained(seen[0]("purchase_order_items"))


def test_lines_side_by_side_with_their_orders_stay_for_digests_and_facts(spark, no_broadcast):
    t = OrderBook(spark, FOLDER).tables()
    kept = updates._sources(t, loads.SALES, loads.PURCHASES)
    assert not any("hashpartitioning(po_id" in p for p in exchanges(loads.source_digests(kept, loads.PURCHASES)))
    assert not any("hashpartitioning(po_id" in p and "po_item_id" in p for p in exchanges(updates._purchases(kept)(kept)))
    for load in (loads.SALES, loads.PURCHASES):
        assert kept.stored_by(load.lines) == load.order_key and t.stored_by(load.lines) is None
        assert loads.collected(loads.source_digests(kept, load)) == loads.collected(loads.source_digests(t, load))


def test_a_facts_month_does_not_move(spark, tmp_path):
    rows = [(20240131, 2, "a"), (20240201, 1, "b"), (None, 1, "c"), (20240105, 1, "d")]
    df = spark.createDataFrame(rows, "date_key int, product_key int, name string")
    star.save_fact(df, f"{tmp_path}/f", "date_key", "product_key", whole=True)
    got = spark.read.parquet(f"{tmp_path}/f").collect()
    assert {(r.date_key, r.product_key, r.name, r.month_key) for r in got} == {(*r, r[0] and r[0] // 100) for r in rows}
    assert list(tmp_path.glob("f/month_key=202401/*.zstd.parquet"))


def test_purchase_heads_move_once_to_their_orders(spark, no_broadcast):
    t = OrderBook(spark, FOLDER).tables()
    for columns in (["po_id", "order_date"], ["po_id", "status", "total_amount"]):
        moved = [p for p in exchanges(t("purchase_orders", *columns)) if "hashpartitioning(l_orderkey" in p]
        assert len(moved) == 1 and not any("l_suppkey" in p.split("hashpartitioning(")[1].split(")")[0] for p in moved)


def test_keys_of_one_table_share_what_they_are_made_of(spark):
    t = OrderBook(spark, FOLDER).tables()
    df = quality.check_unique(t, {"purchase_orders": [["po_id"], ["po_number"]]})
    assert [(r.duplicated_keys, r.surplus_rows) for r in df.collect()] == [(0, 0), (0, 0)]
    assert "ReusedExchange" in explained(df)


def test_keys_with_a_null_do_not_collide(spark):
    rows = [(1, 1), (1, 1), (1, 1), (2, None), (2, None), (None, None), (None, None), (3, 3)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert [tuple(r) for r in quality.key_violations(df, ["a", "b"]).collect()] == [(1, 1, 3)]
    assert sorted(tuple(r) for r in quality.key_violations(df, ["a"]).collect()) == [(1, 3), (2, 2)]


def test_what_a_write_moved_is_deleted_when_it_ends(spark, tmp_path):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(setting), []
    with tables.freed_shuffles(spark):
        seen.append(spark.conf.get(setting))
    assert seen == ["true"] and spark.conf.get(setting) == before

    def moved():
        place = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {n for n in place.getAllFiles().mkString("\n").split("\n") if n.endswith((".data", ".index"))}

    there = moved()
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("date_key")).agg(F.count("*").alias("n"))
    tables.write_extract(df, f"{tmp_path}/a")
    star.save_fact(df, f"{tmp_path}/b", "date_key", "n", whole=True)
    assert loads.collected(df.selectExpr("int(date_key) AS month", "n", "n AS s", "n AS x")).keys() == set(range(7))
    for _ in range(50):
        if moved() <= there:
            break
        time.sleep(0.1)
    assert moved() <= there


def test_a_long_fact_is_written_in_parts(spark, tmp_path, monkeypatch):
    t = OrderBook(spark, FOLDER).tables()
    kept = updates._sources(t, loads.SALES)
    # A line without its order, and an order without a date.
    orders = kept("sales_orders").where("so_id % 50 <> 7").withColumn("order_date", F.when(F.col("so_id") % 40 != 3, F.col("order_date")))
    kept = kept.replaced(sales_orders=orders)
    build = updates._sales(kept)
    writes = []
    monkeypatch.setattr(loads, "save_fact", lambda *a, save=star.save_fact, **k: writes.append(k) or save(*a, **k))
    whole = loads.load_fact(kept, f"{tmp_path}/one", loads.SALES, build)
    assert len(writes) == 1
    monkeypatch.setattr(loads, "LINES_PER_WRITE", 2000)
    parts = loads.load_fact(kept, f"{tmp_path}/many", loads.SALES, build)
    assert len(writes) >= 5 and [k["whole"] for k in writes[1:]] == [True] + [False] * (len(writes) - 2)
    assert whole.count() == t("sales_order_items").count() and whole.where("date_key IS NULL").count() > 0
    assert whole.exceptAll(parts).count() == parts.exceptAll(whole).count() == 0
    # What is left to do is done in parts as well.
    before = len(writes)
    late = kept.replaced(sales_orders=orders.withColumn("actual_ship_date", F.date_add("actual_ship_date", 1)))
    assert loads.update_fact(late, f"{tmp_path}/many", loads.SALES, build) and len(writes) > before + 3
    again, now = spark.read.parquet(f"{tmp_path}/many/fact_sales"), build(late)
    assert again.select(now.columns).exceptAll(now).count() == 0 and again.count() == now.count()
    # Lines that do not lie by their order are read once.
    assert loads._writes(t, loads.SALES, {202401, None}, {202401: (5000, 0, 0)}) == [{202401, None}]


def test_keys_from_a_members_versions_are_those_of_its_days(spark):
    day = lambda m, d=1: dt.date(2024, m, d)
    dim = spark.createDataFrame(
        [
            (1, 100, day(2), None),  # one open version
            (2, 200, day(2), day(5)), (2, 201, day(5), day(8)), (2, 202, day(8), None),
            (3, 300, day(3), day(6)),  # one that ended
            (4, 400, day(4), None), (4, 400, day(4), None),  # the same twice
            (5, None, day(4), None), (None, 600, day(4), None),
        ],
        "product_id int, product_key long, effective_date date, expiration_date date",
    )
    days = [None, day(1), day(2), day(4, 30), day(5), day(7), day(8), day(12)]
    rows = spark.createDataFrame([(p, d) for p in (1, 2, 3, 4, 5, 6, None) for d in days], "product_id int, d date")
    was = star._with_key(rows, dim, "product_id", "d")
    now = star._key_on(star._with_versions(rows, dim, "product_id"), "product_id", "d")
    got = lambda df: sorted(map(str, df.select("product_id", "d", "product_key").collect()))
    assert got(now) == got(was) and len(got(now)) > rows.count()


def _text(df, column):
    """Exchanges by one column that carry another."""
    by, carried = column
    return [p for p in exchanges(df) if f"hashpartitioning({by}" in p and carried in p.split("]: [")[1].split("]")[0]]


def test_purchase_lines_do_not_move_to_their_products_again(spark, no_broadcast, tmp_path):
    t, since = OrderBook(spark, FOLDER).tables(), F.lit(str(TODAY)).cast("date")
    keys = star.product_versions(t, since), star.supplier_versions(t, since), star.dim_warehouse(t)
    fact = star.fact_purchases(t, *keys)
    assert not _text(fact, ("product_id", "po_item_id")) and len(_text(fact, ("po_id", "po_item_id"))) == 1
    parts = star.fact_purchases(t, *keys, folder=str(tmp_path))
    assert "Join" not in explained(spark.read.parquet(f"{tmp_path}/lines")) and len(exchanges(parts)) < len(exchanges(fact))
    assert fact.count() == parts.count() == t("purchase_order_items").count()
    assert fact.exceptAll(parts).count() == 0


def test_a_ledger_and_its_keys_are_made_one_after_the_other(spark, no_broadcast, tmp_path):
    t = OrderBook(spark, FOLDER).tables()
    whole, parts = ledger.inventory_ledger(t), ledger.inventory_ledger(t, f"{tmp_path}/l")
    assert whole.columns == parts.columns and whole.count() == parts.count()
    assert whole.exceptAll(parts).count() == 0 and "po_id" not in explained(parts)
    keys = {"purchase_orders": [["po_id"]], "inventory_transactions": [["transaction_id"]], "absent": [["x"]]}
    t = t.replaced(inventory_transactions=parts.unionByName(parts.where("quantity = 7")))
    once = quality.check_unique(t, keys)
    staged = quality.check_unique(t, keys, folder=f"{tmp_path}/c")
    assert not exchanges(staged) and sorted(staged.collect()) == sorted(once.collect())
    assert [r.surplus_rows > 0 for r in sorted(staged.collect())] == [True, False]


def test_texts_of_few_members_do_not_move_with_lines(spark, no_broadcast):
    t = OrderBook(spark, FOLDER).tables()
    assert not _text(extracts.sales_extract(t), ("product_id", "warehouse_name"))
    since = F.lit(str(TODAY)).cast("date")
    s = {
        "fact_sales": star.fact_sales(t, star.product_versions(t, since), star.customer_versions(t, since), star.dim_warehouse(t)),
        "dim_date": star.order_calendar(t), "dim_product": star.dim_product(t, since),
        "dim_customer": star.dim_customer(t, since), "dim_warehouse": star.dim_warehouse(t),
    }
    view = star.vw_sales_dashboard(*[s[n] for n in ("fact_sales", "dim_date", "dim_product", "dim_customer", "dim_warehouse")])
    assert not _text(view, ("customer_key", "month_name")) and not _text(view, ("product_key", "month_name"))


def test_aggregates_are_made_in_parts_of_their_months(spark, tmp_path, monkeypatch):
    sales, bought = _facts(spark, f"{tmp_path}/src")
    for name, df, key in (("fact_sales", sales, "date_key"), ("fact_purchases", bought, "order_date_key")):
        undated = df.withColumn(key, F.lit(None).cast("int")).limit(1)
        star.save_fact(df.unionByName(undated), f"{tmp_path}/f/{name}", key, "product_key", whole=True)
    facts = [spark.read.parquet(f"{tmp_path}/f/{n}") for n in ("fact_sales", "fact_purchases")]
    names = ("agg_sales_monthly", "supplier_months", "agg_supplier_performance")

    def stored(folder):
        return {n: sorted(map(str, spark.read.parquet(f"{folder}/{n}").collect())) for n in names}

    warehouse.save_aggregates(f"{tmp_path}/one", *facts)
    monkeypatch.setattr(loads, "LINES_PER_WRITE", 2)
    assert len(warehouse._in_parts(facts[0])) > 2
    warehouse.save_aggregates(f"{tmp_path}/many", *facts)
    assert stored(f"{tmp_path}/one") == stored(f"{tmp_path}/many") and all(stored(f"{tmp_path}/one").values())
    # Months without rows are emptied, whichever part they are in.
    sold = {r.month_key for r in facts[0].select("month_key").distinct().collect()}
    star.save_fact(sales.limit(1), f"{tmp_path}/f/fact_sales", "date_key", "product_key", whole=True)
    (tmp_path / "many/fact_sales").symlink_to(tmp_path / "f/fact_sales")
    warehouse.update_aggregates(spark, f"{tmp_path}/many", sold, set())
    left = spark.read.parquet(f"{tmp_path}/many/agg_sales_monthly")
    assert left.agg(F.sum("total_orders")).first()[0] == 1


def test_read_back_tables_are_digested_one_after_the_other(spark):
    t = OrderBook(spark, FOLDER).tables()
    assert not exchanges(round_trips._digests({"purchase_orders": t("purchase_orders")}, round_trips._TABLES))
    assert "/agg_supplier_performance" in explained(star_queries._supplier_scorecard(t))


def test_facts_may_be_loaded_from_other_tables_than_dimensions(spark, tmp_path):
    t = shop(spark)
    gone = t("sales_order_items").agg(F.max("so_item_id")).first()[0]
    some = t.replaced(sales_order_items=t("sales_order_items").where(F.col("so_item_id") != gone))
    one = warehouse.build_star(t, f"{tmp_path}/one")
    two = warehouse.build_star(t, f"{tmp_path}/two", sources=some)
    assert one["fact_sales"].count() > two["fact_sales"].count() == some("sales_order_items").count() > 0
    for name in ("dim_product", "dim_supplier", "fact_purchases", "fact_inventory_daily"):
        assert one[name].exceptAll(two[name]).count() == two[name].exceptAll(one[name]).count() == 0, name
