"""Plan checks: what reaches the scan, how rows move, what must not appear."""

from __future__ import annotations

import contextlib
import io

import pytest

from stocklens import open_tables
from pyspark.sql import functions as F

from stocklens.operators import abc, forecast, fulfilment, inventory, quality, suppliers
from stocklens.operators.sales import live_lines
from stocklens.plans import extracts
from stocklens.sources import bucketed
from stocklens.sources.bucketed import open_bucketed, save_bucketed
from stocklens.sources.tables import Tables
from suite.core import load_all
from suite.orderbook import OrderBook

FOLDER = "/root/testdata/sf0.001"


def explained(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def t(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("domain"))
    source = OrderBook(spark, FOLDER).tables()
    for name in source.names():
        source(name).write.parquet(f"{folder}/{name}.parquet")
    return open_tables(spark, folder, "parquet")


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_filters_and_columns_reach_the_scan(t):
    plan = explained(abc.abc_summary(t, as_of="2001-08-01"))
    assert "GreaterThanOrEqual(order_date,2000-08-01)" in plan
    assert "Not(EqualTo(status,Cancelled))" in plan
    assert "ReadSchema: struct<so_id:bigint,order_date:date,status:string>" in plan


# The queries that join; counts and rankings over them add no join of their own.
JOINING = [
    "abc_summary", "carrying_costs_sql", "daily_sales", "dq_references", "eoq_histogram",
    "exponential_smoothing_forecast", "forecast_accuracy", "inventory_extract", "inventory_ledger",
    "kpi_summary", "lead_time_by_supplier_product", "reorder_points_sql", "reorder_policy",
    "sales_extract", "scd2_merge", "seasonality_profile", "stockout_impact_sql",
    "supplier_scorecard_sql", "supplier_tier_counts", "timeseries_extract", "turnover_pandas",
    "vw_sales_dashboard", "vw_supplier_scorecard",
]


def test_nothing_is_multiplied_out_or_run_in_python(spark, no_broadcast):
    for name in JOINING:
        plan = explained(load_all()[name].run(spark, FOLDER))
        assert "CartesianProduct" not in plan and "Python" not in plan, name
        assert "BroadcastNestedLoopJoin" not in plan, name


def test_no_single_task_holds_all_products(t):
    """A single partition only ever holds sums: of coarse buckets, or of everything."""
    plan = abc.abc_detail(t)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    for k, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "keys=[_c#" in lines[k + 1] or "keys=[]" in lines[k + 1], lines[k + 1]


def scans_of(spark, table, df):
    """Scans of a table in the initial plan; parts that are used twice count once."""
    plan = explained(df).split("\n\n")
    return sum("Scan parquet" in part and f"/{table}.parquet" in part for part in plan)


def test_lines_are_scanned_few_times(spark, no_broadcast):
    queries = load_all()
    most = {"supplier_extract": 2, "supplier_scorecard_sql": 4, "reorder_points_sql": 4, "fact_purchases": 2}
    for name, n in most.items():
        assert scans_of(spark, "lineitem", queries[name].run(spark, FOLDER)) <= n, name


def table_scans(df, table):
    return sum("Scan parquet" in part and f"/{table}.parquet" in part for part in explained(df).split("\n\n"))


def test_purchase_lines_are_read_once(t, no_broadcast):
    for build in (
        suppliers.supplier_scorecard_sql,
        suppliers.supplier_scores_extract,
        suppliers.lead_time_by_supplier_product,
        inventory.reorder_points_sql,
    ):
        assert table_scans(build(t), "purchase_order_items") == 1, build
    # Orders are read once for both grains; the day of the latest is a subquery of its own.
    plan = explained(suppliers.supplier_scorecard_sql(t)).split("Subqueries")[0].split("\n\n")
    assert sum("Scan parquet" in part and "/purchase_orders.parquet" in part for part in plan) == 1


def test_the_first_order_key_reaches_the_scan_of_the_lines(spark, tmp_path):
    """Orders numbered by day: a window of days reads the row groups of its own lines."""
    days = spark.range(0, 40000, 1, 1).selectExpr("id AS so_id", "date_add(date'2024-01-01', cast(id div 100 as int)) AS order_date", "'Shipped' AS status")
    days.write.parquet(f"{tmp_path}/sales_orders.parquet")
    lines = spark.range(0, 160000, 1, 1).selectExpr("id AS so_item_id", "id div 4 AS so_id", "id % 7 AS product_id", "1 AS quantity_ordered")
    lines.write.option("parquet.block.size", 100_000).parquet(f"{tmp_path}/sales_order_items.parquet")
    orders, items = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("sales_orders", "sales_order_items"))
    shop = Tables.of(sales_orders=orders, sales_order_items=items.withColumn("line_total", F.lit(1)))
    since = F.date_sub(orders.agg(F.max("order_date")).scalar(), 30)
    found = live_lines(shop, [], ["product_id", "quantity_ordered"], since)
    assert found.count() == 31 * 100 * 4
    node = found.select("so_id", "quantity_ordered")
    node.collect()
    plan = node._jdf.queryExecution().executedPlan()
    assert "so_id" in explained(node).split("sales_order_items")[1].split("PushedFilters:")[1].split("\n")[0]
    read = [int(x) for x in rows_read(plan) if x]
    assert min(read) < 0.5 * 160000, read


def rows_read(plan) -> list[int]:
    """Rows that the scans of lines put out."""
    out = []

    def walk(p) -> None:
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return walk(p.executedPlan())
        if p.getClass().getSimpleName().endswith("QueryStageExec"):
            return walk(p.plan())
        if p.getClass().getSimpleName() == "FileSourceScanExec" and "so_id" in p.toString() and "quantity_ordered" in p.toString():
            out.append(p.metrics().apply("numOutputRows").value())
        children = p.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(plan)
    return out


def test_orders_and_lines_in_buckets_join_without_an_exchange(spark, t, no_broadcast, tmp_path):
    names = ("products", "product_categories", "customers", "warehouses", "sales_orders", "sales_order_items")
    save_bucketed(Tables.of(**{n: t(n) for n in names}), "side_by_side", 4, str(tmp_path / "db"))
    side = open_bucketed(spark, "side_by_side")
    lines = live_lines(side, ["warehouse_id"], ["product_id", "quantity_ordered"])
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and "Bucketed: true" in explained(lines)
    # The same below the ABC classes and in the fold of lines per order.
    for df in (abc.abc_summary(side, as_of="2001-08-01"), fulfilment.fill_rate_service(side, as_of="2001-08-01")):
        tree = df._jdf.queryExecution().executedPlan().toString()
        join = tree[: tree.index("BucketedScan") if "BucketedScan" in tree else len(tree)]
        assert "hashpartitioning(so_id" not in join


def test_buckets_follow_the_lines(spark, t, monkeypatch, tmp_path):
    few = {n: t(n) for n in ("products", "sales_orders", "sales_order_items")}
    lines = few["sales_order_items"].count()
    monkeypatch.setattr(bucketed, "LINES_PER_BUCKET", -(-lines // 13))
    save_bucketed(Tables.of(**few), "many_lines", folder=str(tmp_path / "db"))
    for name in ("sales_orders", "sales_order_items"):
        described = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED many_lines.{name}").collect()}
        assert described["Num Buckets"] == "13"
    assert spark.table("many_lines.sales_order_items").count() == lines
    assert bucketed.buckets_for(Tables.of(products=t("products"))) == 8


def test_bucketed_lines_meet_their_orders_without_an_exchange(spark, t, no_broadcast, tmp_path):
    names = ("products", "product_categories", "customers", "warehouses", "sales_orders", "sales_order_items")
    save_bucketed(Tables.of(**{n: t(n) for n in names}), "extract_side", 4, str(tmp_path / "db"))
    side = open_bucketed(spark, "extract_side")
    one = extracts.sales_extract(side, side("products", "product_id").withColumn("abc_class", F.lit("A")))
    tree = one._jdf.queryExecution().executedPlan().toString()
    # Orders move to meet their customers and sites, and once to their buckets; lines move by product only.
    moved = [line for line in tree.split("\n") if "Exchange hashpartitioning(so_id" in line]
    assert len(moved) == 1, moved


def test_many_rows_in_a_small_file_are_not_broadcast(spark, tmp_path):
    """The files have some hundred kilobytes, the rows some ten megabytes and more."""
    ids = spark.range(400_000).select(F.col("id").alias("product_id"))
    ids.selectExpr("product_id", "'name' AS sku", "1L AS category_id", "CAST(2 AS DECIMAL(12,2)) AS unit_cost").write.parquet(
        f"{tmp_path}/products.parquet"
    )
    ids.selectExpr("0L AS warehouse_id", "product_id", "5L AS quantity_on_hand", "0L AS quantity_reserved").write.parquet(f"{tmp_path}/inventory.parquet")
    big = open_tables(spark, str(tmp_path), "parquet", ["products", "inventory"])
    joined = big("inventory", "product_id", "quantity_on_hand").join(big("products", "product_id", "unit_cost"), "product_id")
    assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 400_000
    few = spark.createDataFrame([(0, "W")], "warehouse_id long, warehouse_code string")
    few.write.parquet(f"{tmp_path}/warehouses.parquet")
    sites = open_tables(spark, str(tmp_path), "parquet", ["warehouses"])("warehouses", "warehouse_id", "warehouse_code")
    plan = big("inventory", "warehouse_id", "product_id").join(sites, "warehouse_id")._jdf.queryExecution().executedPlan()
    assert "BroadcastHashJoin" in plan.toString()


def test_one_scan_a_child_table(t, no_broadcast):
    refs = [r for r in quality.REFERENCES if r[0] == "sales_order_items"]
    plan = explained(quality.check_references(t, refs)).split("\n\n")
    assert sum("Scan parquet" in x and "/sales_order_items.parquet" in x for x in plan) == 1


def test_lines_move_twice_in_the_sales_extract(t, no_broadcast):
    plan = explained(extracts.sales_extract(t))
    initial = plan.split("(1) Scan")[0]
    # Seven for the extract; the ABC classes join sums per product, value and bucket.
    assert initial.count("SortMergeJoin") <= 7 + 5


def test_orders_are_folded_before_the_join(t, no_broadcast):
    plan = explained(fulfilment.fill_rate_service(t))
    assert plan.index("HashAggregate") < plan.rindex("SortMergeJoin")


@pytest.mark.parametrize(
    "build",
    [
        lambda t: inventory.turnover_sql(t),
        lambda t: forecast.exponential_smoothing_forecast(t),
        lambda t: forecast.forecast_accuracy(t),
    ],
)
def test_no_gap_rows_and_no_fan_out(t, no_broadcast, build):
    """The only generator allowed is the one that repeats a finished forecast."""
    assert explained(build(t)).count("Generate") <= 2
