"""Writers, readers, views and whole loads: what is written is read back, counted and compared by value."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens import open_tables
from stocklens.operators.sales import sales_anchor
from stocklens.plans import extracts, loads, warehouse
from stocklens.plans import star as star_plan
from stocklens.sources.bucketed import buckets_for, open_bucketed, save_bucketed
from stocklens.sources.schemas import OPERATIONAL
from stocklens.sources.tables import Tables, freed_shuffles, insert_into, kept, read_rejects, write_extract
from suite import boards, extracts as _extract_queries, inventory, suppliers  # noqa: F401 (their SQL)
from suite.core import REGISTRY, query, row_digest, shared_folder as _folder
from suite.orders import with_ledger
from suite.star import REGIONS


def _digests(frames: dict[str, DataFrame], kinds: dict[str, dict[str, str]]) -> DataFrame:
    """(name, row_count, digest) of what was read back; texts of a CSV are cast to their kinds.

    They are made one after the other, so that what one of them moves is deleted before the next.
    """
    out, folder = None, None
    for name, df in frames.items():
        folder = folder or _folder(df.sparkSession)
        one = df.agg(F.count("*").alias("row_count"), F.expr(row_digest(kinds[name], sql=False)).alias("digest"))
        one = one.select(F.lit(name).alias("name"), "row_count", "digest")
        one = kept(one, f"{folder}/{name}")
        out = one if out is None else out.unionByName(one)
    return out


def _digests_sql(selects: dict[str, str], kinds: dict[str, dict[str, str]]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{name}' AS name, COUNT(*) AS row_count, {row_digest(kinds[name], sql=True)} AS digest FROM ({sql})"
        for name, sql in selects.items()
    )


_OUT = "name:s row_count:i digest:i"


def _kinds(columns: str) -> dict[str, str]:
    return dict(c.split(":") for c in columns.split())


def _spark(t: Tables) -> SparkSession:
    return t("products", "product_id").sparkSession


_EXTRACTS = {n: f"{n}_extract" for n in ("sales", "inventory", "supplier", "timeseries")}
_EXTRACT_KINDS = {n: REGISTRY[q].columns for n, q in _EXTRACTS.items()}
_EXTRACT_SQL = _digests_sql({n: REGISTRY[q].sql for n, q in _EXTRACTS.items()}, _EXTRACT_KINDS)


def _exported(t: Tables, fmt: str) -> DataFrame:
    spark = _spark(t)
    paths = extracts.export_all(t, _folder(spark), fmt)
    reader = spark.read.option("header", True).format(fmt)
    return _digests({name: reader.load(path) for name, path in paths.items()}, _EXTRACT_KINDS)


query("export_all", _OUT, lambda t: _exported(t, "parquet"), _EXTRACT_SQL)
query("export_csv", _OUT, lambda t: _exported(t, "csv"), _EXTRACT_SQL)

#: Columns of the tables that are written and read again; values a mapping computes in DOUBLE are left out.
_TABLES = {
    n: _kinds(c)
    for n, c in {
        "warehouses": "warehouse_id:i warehouse_code:s city:s capacity_units:i operating_cost_per_unit:m is_active:b",
        "product_categories": "category_name:s",
        "products": "product_id:i sku:s product_name:s unit_cost:m unit_price:m lead_time_days:i is_perishable:b",
        "suppliers": "supplier_id:i supplier_code:s supplier_name:s payment_terms_days:i quality_rating:m is_preferred:b",
        "product_suppliers": "product_id:i supplier_id:i unit_cost:m lead_time_days:i is_primary_supplier:b",
        "customers": "customer_id:i customer_code:s customer_name:s state:s credit_limit:m",
        "sales_orders": "so_id:i so_number:s customer_id:i warehouse_id:i order_date:d actual_ship_date:d status:s total_amount:m",
        "sales_order_items": "so_item_id:s so_id:i product_id:i quantity_ordered:i quantity_shipped:i unit_price:m line_total:m",
        "purchase_orders": "po_id:i po_number:s supplier_id:i order_date:d actual_delivery_date:d status:s total_amount:m",
        "purchase_order_items": "po_item_id:s po_id:i product_id:i quantity_ordered:i quantity_received:i unit_cost:m",
        "inventory": "inventory_id:i warehouse_id:i product_id:i quantity_on_hand:i quantity_available:i reorder_point:i",
        "inventory_transactions": "transaction_id:s warehouse_id:i product_id:i quantity:i reference_id:s unit_cost:m transaction_date:d",
        "stockout_events": "stockout_id:i warehouse_id:i product_id:i stockout_start_date:d lost_sales_amount:m root_cause:s",
        "demand_forecasts": "product_id:i warehouse_id:i forecast_date:d forecast_period:s forecasted_quantity:i",
    }.items()
}
_TABLE_SQL = {n: f"SELECT * FROM {'ledger_rows' if n == 'inventory_transactions' else n}" for n in _TABLES}


def _reopened(t: Tables) -> DataFrame:
    spark = _spark(t)
    folder = _folder(spark)
    with freed_shuffles(spark):
        for name in t.names():
            t(name).write.parquet(f"{folder}/{name}.parquet", compression="zstd")
        # The ledger is made of the tables as stored, not of what they were made of once more.
        ledger = with_ledger(open_tables(spark, folder, "parquet"))("inventory_transactions")
        ledger.write.parquet(f"{folder}/inventory_transactions.parquet", compression="zstd")
    opened = open_tables(spark, folder, "parquet")
    return _digests({name: opened(name) for name in opened.names()}, _TABLES)


query("open_tables", _OUT, _reopened, _digests_sql(_TABLE_SQL, _TABLES))


# ---- CSV, with rows that do not fit -------------------------------------------------------

#: What is written in place of a value in some rows: the column, the rows by their key, the text.
_SPOILT = {
    "products": ("unit_cost", "product_id % 50 = 3", "n/a"),
    "customers": ("credit_limit", "customer_id % 40 = 7", "1e99"),
    "sales_orders": ("order_date", "so_id % 300 = 1", "31.12."),
    "inventory": ("quantity_on_hand", "product_id % 60 = 2", "many"),
}
_CSV_KINDS = {n: _TABLES[n] for n in _SPOILT}


def _spoilt_csv(t: Tables, folder: str) -> None:
    for name, (column, rows, text) in _SPOILT.items():
        declared = OPERATIONAL[name].names
        have = t(name).withColumn(column, F.when(F.expr(rows), text).otherwise(F.col(column).cast("string")))
        columns = [F.col(c) if c in have.columns else F.lit(None).cast("string").alias(c) for c in declared]
        # Categories are long numbers here, wider than their declared type.
        columns = [F.lit(1).alias(c) if c == "category_id" else col for c, col in zip(declared, columns, strict=True)]
        write_extract(have.select(columns), f"{folder}/{name}.csv", "csv")


def _csv(t: Tables) -> str:
    folder = _folder(_spark(t))
    _spoilt_csv(t, folder)
    return folder


def _csv_tables(t: Tables) -> DataFrame:
    opened = open_tables(_spark(t), _csv(t), "csv", bad="skip")
    return _digests({name: opened(name) for name in opened.names()}, _CSV_KINDS)


query(
    "csv_tables",
    _OUT,
    _csv_tables,
    _digests_sql({n: f"SELECT * FROM {n} WHERE NOT ({rows})" for n, (_, rows, _) in _SPOILT.items()}, _CSV_KINDS),
)
query(
    "csv_rejects",
    "table_name:s reason:s rejected:i",
    lambda t: read_rejects(_spark(t), _csv(t))
    .select("table_name", F.explode("reasons").alias("reason"))
    .groupBy("table_name", "reason")
    .agg(F.count("*").alias("rejected")),
    "\nUNION ALL ".join(
        f"SELECT '{n}' AS table_name, '{c}: no {OPERATIONAL[n][c].dataType.simpleString()}' AS reason, COUNT(*) AS rejected "
        f"FROM {n} WHERE {rows} HAVING COUNT(*) > 0"
        for n, (c, rows, _) in _SPOILT.items()
    ),
)


def _inserted(t: Tables) -> DataFrame:
    """Purchase orders appended to a catalogue table in two parts, the columns of the second turned round."""
    spark = _spark(t)
    base = f"trips_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {base} LOCATION '{_folder(spark)}'")
    orders = t("purchase_orders")
    insert_into(orders.where("status = 'Delivered'"), f"{base}.orders", ["status"])
    insert_into(orders.where("status <> 'Delivered'").select(orders.columns[::-1]), f"{base}.orders", ["status"])
    return _digests({"purchase_orders": spark.table(f"{base}.orders")}, _TABLES)


query("insert_into", _OUT, _inserted, _digests_sql({"purchase_orders": "SELECT * FROM purchase_orders"}, _TABLES))


# ---- orders and lines side by side --------------------------------------------------------


def _bucketed(t: Tables) -> Tables:
    spark = _spark(t)
    base = f"side_{uuid.uuid4().hex}"
    needed = ("products", "product_categories", "customers", "warehouses", "sales_orders", "sales_order_items")
    few = Tables.of(**{name: t(name) for name in needed})
    save_bucketed(few, base, folder=_folder(spark))
    return open_bucketed(spark, base)


for _name in ("abc_summary", "sales_extract", "fill_rate_service"):
    query(
        f"{_name}_bucketed",
        " ".join(f"{c}:{k}" for c, k in REGISTRY[_name].columns.items()),
        lambda t, build=REGISTRY[_name].build: build(_bucketed(t)),
        REGISTRY[_name].sql,
    )

# ---- the whole star -----------------------------------------------------------------------

_STAR_TABLES = [
    "dim_product", "dim_supplier", "dim_customer", "dim_warehouse", "fact_sales", "fact_purchases",
    "fact_inventory_daily", "fact_stockouts", "agg_sales_monthly", "agg_supplier_performance",
]
_STAR_VIEWS = {
    "v_inventory_status": "inventory_status", "v_supplier_performance": "supplier_performance",
    "v_daily_sales": "daily_sales", "vw_sales_dashboard": "vw_sales_dashboard",
    "vw_inventory_health": "vw_inventory_health", "vw_supplier_scorecard": "vw_supplier_scorecard",
}


def _star_kinds(name: str) -> dict[str, str]:
    """Columns that do not depend on the day on which the versions begin."""
    dated = ("product_key", "supplier_key", "customer_key", "effective_date")
    return {c: k for c, k in REGISTRY[name].columns.items() if c not in dated}


_STAR = {n: n for n in _STAR_TABLES} | _STAR_VIEWS
_STAR_KINDS = {n: _star_kinds(q) for n, q in _STAR.items()}


def _sources(t: Tables, *facts: loads.FactLoad) -> Tables:
    """``t`` with the orders and lines of facts as tables side by side, as a shop has them.

    The mapping makes them by joins; a load reads them twice and an update four times, lines with their orders.
    """
    base, rows = f"sources_{uuid.uuid4().hex}", {}
    for load in facts:
        rows[load.lines] = t(load.lines, load.order_key, *load.line_columns)
        rows[load.orders] = t(load.orders, load.order_key, load.day, *load.order_columns)
    save_bucketed(Tables({}).replaced(**rows), base, buckets_for(t), _folder(_spark(t)))
    return t.overlaid(open_bucketed(_spark(t), base, rows))


def _loaded(t: Tables) -> DataFrame:
    spark = _spark(t)
    sources = _sources(t, loads.SALES, loads.PURCHASES)
    star = warehouse.build_star(t, _folder(spark), regions=REGIONS, sources=sources)
    warehouse.register_all_views(t, star)
    return _digests({**{n: star[n] for n in _STAR_TABLES}, **{v: spark.table(v) for v in _STAR_VIEWS}}, _STAR_KINDS)


query("build_star", _OUT, _loaded, _digests_sql({n: REGISTRY[q].sql for n, q in _STAR.items()}, _STAR_KINDS))


#: Stock rows that are missing before the dense form adds them.
_SPARSE = "product_id % 9 <> 4 OR warehouse_id % 2 = 0"
query(
    "fact_inventory_dense",
    "inventory_fact_key:s date_key:i product_key:i warehouse_key:i quantity_on_hand:i quantity_reserved:i "
    "quantity_available:i inventory_value:m is_stockout:b",
    lambda t: star_plan.fact_inventory_daily(
        t.replaced(inventory=t("inventory").where(_SPARSE)),
        star_plan.product_versions(t, sales_anchor(t)),
        star_plan.dim_warehouse(t, REGIONS),
        dense=True,
    ),
    f"""
    SELECT f.* REPLACE (IF({_SPARSE}, quantity_on_hand, 0) AS quantity_on_hand, IF({_SPARSE}, quantity_reserved, 0) AS quantity_reserved,
             IF({_SPARSE}, quantity_available, 0) AS quantity_available, IF({_SPARSE}, inventory_value, 0) AS inventory_value,
             IF({_SPARSE}, is_stockout, TRUE) AS is_stockout)
    FROM fact_inventory_daily f""",
)
