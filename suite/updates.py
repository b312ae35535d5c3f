"""Loads of changes: late deliveries, missing orders, versions out of order, stock of past days.

Each query loads the tables as they were known earlier, loads the present ones on top, and returns
what is stored then; its SQL computes that from the present tables alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.operators.ledger import inventory_ledger
from stocklens.operators.sales import sales_anchor
from stocklens.plans import loads, star, stock_history, versions, warehouse
from stocklens.sources.tables import Tables, write_extract
from suite.core import REGISTRY, SHARED, query
from suite.round_trips import _folder, _sources, _spark
from suite.star import REGIONS, _products


def _between(t: Tables, column: str, most: int, least: int) -> Column:
    """True from ``most`` to ``least`` days before the last order."""
    today = sales_anchor(t)
    return F.coalesce(F.col(column).between(F.date_sub(today, most), F.date_sub(today, least)), F.lit(False))


def _present(t: Tables) -> Tables:
    """The tables now: the orders of some weeks are gone, their lines are not."""
    return t.replaced(sales_orders=t("sales_orders").where(~_between(t, "order_date", 380, 366)))


def _earlier(t: Tables) -> Tables:
    """The tables as known before: dates to come in, orders not entered yet, open stockouts."""
    late = lambda c, most, least: F.when(~_between(t, c, most, least), F.col(c)).alias(c)
    orders, bought, out = t("sales_orders"), t("purchase_orders"), t("stockout_events")
    return t.replaced(
        sales_orders=orders.where(~_between(t, "order_date", 10, 0)).withColumn(
            "actual_ship_date", late("actual_ship_date", 500, 460)
        ),
        purchase_orders=bought.withColumn("actual_delivery_date", late("actual_delivery_date", 420, 300)),
        stockout_events=out.withColumn(
            "stockout_end_date", F.when(F.col("stockout_id") % 4 != 1, F.col("stockout_end_date"))
        ),
    )


def _updated(t: Tables, load: loads.FactLoad, build) -> tuple[str, set[loads.Month]]:
    folder = _folder(_spark(t))
    if load.orders is not None:
        t = _sources(t, load)
    loads.load_fact(_earlier(t), folder, load, build)
    return folder, loads.update_fact(_present(t), folder, load, build)


def _stored(t: Tables, folder: str, load: loads.FactLoad) -> DataFrame:
    return _spark(t).read.parquet(f"{folder}/{load.name}")


def _sales(t: Tables):
    keys = _products(t), star.customer_versions(t, sales_anchor(t)), star.dim_warehouse(t, REGIONS)
    return lambda now: star.fact_sales(now, *keys)


def _purchases(t: Tables):
    keys = _products(t), star.supplier_versions(t, sales_anchor(t)), star.dim_warehouse(t, REGIONS)
    return lambda now: star.fact_purchases(now, *keys)


def _columns(name: str) -> str:
    return " ".join(f"{c}:{k}" for c, k in REGISTRY[name].columns.items())


# Lines whose order is gone have no date and no customer or site.
_KEPT = "order_date < d - 380 OR order_date > d - 366"
SHARED["present_sales"] = f"""
    SELECT f.* REPLACE (IF(kept, f.date_key, NULL) AS date_key, IF(kept, f.customer_key, -1) AS customer_key,
             IF(kept, f.warehouse_key, -1) AS warehouse_key,
             IF(kept, f.sales_order_number, NULL) AS sales_order_number,
             IF(kept, f.days_to_ship, NULL) AS days_to_ship, IF(kept, f.is_on_time, NULL) AS is_on_time)
    FROM (SELECT s.*, {_KEPT.replace("order_date", "strptime(CAST(date_key AS VARCHAR), '%Y%m%d')")} AS kept
          FROM fact_sales s, anchor) f"""
query(
    "update_fact_sales",
    _columns("fact_sales"),
    lambda t: _stored(t, _updated(t, loads.SALES, _sales(t))[0], loads.SALES),
    "SELECT * FROM present_sales",
)
query(
    "update_fact_purchases",
    _columns("fact_purchases"),
    lambda t: _stored(t, _updated(t, loads.PURCHASES, _purchases(t))[0], loads.PURCHASES),
    "SELECT * FROM fact_purchases",
)
query(
    "update_fact_stockouts",
    _columns("fact_stockouts"),
    lambda t: _stored(
        t,
        _updated(t, loads.STOCKOUTS, lambda now: star.fact_stockouts(now, _products(t), star.dim_warehouse(t, REGIONS)))[0],
        loads.STOCKOUTS,
    ),
    REGISTRY["fact_stockouts"].sql,
)


def _aggregated(t: Tables) -> str:
    """A folder with both facts and their aggregates, loaded earlier and updated."""
    spark, folder = _spark(t), _folder(_spark(t))
    t = _sources(t, loads.SALES, loads.PURCHASES)
    before, now = _earlier(t), _present(t)
    sales = loads.load_fact(before, folder, loads.SALES, _sales(t))
    bought = loads.load_fact(before, folder, loads.PURCHASES, _purchases(t))
    warehouse.save_aggregates(folder, sales, bought)
    sold = loads.update_fact(now, folder, loads.SALES, _sales(t))
    warehouse.update_aggregates(spark, folder, sold, loads.update_fact(now, folder, loads.PURCHASES, _purchases(t)))
    return folder


def _from_present(name: str) -> str:
    """A query's SQL over the present sales."""
    return REGISTRY[name].sql.replace("fact_sales", "present_sales")


query(
    "update_agg_sales_monthly",
    _columns("agg_sales_monthly"),
    lambda t: warehouse.read_star_table(_spark(t), _aggregated(t), "agg_sales_monthly"),
    _from_present("agg_sales_monthly"),
)
query(
    "update_agg_supplier_performance",
    _columns("agg_supplier_performance"),
    lambda t: warehouse.read_star_table(_spark(t), _aggregated(t), "agg_supplier_performance"),
    REGISTRY["agg_supplier_performance"].sql,
)


def _updated_classes(t: Tables) -> DataFrame:
    folder = _aggregated(t)
    monthly = warehouse.read_star_table(_spark(t), folder, "agg_sales_monthly")
    return star.refresh_abc_from_months(monthly, _stored(t, folder, loads.SALES), sales_anchor(t))


query("update_refresh_abc", _columns("refresh_abc"), _updated_classes, _from_present("refresh_abc"))


# ---- versions in any order --------------------------------------------------------------

#: Days back and what the lead time is from then on, in the order in which the changes come in.
_CHANGES = [(400, "lead_time_days + 2", 2), (1000, "lead_time_days + 1", 3), (100, "lead_time_days", 4), (700, "lead_time_days + 1", 1)]


def _out_of_order(t: Tables) -> DataFrame:
    """Every change for the products whose id its last number divides, one after the other."""
    today = sales_anchor(t)
    rows = t("products", "product_id", "sku", "lead_time_days")
    dim = versions.first_versions(rows, "product_id", F.date_sub(today, 2000))
    for back, value, step in _CHANGES:
        change = rows.where(F.col("product_id") % step == 0).select(
            "product_id", F.expr(value).cast("int").alias("lead_time_days"), F.date_sub(today, back).alias("effective_date")
        )
        dim = versions.scd2_apply(dim, change, "product_id", ["lead_time_days"])
    return dim


query(
    "scd2_out_of_order",
    "product_key:i product_id:i sku:s lead_time_days:i effective_date:d expiration_date:d is_current:b",
    _out_of_order,
    "WITH seen AS (SELECT product_id, sku, lead_time_days, d - 2000 AS since FROM products, anchor "
    + " ".join(
        f"UNION ALL SELECT product_id, sku, {value}, d - {back} FROM products, anchor WHERE product_id % {step} = 0"
        for back, value, step in _CHANGES
    )
    + """)
    SELECT product_id * 100000 + (since - DATE '1970-01-01') AS product_key, product_id, sku, lead_time_days,
           since AS effective_date, (SELECT min(o.since) FROM seen o WHERE o.product_id = s.product_id AND o.since > s.since)
             AS expiration_date,
           NOT EXISTS (SELECT 1 FROM seen o WHERE o.product_id = s.product_id AND o.since > s.since) AS is_current
    FROM seen s""",
)

# ---- stock of past days -----------------------------------------------------------------

_DAYS_BACK = [1, 45, 400]


def _past_stock(t: Tables) -> DataFrame:
    spark, today, folder = _spark(t), sales_anchor(t), _folder(_spark(t))
    path = f"{folder}/stock_history"
    # The movements are a table of the shop; the mapping makes them of lines, and they are read twice.
    movements = inventory_ledger(t).select("warehouse_id", "product_id", "quantity", "transaction_date")
    stored = spark.read.schema(movements.schema).parquet(write_extract(movements, f"{folder}/inventory_transactions"))
    stock_history.save_history(stock_history.stock_intervals(t.replaced(inventory_transactions=stored)), path)
    return stock_history.stock_on(spark.read.parquet(path), [F.date_sub(today, k) for k in _DAYS_BACK])


query(
    "stock_history",
    "day:d warehouse_id:i product_id:i quantity_on_hand:i",
    _past_stock,
    f"""
    WITH pair AS (
      SELECT warehouse_id, product_id FROM inventory
      UNION SELECT warehouse_id, product_id FROM ledger_rows, anchor WHERE transaction_date <= d),
    asked AS (SELECT CAST(d - unnest({_DAYS_BACK}) AS DATE) AS day, d FROM anchor)
    SELECT day, p.warehouse_id, p.product_id,
           COALESCE(any_value(quantity_on_hand), 0) - COALESCE(SUM(quantity) FILTER (transaction_date > day), 0)
             AS quantity_on_hand
    FROM pair p CROSS JOIN asked
    LEFT JOIN inventory i ON i.warehouse_id = p.warehouse_id AND i.product_id = p.product_id
    LEFT JOIN ledger_rows l
      ON l.warehouse_id = p.warehouse_id AND l.product_id = p.product_id AND l.transaction_date <= asked.d
    GROUP BY day, p.warehouse_id, p.product_id""",
)
