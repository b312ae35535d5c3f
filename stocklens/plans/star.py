"""Star schema: dimensions, facts, aggregates, views and refresh jobs.

Every surrogate key is a function of the row's own business key, so a load numbers its rows
without a global ordering and a rerun gives the same keys.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stocklens.functions.expr import (
    DateLike,
    date_key,
    days_between,
    label_up_to,
    money,
    pct,
    ratio,
    round_int,
    round_to,
    tier,
    whole_days,
)
from stocklens.functions.running import running_totals
from stocklens.operators.abc import abc_extract
from stocklens.operators.sales import sales_anchor
from stocklens.operators.suppliers import TIERS, supplier_scores
from stocklens.plans.extracts import daily_demand_rate, inventory_measures, stock_health, with_line_amounts
from stocklens.plans.versions import first_versions, key_name
from stocklens.sources.tables import Tables, freed_shuffles, kept

# Performance labels share the tier bounds.
PERFORMANCE = ["Excellent", "Good", "Fair"]
# The key of members that a dimension does not have.
UNKNOWN = -1


def _key_date(key: str | Column) -> Column:
    c = F.col(key) if isinstance(key, str) else key
    return F.to_date(c.cast("string"), "yyyyMMdd")


# ---- dimensions -----------------------------------------------------------------------


def dim_date(span: DataFrame) -> DataFrame:
    """Calendar of a one-row frame (start, end), both days included."""
    d = F.col("full_date")
    sunday_first = F.dayofweek(d) - 1
    return span.select(F.explode(F.sequence("start", "end")).alias("full_date")).select(
        date_key(d).alias("date_key"),
        "full_date",
        sunday_first.alias("day_of_week"),
        F.date_format(d, "EEE").alias("day_name"),
        F.dayofmonth(d).alias("day_of_month"),
        F.dayofyear(d).alias("day_of_year"),
        F.weekofyear(d).alias("week_of_year"),
        F.month(d).alias("month_num"),
        F.date_format(d, "MMM").alias("month_name"),
        F.quarter(d).alias("quarter"),
        F.year(d).alias("year"),
        sunday_first.isin(0, 6).alias("is_weekend"),
        F.lit(False).alias("is_holiday"),
        F.quarter(d).alias("fiscal_quarter"),
        F.year(d).alias("fiscal_year"),
    )


def build_dim_date(spark: SparkSession, start: DateLike, end: DateLike) -> DataFrame:
    day = lambda x: F.lit(str(x)).cast("date")
    return dim_date(spark.range(1).select(day(start).alias("start"), day(end).alias("end")))


def order_calendar(t: Tables) -> DataFrame:
    """The calendar from the first to the last sales order."""
    span = t("sales_orders", "order_date").agg(F.min("order_date").alias("start"), F.max("order_date").alias("end"))
    return dim_date(span)


def product_versions(t: Tables, effective: Column) -> DataFrame:
    """Product ids with their current key: all that a fact load needs."""
    return first_versions(t("products", "product_id"), "product_id", effective)


def customer_versions(t: Tables, effective: Column) -> DataFrame:
    return first_versions(t("customers", "customer_id"), "customer_id", effective)


def supplier_versions(t: Tables, effective: Column) -> DataFrame:
    return first_versions(t("suppliers", "supplier_id"), "supplier_id", effective)


def dim_product(t: Tables, effective: Column) -> DataFrame:
    """Products with margin, ABC class and stock policy.

    The reorder point is the sum over warehouses; safety stock covers the planned safety
    days at the product's mean daily demand.
    """
    policy = (
        t("inventory", "product_id", "reorder_point")
        .groupBy("product_id")
        .agg(F.sum("reorder_point").cast("int").alias("reorder_point"))
    )
    price, cost = F.col("unit_price"), F.col("unit_cost")
    rows = (
        t(
            "products", "product_id", "sku", "product_name", "category_id", "unit_cost", "unit_price",
            "lead_time_days", "safety_stock_days", "is_active",
        )
        .join(t("product_categories", "category_id", "category_name"), "category_id", "left")
        .join(abc_extract(t).select("product_id", "abc_class"), "product_id", "left")
        .join(policy, "product_id", "left")
        .join(daily_demand_rate(t), "product_id", "left")
        .select(
            "product_id",
            "sku",
            "product_name",
            "category_id",
            "category_name",
            "unit_cost",
            "unit_price",
            round_to(pct(price - cost, price), 2).cast("decimal(14,2)").alias("profit_margin"),
            "abc_class",
            "lead_time_days",
            "reorder_point",
            round_int(F.col("avg_daily_demand") * F.col("safety_stock_days")).cast("int").alias("safety_stock"),
            "is_active",
        )
    )
    return first_versions(rows, "product_id", effective)


def dim_supplier(t: Tables, effective: Column, lookback_days: int = 365) -> DataFrame:
    """Suppliers with the score and tier of their recent deliveries, if any."""
    scores = supplier_scores(t, lookback_days).select("supplier_code", "reliability_score", "tier")
    rows = (
        t(
            "suppliers", "supplier_id", "supplier_code", "supplier_name", "city", "state", "country",
            "payment_terms_days", "quality_rating", "is_preferred", "is_active",
        )
        .join(scores, "supplier_code", "left")
        .select(
            "supplier_id", "supplier_code", "supplier_name", "city", "state", "country",
            "payment_terms_days", "quality_rating",
            F.col("reliability_score").cast("decimal(9,2)").alias("reliability_score"),
            F.col("tier").alias("reliability_tier"),
            "is_preferred", "is_active",
        )
    )
    return first_versions(rows, "supplier_id", effective)


def dim_customer(t: Tables, effective: Column) -> DataFrame:
    rows = t(
        "customers", "customer_id", "customer_code", "customer_name", "customer_type", "city", "state",
        "country", "credit_limit", "is_active",
    )
    return first_versions(rows, "customer_id", effective)


def dim_warehouse(t: Tables, regions: Mapping[str, str] | None = None) -> DataFrame:
    """Warehouses; the sources have no region, so it comes from a state-to-region mapping."""
    region = F.lit(None).cast("string")
    if regions:
        pairs = F.create_map(*[F.lit(x) for pair in regions.items() for x in pair])
        region = F.try_element_at(pairs, F.col("state"))
    return t(
        "warehouses", "warehouse_id", "warehouse_code", "warehouse_name", "city", "state", "latitude",
        "longitude", "capacity_units", "operating_cost_per_unit", "is_active",
    ).select(
        F.col("warehouse_id").cast("bigint").alias("warehouse_key"),
        "warehouse_id",
        "warehouse_code",
        "warehouse_name",
        "city",
        "state",
        region.alias("region"),
        F.col("latitude").cast("decimal(10,6)").alias("latitude"),
        F.col("longitude").cast("decimal(10,6)").alias("longitude"),
        "capacity_units",
        "operating_cost_per_unit",
        "is_active",
    )


# ---- facts ----------------------------------------------------------------------------


def _with_key(rows: DataFrame, dim: DataFrame, business_key: str, day: str) -> DataFrame:
    """``rows`` with the key of the version valid on ``day``, UNKNOWN where there is none.

    Days before a member's first version belong to that version; a row without a day gets the
    current one. Dimensions without versions are looked up by their business key alone.
    """
    key = key_name(business_key)
    keys = dim.select(F.col(business_key).alias("_member"), F.col(key).alias("_key"), *_validity(dim))
    match = F.col(business_key) == F.col("_member")
    if "effective_date" in dim.columns:
        # As each member's first version has no start, exactly one version fits any day.
        first = F.row_number().over(W.partitionBy("_member").orderBy("_from")) == 1
        keys = keys.withColumn("_from", F.when(~first, F.col("_from")))
        on = F.col(day).cast("date")
        began = F.col("_from").isNull() | (on >= F.col("_from"))
        match &= F.when(on.isNull(), F.col("_to").isNull()).otherwise(
            began & (F.col("_to").isNull() | (on < F.col("_to")))
        )
    found = rows.join(keys, match, "left").withColumn(key, F.coalesce("_key", F.lit(UNKNOWN)).cast("bigint"))
    return found.drop("_member", "_key", "_from", "_to")


def _validity(dim: DataFrame) -> list[Column]:
    if "effective_date" not in dim.columns:
        return []
    return [F.col("effective_date").alias("_from"), F.col("expiration_date").alias("_to")]


def _with_versions(rows: DataFrame, dim: DataFrame, business_key: str) -> DataFrame:
    """``rows`` with the versions of their member, of which :func:`_key_on` takes those of a day.

    So rows that do not have their day yet need not move to their members a second time. A member
    with a single version that is open has just its key, and no list moves with its rows.
    """
    version = F.struct(
        F.col("effective_date").alias("start"), F.col("expiration_date").alias("end"), F.col(key_name(business_key)).alias("key")
    )
    known = dim.groupBy(F.col(business_key).alias("_member")).agg(F.sort_array(F.collect_list(version)).alias("_all"))
    single = (F.size("_all") == 1) & F.col("_all")[0]["end"].isNull()
    # As each member's first version has no start, exactly one version fits any day.
    opened = F.transform("_all", lambda v, i: v.withField("start", F.when(i > 0, v["start"])))
    known = known.select(
        "_member", F.when(single, F.col("_all")[0]["key"]).alias("_only"), F.when(~single, opened).alias("_versions")
    )
    return rows.join(known, F.col(business_key) == F.col("_member"), "left").drop("_member")


def _key_on(rows: DataFrame, business_key: str, day: str) -> DataFrame:
    """``rows`` of :func:`_with_versions` with the keys that :func:`_with_key` would give them."""
    key, on = key_name(business_key), F.col(day).cast("date")

    def fits(v: Column) -> Column:
        held = (v["start"].isNull() | (on >= v["start"])) & (v["end"].isNull() | (on < v["end"]))
        return F.when(on.isNull(), v["end"].isNull()).otherwise(held)

    valid = F.transform(F.filter("_versions", fits), lambda v: v["key"])
    keys = F.when(F.col("_only").isNotNull(), F.array("_only")).otherwise(valid)
    found = rows.withColumn(key, F.explode_outer(keys)).withColumn(key, F.coalesce(key, F.lit(UNKNOWN)).cast("bigint"))
    return found.drop("_only", "_versions")


def _numbered(lines: DataFrame, order: str, item: str) -> DataFrame:
    """Line numbers 1..k within each order, by the source's line number, then the item id.

    A source's own line numbers need not be unique. The window holds one order's lines.
    """
    first = ["line_number"] if "line_number" in lines.columns else []
    number = F.row_number().over(W.partitionBy(order).orderBy(*first, item))
    return lines.withColumn("line_item_number", number).drop(*first)


def _with_line_number(t: Tables, name: str, *columns: str) -> DataFrame:
    extra = [c for c in ("line_number",) if c in t.columns(name)]
    return t(name, *columns, *extra)


def fact_sales(t: Tables, products: DataFrame, customers: DataFrame, warehouses: DataFrame) -> DataFrame:
    """One row per sales order line, keyed to the versions valid on the order's date.

    No line is lost: unknown members have the key UNKNOWN, a line without its order no date.
    """
    items = _numbered(
        _with_line_number(
            t, "sales_order_items", "so_item_id", "so_id", "product_id", "quantity_ordered",
            "quantity_shipped", "unit_price", "discount_percent",
        ),
        "so_id",
        "so_item_id",
    )
    # Customers and sites are looked up on orders, far fewer than the lines.
    orders = t(
        "sales_orders", "so_id", "so_number", "customer_id", "warehouse_id", "order_date",
        "requested_delivery_date", "actual_ship_date",
    )
    orders = _with_key(orders, customers, "customer_id", "order_date")
    orders = _with_key(orders, warehouses, "warehouse_id", "order_date")
    lines = items.join(orders, "so_id", "left").join(t("products", "product_id", "unit_cost"), "product_id", "left")
    lines = _with_key(lines, products, "product_id", "order_date")
    amounts = ["gross_amount", "discount_amount", "net_amount", "cost_amount", "profit_amount"]
    unknown = F.lit(UNKNOWN).cast("bigint")
    return with_line_amounts(lines).select(
        F.col("so_item_id").cast("string").alias("sales_fact_key"),
        date_key("order_date").alias("date_key"),
        "product_key",
        F.coalesce("customer_key", unknown).alias("customer_key"),
        F.coalesce("warehouse_key", unknown).alias("warehouse_key"),
        F.col("so_number").alias("sales_order_number"),
        "line_item_number",
        "quantity_ordered",
        "quantity_shipped",
        "unit_price",
        "discount_percent",
        *[money(a).cast("decimal(18,2)").alias(a) for a in amounts],
        days_between("actual_ship_date", "order_date").alias("days_to_ship"),
        (F.col("actual_ship_date") <= F.col("requested_delivery_date")).alias("is_on_time"),
    )


def dense_inventory(t: Tables) -> Tables:
    """Tables whose inventory has a row, zero if need be, for every product and warehouse.

    That table is products x warehouses by definition. The warehouses are few: they number from
    one and each product is spread over those numbers.
    """
    sites = t("warehouses", "warehouse_id")
    numbered = sites.withColumn("_n", F.row_number().over(W.orderBy("warehouse_id")))
    last = sites.agg(F.count("*")).scalar().cast("int")
    spine = (
        t("products", "product_id")
        .withColumn("_n", F.explode(F.sequence(F.lit(1), last)))
        .join(numbered, "_n")
        .drop("_n")
    )
    stock = t("inventory")
    counts = ["quantity_on_hand", "quantity_reserved", "quantity_available"]
    full = spine.join(stock, ["warehouse_id", "product_id"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in counts}
    )
    return t.replaced(inventory=full)


def fact_inventory_daily(
    t: Tables, products: DataFrame, warehouses: DataFrame, as_of: DateLike = None, dense: bool = False
) -> DataFrame:
    """Stock snapshot of one day per product and warehouse."""
    source = dense_inventory(t) if dense else t
    key = date_key("snapshot_date")
    rows = inventory_measures(source).withColumn("snapshot_date", sales_anchor(t, as_of))
    rows = _with_key(rows, products, "product_id", "snapshot_date")
    return (
        _with_key(rows, warehouses, "warehouse_id", "snapshot_date")
        .select(
            F.concat_ws("-", key, "warehouse_id", "product_id").alias("inventory_fact_key"),
            key.alias("date_key"),
            "product_key",
            "warehouse_key",
            "quantity_on_hand",
            "quantity_reserved",
            "quantity_available",
            "reorder_point",
            F.col("inventory_value").cast("decimal(24,2)").alias("inventory_value"),
            F.col("days_of_supply").cast("decimal(24,2)").alias("days_of_supply"),
            "is_below_reorder",
            "is_stockout",
            "is_overstock",
        )
    )


def fact_purchases(
    t: Tables, products: DataFrame, suppliers: DataFrame, warehouses: DataFrame, folder: str | None = None
) -> DataFrame:
    """One row per purchase order line; delivery figures are NULL until delivered.

    Lines meet their products first and then their orders, which give them their day; lines that
    are stored by their order are numbered and dated there, and then move to their products. With a
    ``folder``, lines with their products and orders with their keys are written there before they meet.
    """
    items = _with_line_number(
        t, "purchase_order_items", "po_item_id", "po_id", "product_id", "quantity_ordered",
        "quantity_received", "unit_cost", "line_total",
    )
    products_first = "effective_date" in products.columns and t.stored_by("purchase_order_items") != "po_id"
    if products_first:
        items = _with_versions(items, products, "product_id")
        if folder is not None:
            items = kept(items, f"{folder}/lines")
    items = _numbered(items, "po_id", "po_item_id")
    orders = t(
        "purchase_orders", "po_id", "po_number", "supplier_id", "warehouse_id", "order_date",
        "expected_delivery_date", "actual_delivery_date",
    )
    orders = _with_key(orders, suppliers, "supplier_id", "order_date")
    orders = _with_key(orders, warehouses, "warehouse_id", "order_date")
    if folder is not None:
        orders = kept(orders, f"{folder}/orders")
    actual, expected = F.col("actual_delivery_date"), F.col("expected_delivery_date")
    unknown = F.lit(UNKNOWN).cast("bigint")
    lines = items.join(orders, "po_id", "left")
    if products_first:
        lines = _key_on(lines, "product_id", "order_date")
    else:
        lines = _with_key(lines, products, "product_id", "order_date")
    return (
        lines.select(
            F.col("po_item_id").cast("string").alias("purchase_fact_key"),
            date_key("order_date").alias("order_date_key"),
            date_key(actual).alias("delivery_date_key"),
            "product_key",
            F.coalesce("supplier_key", unknown).alias("supplier_key"),
            F.coalesce("warehouse_key", unknown).alias("warehouse_key"),
            F.col("po_number").alias("purchase_order_number"),
            "line_item_number",
            "quantity_ordered",
            "quantity_received",
            "unit_cost",
            F.col("line_total").cast("decimal(18,2)").alias("total_cost"),
            days_between(expected, "order_date").alias("expected_lead_days"),
            days_between(actual, "order_date").alias("actual_lead_days"),
            days_between(actual, expected).alias("lead_time_variance"),
            (actual <= expected).alias("is_on_time"),
            (F.col("quantity_received") >= F.col("quantity_ordered")).alias("is_complete"),
        )
    )


def fact_stockouts(t: Tables, products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """One row per stockout event; open events have no end and no duration."""
    events = t(
        "stockout_events", "stockout_id", "warehouse_id", "product_id", "stockout_start_date",
        "stockout_end_date", "demand_during_stockout", "lost_sales_amount", "root_cause",
    )
    events = _with_key(events, products, "product_id", "stockout_start_date")
    return (
        _with_key(events, warehouses, "warehouse_id", "stockout_start_date")
        .select(
            F.col("stockout_id").cast("bigint").alias("stockout_fact_key"),
            date_key("stockout_start_date").alias("start_date_key"),
            date_key("stockout_end_date").alias("end_date_key"),
            "product_key",
            "warehouse_key",
            whole_days("stockout_end_date", "stockout_start_date").cast("int").alias("duration_days"),
            F.col("demand_during_stockout").alias("estimated_lost_units"),
            F.col("lost_sales_amount").alias("estimated_lost_revenue"),
            "root_cause",
        )
    )


# ---- aggregates -----------------------------------------------------------------------


def agg_sales_monthly(sales: DataFrame) -> DataFrame:
    """Sales per month, product and warehouse; orders counted after folding to one row each.

    Lines without an order are a part of the sums and of no order.
    """
    year = F.floor(F.col("date_key") / 10000).cast("int")
    month = (F.floor(F.col("date_key") / 100) % 100).cast("int")
    grain = ["year", "month", "product_key", "warehouse_key"]
    sums = ["quantity_ordered", "gross_amount", "net_amount", "cost_amount", "profit_amount"]
    net, orders = F.sum("net_amount"), F.count("sales_order_number")
    # Lines move once, by the grain and as they are: what is folded by order is then counted where it
    # lies. Folded before it moves, a line is a row with wider sums, and moves twice.
    return (
        sales.withColumns({"year": year, "month": month})
        .select(*grain, "sales_order_number", *sums)
        .repartition(*grain)
        .groupBy(*grain, "sales_order_number")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .groupBy(*grain)
        .agg(
            orders.alias("total_orders"),
            F.sum("quantity_ordered").alias("total_quantity"),
            F.sum("gross_amount").cast("decimal(24,2)").alias("gross_revenue"),
            net.cast("decimal(24,2)").alias("net_revenue"),
            F.sum("cost_amount").cast("decimal(24,2)").alias("total_cost"),
            F.sum("profit_amount").cast("decimal(24,2)").alias("total_profit"),
            round_to(ratio(net, orders), 2).cast("decimal(24,2)").alias("avg_order_value"),
        )
    )


def supplier_months(purchases: DataFrame) -> DataFrame:
    """Sums per supplier and month of the order date, deliveries counted per order.

    Rows of several months add up: counts, sums, and sums of squares of whole days.
    """
    day = _key_date("order_date_key")
    grain = ["year", "month", "supplier_key"]
    figures = ["quantity_ordered", "quantity_received", "total_cost", "is_on_time", "actual_lead_days"]
    # Lines move once, as in agg_sales_monthly.
    per_order = (
        purchases.withColumns({"year": F.year(day), "month": F.month(day)})
        .select(*grain, "purchase_order_number", *figures)
        .repartition(*grain)
        .groupBy(*grain, "purchase_order_number")
        .agg(
            F.sum("quantity_ordered").alias("ordered"),
            F.sum("quantity_received").alias("received"),
            F.sum("total_cost").alias("spend"),
            F.bool_and("is_on_time").alias("on_time"),
            F.max("actual_lead_days").cast("bigint").alias("lead"),
        )
    )
    return per_order.groupBy(*grain).agg(
        F.count("*").alias("orders"),
        F.sum("ordered").alias("ordered"),
        F.sum("received").alias("received"),
        F.sum("spend").alias("spend"),
        F.count_if("on_time").alias("on_time"),
        F.count_if(~F.col("on_time")).alias("late"),
        F.count("lead").alias("delivered"),
        F.sum("lead").alias("lead"),
        F.sum((F.col("lead") * F.col("lead")).cast("decimal(20,0)")).alias("lead_squares"),
    )


def supplier_quarters(months: DataFrame) -> DataFrame:
    """Supplier figures per quarter from the sums of its months."""
    sums = ["orders", "ordered", "received", "spend", "on_time", "late", "delivered", "lead", "lead_squares"]
    added = (
        months.withColumn("quarter", F.ceil(F.col("month") / 3).cast("int"))
        .groupBy("year", "quarter", "supplier_key")
        .agg(*[F.sum(c).alias(c) for c in sums])
    )
    n, total = F.col("delivered"), F.col("lead").cast("decimal(18,0)")
    spread = (F.col("lead_squares").cast("decimal(24,0)") * n.cast("decimal(12,0)") - total * total).cast("double")
    deviation = F.when(n > 1, F.sqrt(spread / (n.cast("double") * (n - 1))))
    return added.select(
        "year",
        "quarter",
        "supplier_key",
        F.col("orders").alias("total_orders"),
        F.col("ordered").alias("total_units_ordered"),
        F.col("received").alias("total_units_received"),
        F.col("spend").cast("decimal(24,2)").alias("total_spend"),
        F.col("on_time").alias("on_time_deliveries"),
        F.col("late").alias("late_deliveries"),
        round_to(pct("on_time", F.col("on_time") + F.col("late")), 2).cast("decimal(14,2)").alias("on_time_rate"),
        round_to(pct("received", "ordered"), 2).cast("decimal(14,2)").alias("fill_rate"),
        round_to(ratio("lead", "delivered"), 2).cast("decimal(14,2)").alias("avg_lead_time"),
        round_to(deviation, 2).cast("decimal(14,2)").alias("lead_time_std_dev"),
    )


def agg_supplier_performance(purchases: DataFrame) -> DataFrame:
    """Supplier figures per quarter of the order date; deliveries counted per order."""
    return supplier_quarters(supplier_months(purchases))


def _analysis_day(sales: DataFrame, as_of: DateLike | Column) -> Column:
    if isinstance(as_of, Column):
        return as_of
    if as_of is None:
        return sales.agg(_key_date(F.max("date_key"))).scalar()
    return F.lit(str(as_of)).cast("date")


def _abc_of(revenue: DataFrame, today: Column) -> DataFrame:
    """ABC classes of (product_key, total_revenue)."""
    ranked = running_totals(revenue, "total_revenue", "product_key", ties="share", position=True)
    share = ratio("running", "grand_total")
    return ranked.select(
        today.alias("analysis_date"),
        "product_key",
        F.col("total_revenue").cast("decimal(24,2)").alias("total_revenue"),
        F.col("position").alias("revenue_rank"),
        F.col("running").cast("decimal(24,2)").alias("cumulative_revenue"),
        round_to(share * 100, 2).cast("decimal(14,2)").alias("cumulative_pct"),
        label_up_to(share, [(0.80, "A"), (0.95, "B")], "C").alias("abc_class"),
    )


def refresh_abc(sales: DataFrame, as_of: DateLike | Column = None) -> DataFrame:
    """ABC classes of a year's net sales for one analysis date, the fact's last day if not given.

    A fact in monthly folders is read from the folder of the first day on.
    """
    today = _analysis_day(sales, as_of)
    first = F.add_months(today, -12)
    year = F.col("date_key") >= date_key(first)
    if "month_key" in sales.columns:
        year &= F.col("month_key") >= F.year(first) * 100 + F.month(first)
    revenue = sales.filter(year).groupBy("product_key").agg(F.sum("net_amount").alias("total_revenue"))
    return _abc_of(revenue, today)


def refresh_abc_from_months(monthly: DataFrame, sales: DataFrame, as_of: DateLike | Column = None) -> DataFrame:
    """The same classes from the monthly sales: of the lines only the first month's are read."""
    today = _analysis_day(sales, as_of)
    first = F.add_months(today, -12)
    begin = F.year(first) * 100 + F.month(first)
    whole = monthly.filter(F.col("year") * 100 + F.col("month") > begin)
    whole = whole.filter(F.col("year") >= F.year(first)).select("product_key", F.col("net_revenue").alias("net_amount"))
    part = sales.filter((F.col("month_key") == begin) & (F.col("date_key") >= date_key(first)))
    both = part.select("product_key", "net_amount").unionByName(whole)
    return _abc_of(both.groupBy("product_key").agg(F.sum("net_amount").alias("total_revenue")), today)


def save_by_partition(df: DataFrame, path: str, *partition: str) -> None:
    """Write so that a rerun replaces its own partitions instead of appending to them."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition)
    with freed_shuffles(df.sparkSession):
        writer.parquet(path)


def save_fact(df: DataFrame, path: str, key: str, *cluster: str, whole: bool = False) -> None:
    """Write a fact in monthly folders, clustered by its date key and ``cluster``.

    Only the months in ``df`` are replaced, or with ``whole`` the entire fact.

    Rows are range-partitioned on the whole clustering key, so a busy month or a hot product
    spreads over several files, each covering a narrow key range for scans to skip by.
    """
    order = [key, *cluster]
    writer = (
        df.repartitionByRange(*order)
        .withColumn("month_key", F.floor(F.col(key) / 100).cast("int"))
        .sortWithinPartitions("month_key", *order)
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "static" if whole else "dynamic")
        .partitionBy("month_key")
    )
    with freed_shuffles(df.sparkSession):
        writer.parquet(path)


# ---- views and comparison queries -----------------------------------------------------


def _current(dim: DataFrame) -> DataFrame:
    return dim.filter("is_current")


def vw_sales_dashboard(
    sales: DataFrame, dates: DataFrame, products: DataFrame, customers: DataFrame, warehouses: DataFrame
) -> DataFrame:
    p = _current(products).select("product_key", "sku", "product_name", "category_name", "abc_class")
    c = _current(customers).select(
        "customer_key", "customer_name", "customer_type", F.col("state").alias("customer_state")
    )
    return (
        sales.join(p, "product_key")
        .join(c, "customer_key")
        # The calendar and the sites are few, and their texts need not move with the lines.
        .join(dates, "date_key")
        .join(warehouses.select("warehouse_key", "warehouse_name", "region"), "warehouse_key")
        .select(
            "full_date", "year", "quarter", "month_name", "week_of_year", "day_name", "is_weekend",
            "sku", "product_name", "category_name", "abc_class", "customer_name", "customer_type",
            "customer_state", "warehouse_name", "region", "quantity_ordered", "quantity_shipped",
            "net_amount", "profit_amount", "is_on_time",
        )
    )


def vw_inventory_health(
    stock: DataFrame, dates: DataFrame, products: DataFrame, warehouses: DataFrame
) -> DataFrame:
    p = _current(products).select("product_key", "sku", "product_name", "category_name", "abc_class")
    over = F.col("days_of_supply") > 90
    return (
        stock.join(dates.select("date_key", "full_date", "year", "month_name"), "date_key")
        .join(p, "product_key")
        .join(warehouses.select("warehouse_key", "warehouse_name", "region"), "warehouse_key")
        .select(
            "full_date", "year", "month_name", "sku", "product_name", "category_name", "abc_class",
            "warehouse_name", "region", "quantity_on_hand", "quantity_available", "reorder_point",
            "inventory_value", "days_of_supply", "is_below_reorder", "is_stockout",
            stock_health(F.col("is_stockout"), F.col("is_below_reorder"), over).alias("inventory_status"),
        )
    )


def vw_supplier_scorecard(performance: DataFrame, suppliers: DataFrame) -> DataFrame:
    s = _current(suppliers).select(
        "supplier_key", "supplier_name", "reliability_tier", "quality_rating", "is_preferred"
    )
    steps = [(a, b, label) for (a, b, _tier), label in zip(TIERS, PERFORMANCE, strict=True)]
    return performance.join(s, "supplier_key").select(
        "supplier_name", "reliability_tier", "quality_rating", "is_preferred", "year", "quarter",
        "total_orders", "total_spend", "on_time_rate", "fill_rate", "avg_lead_time",
        tier(F.col("on_time_rate"), F.col("fill_rate"), steps, "Needs Improvement").alias("performance_rating"),
    )


def monthly_revenue_by_abc(sales: DataFrame, dates: DataFrame, products: DataFrame) -> DataFrame:
    """Revenue and orders per month and ABC class."""
    return (
        sales.join(dates.select("date_key", "year", "month_num", "month_name"), "date_key")
        .join(_current(products).select("product_key", "abc_class"), "product_key")
        .groupBy("year", "month_num", "month_name", "abc_class")
        .agg(
            F.sum("net_amount").alias("total_revenue"),
            F.count_distinct("sales_order_number").alias("order_count"),
        )
        .orderBy("year", "month_num", "abc_class")
        .select("year", "month_name", "abc_class", "total_revenue", "order_count")
    )


def supplier_comparison(purchases: DataFrame, suppliers: DataFrame) -> DataFrame:
    """Order lines, lead time, on-time and fill rate per supplier."""
    sums = purchases.groupBy("supplier_key").agg(
        F.count("*").alias("lines"),
        F.sum("actual_lead_days").alias("lead_days"),
        F.count("actual_lead_days").alias("delivered"),
        F.count_if("is_on_time").alias("on_time"),
        F.sum("quantity_received").alias("received"),
        F.sum("quantity_ordered").alias("ordered"),
    )
    names = _current(suppliers).select("supplier_key", "supplier_name", "reliability_tier")
    return (
        sums.join(names, "supplier_key")
        .groupBy("supplier_name", "reliability_tier")
        .agg(*[F.sum(c).alias(c) for c in ("lines", "lead_days", "delivered", "on_time", "received", "ordered")])
        .select(
            "supplier_name",
            "reliability_tier",
            F.col("lines").alias("total_orders"),
            round_to(ratio("lead_days", "delivered"), 1).alias("avg_lead_time"),
            round_to(pct("on_time", "lines"), 1).alias("on_time_pct"),
            round_to(pct("received", "ordered"), 1).alias("fill_rate_pct"),
        )
        .orderBy(F.desc("on_time_pct"), "supplier_name")
    )
