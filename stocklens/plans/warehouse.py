"""Jobs over the whole star schema and the named views."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.functions.expr import DateLike
from stocklens.operators.inventory import inventory_status
from stocklens.operators.sales import daily_sales, sales_anchor
from stocklens.operators.suppliers import supplier_performance
from stocklens.plans import loads, star, versions
from stocklens.sources.schemas import STAR
from stocklens.sources.tables import Tables, freed_shuffles, register_views, write_extract

#: Date key and second clustering key of the stock snapshots.
STOCK_CLUSTERING = ("date_key", "warehouse_key")


def operational_views(t: Tables) -> dict[str, DataFrame]:
    return {
        "v_inventory_status": inventory_status(t),
        "v_supplier_performance": supplier_performance(t),
        "v_daily_sales": daily_sales(t),
    }


def star_views(s: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The three BI views over star tables by name."""
    return {
        "vw_sales_dashboard": star.vw_sales_dashboard(
            s["fact_sales"], s["dim_date"], s["dim_product"], s["dim_customer"], s["dim_warehouse"]
        ),
        "vw_inventory_health": star.vw_inventory_health(
            s["fact_inventory_daily"], s["dim_date"], s["dim_product"], s["dim_warehouse"]
        ),
        "vw_supplier_scorecard": star.vw_supplier_scorecard(s["agg_supplier_performance"], s["dim_supplier"]),
    }


def register_all_views(t: Tables, s: Mapping[str, DataFrame] | None = None) -> None:
    register_views({**operational_views(t), **(star_views(s) if s else {})})


def _calendar(t: Tables, today) -> DataFrame:
    """Days from the first to the last date any fact refers to."""
    dates = [
        t("sales_orders", "order_date").select(F.col("order_date").alias("d")),
        t("purchase_orders", "order_date").select(F.col("order_date").alias("d")),
        t("purchase_orders", "actual_delivery_date").select(F.col("actual_delivery_date").alias("d")),
        t("stockout_events", "stockout_start_date").select(F.col("stockout_start_date").cast("date").alias("d")),
        t("stockout_events", "stockout_end_date").select(F.col("stockout_end_date").cast("date").alias("d")),
    ]
    # Each table is reduced to its two ends before the union.
    ends = [d.agg(F.min("d").alias("start"), F.max("d").alias("end")) for d in dates]
    span = ends[0]
    for e in ends[1:]:
        span = span.unionByName(e)
    return star.dim_date(
        span.agg(F.min("start").alias("start"), F.max("end").alias("end")).select(
            "start", F.greatest("end", today).alias("end")
        )
    )


def build_star(
    t: Tables,
    folder: str,
    as_of: DateLike = None,
    regions: Mapping[str, str] | None = None,
    sources: Tables | None = None,
) -> dict[str, DataFrame]:
    """Write the whole star schema below ``folder`` and return its tables.

    Dimensions are written first and read back, so that facts look their keys up in small
    files and not in the plans that made them; aggregates read the written facts. This is
    the full load: versions are valid from the first order on, which keeps their keys stable,
    and repeating it replaces everything but the ABC classes of other dates. Later changes are
    loaded by :func:`update_star`, which keeps closed versions. ``sources`` are tables to load the
    facts from, if their orders and lines are also stored side by side.
    """
    spark = t("products", "product_id").sparkSession
    today = sales_anchor(t, as_of)
    opening = t("sales_orders", "order_date").agg(F.min("order_date")).scalar()
    out: dict[str, DataFrame] = {}

    def keep(name: str, df: DataFrame) -> None:
        out[name] = spark.read.parquet(write_extract(df, f"{folder}/{name}"))

    keep("dim_date", _calendar(t, today))
    keep("dim_product", star.dim_product(t, opening))
    keep("dim_supplier", star.dim_supplier(t, opening))
    keep("dim_customer", star.dim_customer(t, opening))
    keep("dim_warehouse", star.dim_warehouse(t, regions))
    products, suppliers = out["dim_product"], out["dim_supplier"]
    customers, sites = out["dim_customer"], out["dim_warehouse"]
    for load, build in _facts(products, suppliers, customers, sites):
        out[load.name] = loads.load_fact(sources or t, folder, load, build)
    stock = f"{folder}/fact_inventory_daily"
    star.save_fact(star.fact_inventory_daily(t, products, sites, as_of), stock, *STOCK_CLUSTERING, whole=True)
    out["fact_inventory_daily"] = spark.read.parquet(stock)
    save_aggregates(folder, out["fact_sales"], out["fact_purchases"])
    return out | _aggregates(spark, folder, out["fact_sales"], as_of)


Build = Callable[[Tables], DataFrame]


def _facts(
    products: DataFrame, suppliers: DataFrame, customers: DataFrame, sites: DataFrame
) -> list[tuple[loads.FactLoad, Build]]:
    """The facts that are loaded by months, and what makes them of the source tables."""
    return [
        (loads.SALES, lambda t: star.fact_sales(t, products, customers, sites)),
        (loads.PURCHASES, lambda t: star.fact_purchases(t, products, suppliers, sites)),
        (loads.STOCKOUTS, lambda t: star.fact_stockouts(t, products, sites)),
    ]


def _save_months(df: DataFrame, path: str, period: str, whole: bool = False) -> None:
    """Write an aggregate in folders of its year and ``period``; without ``whole``, replace those in it."""
    mode = "static" if whole else "dynamic"
    writer = df.repartition("year", period).write.mode("overwrite").option("partitionOverwriteMode", mode)
    writer = writer.option("compression", "zstd")
    with freed_shuffles(df.sparkSession):
        writer.partitionBy("year", period).parquet(path)


def save_aggregates(folder: str, sales: DataFrame, bought: DataFrame) -> None:
    """Write the monthly sales and the supplier quarters of whole facts, and what they merge from."""
    for i, (_, fact) in enumerate(_in_parts(sales)):
        _save_months(star.agg_sales_monthly(fact), f"{folder}/agg_sales_monthly", "month", whole=i == 0)
    sums = f"{folder}/supplier_months"
    for i, (_, fact) in enumerate(_in_parts(bought)):
        _save_months(star.supplier_months(fact), sums, "month", whole=i == 0)
    figures = star.supplier_quarters(bought.sparkSession.read.parquet(sums))
    _save_months(figures, f"{folder}/agg_supplier_performance", "quarter", whole=True)


def read_star_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A star table with its columns in their declared order."""
    df = spark.read.parquet(f"{folder}/{name}")
    return df.select(STAR[name].names) if name in STAR else df


def _aggregates(spark: SparkSession, folder: str, sales: DataFrame, as_of: DateLike) -> dict[str, DataFrame]:
    """The stored aggregates, after the ABC classes of ``as_of`` are made from the monthly sales."""
    out = {name: read_star_table(spark, folder, name) for name in ("agg_sales_monthly", "agg_supplier_performance")}
    classes = star.refresh_abc_from_months(out["agg_sales_monthly"], sales, as_of)
    star.save_by_partition(classes, f"{folder}/agg_abc_classification", "analysis_date")
    out["agg_abc_classification"] = spark.read.parquet(f"{folder}/agg_abc_classification")
    return out


def _of_months(df: DataFrame, months: Iterable[loads.Month]) -> DataFrame:
    """Rows of a table in monthly folders; the others are not listed."""
    dated = [m for m in months if m is not None]
    own = F.col("month_key").isin(dated)
    return df.where(own | F.col("month_key").isNull() if None in months else own)


def _in_parts(
    fact: DataFrame, months: Iterable[loads.Month] | None = None
) -> list[tuple[set[loads.Month], DataFrame]]:
    """A fact, or ``months`` of it, in parts of as many months as one write moves; months without rows are in one."""
    own = fact if months is None else _of_months(fact, months)
    lines = dict.fromkeys(months or (), 0)
    lines |= {r.month_key: r.n for r in own.groupBy("month_key").agg(F.count("*").alias("n")).collect()}
    parts = loads.in_parts(lines)
    return [(parts[0], own)] if len(parts) == 1 else [(some, _of_months(fact, some)) for some in parts]


def update_aggregates(spark: SparkSession, folder: str, sold: set[loads.Month], bought: set[loads.Month]) -> None:
    """Bring the aggregates of touched months up to date; other months are neither read nor written.

    Sales per month are made anew from the months' lines. Supplier quarters are merged from
    the sums of their months, of which only the touched ones are made from lines.
    """
    if sold:
        for months, fact in _in_parts(spark.read.parquet(f"{folder}/fact_sales"), sold):
            wanted = {_period(m, 1) for m in months}
            _replace_periods(star.agg_sales_monthly(fact), f"{folder}/agg_sales_monthly", "month", wanted)
    if bought:
        sums = f"{folder}/supplier_months"
        for months, fact in _in_parts(spark.read.parquet(f"{folder}/fact_purchases"), bought):
            _replace_periods(star.supplier_months(fact), sums, "month", {_period(m, 1) for m in months})
        quarters = {_period(m, 3) for m in bought}
        stored = spark.read.parquet(sums)
        touched = F.lit(False)
        for year, quarter in quarters:
            if year is None:
                touched |= F.col("year").isNull()
            else:
                touched |= (F.col("year") == year) & F.col("month").between(3 * quarter - 2, 3 * quarter)
        figures = star.supplier_quarters(stored.where(touched))
        _replace_periods(figures, f"{folder}/agg_supplier_performance", "quarter", quarters)


def _period(month: loads.Month, size: int) -> tuple[int | None, int | None]:
    """(year, number of the period of ``size`` months) of yyyymm."""
    return (None, None) if month is None else (month // 100, -(-(month % 100) // size))


def _replace_periods(df: DataFrame, path: str, period: str, wanted: set[tuple[int | None, int | None]]) -> None:
    """Replace the folders ``wanted``; those for which ``df`` has no row are left empty."""
    _save_months(df, path, period)
    spark = df.sparkSession
    with freed_shuffles(spark):
        there = {tuple(r) for r in df.select("year", period).distinct().collect()}
    for year, number in wanted - there:
        default = "__HIVE_DEFAULT_PARTITION__"
        place = f"{path}/year={default if year is None else year}/{period}={default if number is None else number}"
        spark.createDataFrame([], df.drop("year", period).schema).write.mode("overwrite").parquet(place)


def _merged(
    spark: SparkSession, folder: str, name: str, snapshot: DataFrame, business_key: str, effective: Column
) -> tuple[DataFrame, loads.Moved]:
    """A stored dimension after a snapshot was merged, and what that means for facts."""
    before = spark.read.parquet(f"{folder}/{name}")
    own = {business_key, versions.key_name(business_key), *versions.VERSIONING}
    tracked = [c for c in before.columns if c not in own]
    merged = versions.scd2_merge(before, snapshot, business_key, tracked, effective)
    copy = spark.read.parquet(write_extract(merged, f"{folder}/{name}.next"))
    with freed_shuffles(spark):
        change = versions.opened_since(before, copy, business_key).first()
    moved = loads.Moved(business_key, change.moved_from, change.has_new)
    return spark.read.parquet(write_extract(copy, f"{folder}/{name}")), moved


def update_star(
    t: Tables,
    folder: str,
    since: DateLike = None,
    as_of: DateLike = None,
    regions: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Load what changed into a star that :func:`build_star` wrote below ``folder``.

    Members whose columns changed get a new version from ``as_of`` on, also where that lies
    before versions they have already, and versions that closed stay. Of the facts, the months
    are written anew whose sources changed since the last load, however far back, or whose keys
    moved; from ``since`` on, if given, all. Each row has the keys valid on its date. The stock of
    ``as_of`` joins the snapshots of other days. Aggregates are brought up to date for the same
    months. A run that breaks off can be repeated.
    """
    spark = t("products", "product_id").sparkSession
    today = sales_anchor(t, as_of)
    out: dict[str, DataFrame] = {}
    moved: list[loads.Moved] = []

    def merge(name: str, snapshot: DataFrame, business_key: str) -> None:
        out[name], change = _merged(spark, folder, name, snapshot, business_key, today)
        moved.append(change)

    def keep(name: str, df: DataFrame) -> None:
        out[name] = spark.read.parquet(write_extract(df, f"{folder}/{name}"))

    keep("dim_date", _calendar(t, today))
    merge("dim_product", star.dim_product(t, today), "product_id")
    merge("dim_supplier", star.dim_supplier(t, today), "supplier_id")
    merge("dim_customer", star.dim_customer(t, today), "customer_id")
    keep("dim_warehouse", star.dim_warehouse(t, regions))
    products, suppliers = out["dim_product"], out["dim_supplier"]
    customers, sites = out["dim_customer"], out["dim_warehouse"]
    first = int(str(since)[:4]) * 100 + int(str(since)[5:7]) if since is not None else None
    touched: dict[str, set[loads.Month]] = {}
    for load, build in _facts(products, suppliers, customers, sites):
        touched[load.name] = loads.update_fact(t, folder, load, build, moved, first)
        out[load.name] = spark.read.parquet(f"{folder}/{load.name}")
    out["fact_inventory_daily"] = _snapshot(t, folder, products, sites, as_of)
    update_aggregates(spark, folder, touched["fact_sales"], touched["fact_purchases"])
    return out | _aggregates(spark, folder, out["fact_sales"], as_of)


def _snapshot(t: Tables, folder: str, products: DataFrame, sites: DataFrame, as_of: DateLike) -> DataFrame:
    """Add the stock of one day to the stored days, in place of that day's if it is there."""
    path = f"{folder}/fact_inventory_daily"
    spark = products.sparkSession
    fresh = star.fact_inventory_daily(t, products, sites, as_of)
    day = sales_anchor(t, as_of)
    number, month = F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day), loads.month_number(day)
    others = spark.read.parquet(path).where((F.col("month_key") == month) & (F.col("date_key") != number))
    both = spark.read.parquet(write_extract(others.drop("month_key").unionByName(fresh), f"{path}.next"))
    star.save_fact(both, path, *STOCK_CLUSTERING)
    return spark.read.parquet(path)
