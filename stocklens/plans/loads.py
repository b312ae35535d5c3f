"""Loading changed facts: which months of the sources differ, and only these written anew.

Every month of a fact's sources has a digest that does not depend on the order of rows: their
number, the sum and the exclusive or of two hashes of each order with its lines. Of a line 64 bits
count: a month's change goes unseen only if all lines that changed keep theirs. Digests are kept
beside the facts. An update computes those of the sources as they are now and compares: a date
that was filled in late, a line added to an old order, an order that is gone, all change the digest
of their month and of no other. Rows without a date are a month of their own, NULL.

A fact's keys also depend on the dimensions. Versions that begin on a day move the keys of
months from then on; members that were unknown give a key to the months that have unknown ones.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.plans.star import UNKNOWN, save_fact
from stocklens.plans.versions import key_name
from stocklens.sources.tables import Source, Tables, freed_shuffles, write_extract

Digest = tuple[int, int, int]
Month = int | None

#: Lines that one write of a fact moves: some twelve gigabytes, which are deleted before the next.
LINES_PER_WRITE = 50_000_000


@dataclass(frozen=True)
class FactLoad:
    """Where a fact comes from. ``orders`` hold the ``day``; without them, the lines do."""

    name: str
    date_key: str
    cluster: str
    lines: str
    line_columns: tuple[str, ...]
    day: str
    members: tuple[str, ...]
    orders: str | None = None
    order_key: str | None = None
    order_columns: tuple[str, ...] = ()
    product_columns: tuple[str, ...] = ()


SALES = FactLoad(
    "fact_sales", "date_key", "product_key", "sales_order_items",
    ("so_item_id", "product_id", "quantity_ordered", "quantity_shipped", "unit_price", "discount_percent", "line_number"),
    "order_date", ("product_id", "customer_id", "warehouse_id"), "sales_orders", "so_id",
    ("so_number", "customer_id", "warehouse_id", "requested_delivery_date", "actual_ship_date"),
    ("unit_cost",),
)
PURCHASES = FactLoad(
    "fact_purchases", "order_date_key", "supplier_key", "purchase_order_items",
    ("po_item_id", "product_id", "quantity_ordered", "quantity_received", "unit_cost", "line_total", "line_number"),
    "order_date", ("product_id", "supplier_id", "warehouse_id"), "purchase_orders", "po_id",
    ("po_number", "supplier_id", "warehouse_id", "expected_delivery_date", "actual_delivery_date"),
)
STOCKOUTS = FactLoad(
    "fact_stockouts", "start_date_key", "product_key", "stockout_events",
    ("stockout_id", "warehouse_id", "product_id", "stockout_end_date", "demand_during_stockout", "lost_sales_amount", "root_cause"),
    "stockout_start_date", ("product_id", "warehouse_id"),
)


def month_number(day: Column) -> Column:
    """yyyymm of a date, NULL for none."""
    return (F.year(day) * 100 + F.month(day)).cast("int")


def row_hashes(columns: Iterable[str | Column]) -> tuple[Column, Column]:
    """Two 64-bit hashes of a row; that a column is NULL counts as a value of its own."""
    cols = [F.col(c) if isinstance(c, str) else c for c in columns]
    empty = reduce(lambda a, b: a * 2 + b, [c.isNull().cast("bigint") for c in cols])
    return F.xxhash64(F.lit(1), empty, *cols), F.xxhash64(F.lit(2), empty, *cols)


def _fold(rows: DataFrame, columns: Iterable[str | Column], keys: list[str], count: Column) -> DataFrame:
    one, two = row_hashes(columns)
    return rows.select(*keys, count.alias("n"), one.alias("_one"), two.alias("_two")).groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("_one").cast("decimal(20,0)")).alias("s"),
        F.bit_xor("_two").alias("x"),
    )


def source_digests(t: Tables, load: FactLoad) -> DataFrame:
    """(month, n, s, x) of the sources: the number of lines and two sums of hashes.

    Lines are folded per order before they meet the order, and orders per month.
    """
    have = t.columns(load.lines)
    columns = [c for c in load.line_columns if c in have]
    if load.orders is None:
        rows = t(load.lines, *columns, load.day).withColumn("month", month_number(F.col(load.day)))
        return _fold(rows, [*columns, load.day], ["month"], F.lit(1))
    # A line moves as its hash: to its product, if that counts, and to its order. An order moves as
    # its hash and month.
    lines = t(load.lines, load.order_key, *columns)
    line = row_hashes(columns)[0].alias("_line_one")
    if load.product_columns:
        goods = t("products", "product_id", *load.product_columns)
        goods = goods.withColumnsRenamed({c: f"_product_{c}" for c in load.product_columns})
        lines = lines.select(load.order_key, "product_id", line).join(goods, "product_id", "left")
        line = row_hashes(["_line_one", *[f"_product_{c}" for c in load.product_columns]])[0].alias("_line_one")
    one = F.col("_line_one")
    lines = lines.select(load.order_key, line)
    # Folded where they lie, lines in buckets by their order would not move at all; others move as they
    # are, since a fold is wider than its line.
    if load.product_columns or t.stored_by(load.lines) != load.order_key:
        lines = lines.repartition(load.order_key)
    folded = (
        lines.groupBy(load.order_key)
        .agg(
            F.count("*").alias("n"),
            F.sum(F.shiftright(one, 32)).alias("high"),
            F.sum(one.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
            F.bit_xor(row_hashes([one])[1]).alias("x"),
        )
    )
    orders = t(load.orders, load.order_key, load.day, *load.order_columns).select(
        load.order_key,
        month_number(F.col(load.day)).alias("month"),
        row_hashes([load.day, *load.order_columns])[0].alias("_order"),
    )
    whole = folded.join(orders, load.order_key, "left")
    return _fold(whole, [load.order_key, "_order", "n", "high", "low", "x"], ["month"], F.col("n"))


def collected(digests: DataFrame) -> dict[Month, Digest]:
    """The digests by month: as many as the calendar has months."""
    with freed_shuffles(digests.sparkSession):
        rows = digests.select("*").collect()
    return {r.month: (int(r.n), int(r.s), int(r.x)) for r in rows}


def _digest_path(folder: str, load: FactLoad) -> str:
    return f"{folder}/digest_{load.name}"


def stored_digests(spark: SparkSession, folder: str, load: FactLoad) -> dict[Month, Digest]:
    """The digests of the last load; none where the fact was never loaded with them."""
    try:
        return collected(spark.read.parquet(_digest_path(folder, load)))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}


def keep_digests(spark: SparkSession, folder: str, load: FactLoad, digests: dict[Month, Digest]) -> None:
    rows = [(m, n, Decimal(s), x) for m, (n, s, x) in digests.items()]
    write_extract(spark.createDataFrame(rows, "month int, n long, s decimal(38,0), x long").coalesce(1), _digest_path(folder, load))


def of_months(t: Tables, load: FactLoad, months: Iterable[Month]) -> Tables:
    """``t`` with only the rows of a fact's sources that belong to ``months``.

    Orders are filtered by their day, and lines by the orders, first by the range of their keys,
    which reaches the scan. Lines of no order belong to NULL.
    """
    months = set(months)
    dated = sorted(m for m in months if m is not None)
    stored = lambda name: None if None in months else t.stored_by(name)

    def wanted(df: DataFrame) -> DataFrame:
        day = F.col(load.day)
        # Spans of neighbouring months, so that the filter is made of ranges of days.
        keep = F.lit(False)
        for first, last in _spans(dated):
            keep |= (day >= F.lit(first)) & (day < F.lit(last))
        return df.where(keep | day.isNull() if None in months else keep)

    if load.orders is None:
        return t.replaced(**{load.lines: wanted(t(load.lines))})
    orders, lines, key = wanted(t(load.orders)), t(load.lines), load.order_key
    low, high = orders.agg(F.min(key), F.max(key)).first()
    own = lines.where(F.lit(False))
    if low is not None:
        own = lines.where(F.col(key).between(low, high)).join(orders.select(key), key, "left_semi")
    if None in months:
        own = own.unionByName(lines.join(t(load.orders, key), key, "left_anti"))
    kept = {load.orders: Source.of(orders, stored(load.orders)), load.lines: Source.of(own, stored(load.lines))}
    return t.overlaid(Tables(kept))


def _spans(months: list[int]) -> list[tuple[dt.date, dt.date]]:
    """[first day, day after the last) of stretches of consecutive months (yyyymm, ascending)."""
    out: list[tuple[dt.date, dt.date]] = []
    for m in months:
        first = dt.date(m // 100, m % 100, 1)
        last = dt.date(m // 100 + m % 100 // 12, m % 100 % 12 + 1, 1)
        if out and out[-1][1] == first:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def in_parts(lines: dict[Month, int]) -> list[set[Month]]:
    """The months of ``lines``, their numbers of lines, in as many parts as these need.

    Neighbouring months make a part; rows without a date are one by themselves, if there are several.
    """
    if sum(lines.values()) <= LINES_PER_WRITE:
        return [set(lines)]
    out: list[set[Month]] = [{None}] if None in lines else []
    held = LINES_PER_WRITE
    for m in sorted(lines.keys() - {None}):
        if held + lines[m] > LINES_PER_WRITE:
            out.append(set())
            held = 0
        out[-1].add(m)
        held += lines[m]
    return out


def _writes(t: Tables, load: FactLoad, months: Iterable[Month], now: dict[Month, Digest]) -> list[set[Month]]:
    """``months`` in as many writes as their lines need.

    Only of tables in buckets by their order: their months are picked where they lie. Of others each
    write would move all lines once more.
    """
    if load.orders is None or t.stored_by(load.lines) != load.order_key:
        return [set(months)]
    return in_parts({m: now[m][0] if m in now else 0 for m in months})


def load_fact(t: Tables, folder: str, load: FactLoad, build: Callable[[Tables], DataFrame]) -> DataFrame:
    """Write a whole fact and the digests of its sources, a long one in several writes of its months."""
    spark = t("products", "product_id").sparkSession
    digests = collected(source_digests(t, load))
    writes = _writes(t, load, digests, digests)
    for i, months in enumerate(writes):
        rows = build(of_months(t, load, months) if len(writes) > 1 else t)
        save_fact(rows, f"{folder}/{load.name}", load.date_key, load.cluster, whole=i == 0)
    keep_digests(spark, folder, load, digests)
    return spark.read.parquet(f"{folder}/{load.name}")


@dataclass(frozen=True)
class Moved:
    """What a merge of a dimension means for the facts' keys."""

    member: str
    moved_from: dt.date | None
    has_new: bool


def update_fact(
    t: Tables,
    folder: str,
    load: FactLoad,
    build: Callable[[Tables], DataFrame],
    moved: Iterable[Moved] = (),
    since: Month = None,
) -> set[Month]:
    """Write the months anew that changed since the last load; returns them.

    Beside the months whose digests differ, these are the months from ``since`` on and those
    whose keys ``moved``. A run that breaks off leaves the old digests, so the next one does
    the months again.
    """
    spark = t("products", "product_id").sparkSession
    path = f"{folder}/{load.name}"
    now, before = collected(source_digests(t, load)), stored_digests(spark, folder, load)
    months = {m for m in now.keys() | before.keys() if now.get(m) != before.get(m)}
    if since is not None:
        months |= {m for m in now if m is None or m >= since}
    for change in moved:
        if change.member not in load.members:
            continue
        if change.moved_from is not None:
            start = change.moved_from.year * 100 + change.moved_from.month
            # Facts without a day have the key of the current version.
            months |= {m for m in now if m is None or m >= start}
        if change.has_new and before:
            unknown = spark.read.parquet(path).where(F.col(key_name(change.member)) == UNKNOWN)
            months |= {r.month_key for r in unknown.select("month_key").distinct().collect()}
    if not months:
        return set()
    for some in _writes(t, load, months, now):
        save_fact(build(of_months(t, load, some)), path, load.date_key, load.cluster)
    for gone in months - now.keys():
        _empty(spark, path, gone)
    keep_digests(spark, folder, load, now)
    return months


def _empty(spark: SparkSession, path: str, month: Month) -> None:
    """Leave a month of a fact without rows."""
    folder = "__HIVE_DEFAULT_PARTITION__" if month is None else month
    columns = spark.read.parquet(path).drop("month_key").limit(0)
    nothing = spark.createDataFrame([], columns.schema)
    nothing.write.mode("overwrite").parquet(f"{path}/month_key={folder}")
