"""Stock of past days, from today's stock and the ledger of movements.

What was on hand at the end of a day is today's stock less all movements after that day. It only
changes on days with movements, so the history is kept as intervals of constant stock: movements
are summed per site, product and day, and a sum over the later days takes them off today's stock.
A window holds one site's product and at most a row for each day of the calendar, however many
movements a day has. Stored, the intervals are cut at the ends of months, so that a day is answered
from its month's folder alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from stocklens.functions.expr import DateLike
from stocklens.operators.ledger import inventory_ledger
from stocklens.operators.sales import sales_anchor
from stocklens.plans.loads import month_number
from stocklens.sources.tables import Tables, freed_shuffles

_PAIR = ["warehouse_id", "product_id"]


def stock_intervals(t: Tables, as_of: DateLike = None) -> DataFrame:
    """(warehouse_id, product_id, from_date, until_date, quantity_on_hand), ``until_date`` excluded.

    The history begins with the first movement of all and ends with ``as_of``, whose stock the
    table ``inventory`` holds; a product without movements has one interval. A product that moved
    and has no stock row has none today. Movements without a day, or after ``as_of``, are left out.
    """
    ledger = inventory_ledger(t) if "inventory_transactions" not in t else t("inventory_transactions")
    today = sales_anchor(t, as_of)
    moved = ledger.select(*_PAIR, F.col("transaction_date").cast("date").alias("day"), "quantity").where(F.col("day") <= today)
    # The first day is read with the columns of the movements, so that both come of the same shuffles.
    first = moved.agg(F.min(F.struct("day", *_PAIR, "quantity")).alias("first")).select("first.day").scalar()
    start = F.coalesce(first, today)
    stock = t("inventory", *_PAIR, "quantity_on_hand")
    # A stock row stands on the first day and brings today's stock along.
    opening = stock.select(*_PAIR, start.alias("day"), F.lit(0).cast("bigint").alias("quantity"), "quantity_on_hand")
    # Movements move once, by the pair, for the sums of a day and for the windows over its days.
    daily = (
        moved.select(*_PAIR, "day", F.col("quantity").cast("bigint").alias("quantity"), F.lit(0).alias("quantity_on_hand"))
        .unionByName(opening)
        .repartition(*_PAIR)
        .groupBy(*_PAIR, "day")
        .agg(F.sum("quantity").alias("net"), F.sum("quantity_on_hand").alias("_held"))
    )
    pair = W.partitionBy(*_PAIR)
    newest_first = pair.orderBy(F.desc("day"))
    later = F.coalesce(F.sum("net").over(newest_first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    levels = daily.select(
        *_PAIR,
        "day",
        "net",
        F.coalesce(F.lag("day").over(newest_first), F.date_add(today, 1)).alias("until"),
        F.lead("day").over(newest_first).isNull().alias("oldest"),
        (F.coalesce(F.sum("_held").over(pair), F.lit(0)) - later).cast("bigint").alias("held"),
        start.alias("start"),
    )

    def interval(begin: str, end: str, held: Column) -> Column:
        return F.struct(F.col(begin).alias("from_date"), F.col(end).alias("until_date"), held.alias("quantity_on_hand"))

    own = interval("day", "until", F.col("held"))
    # Without a stock row, the time before the first movement is not there yet.
    before = interval("start", "day", F.col("held") - F.col("net"))
    spans = F.when(F.col("oldest") & (F.col("day") > F.col("start")), F.array(before, own)).otherwise(F.array(own))
    return levels.select(*_PAIR, F.explode(spans).alias("span")).select(*_PAIR, "span.*")


def _cut(intervals: DataFrame, period: str, months: int) -> DataFrame:
    """Intervals cut at the ends of periods, with the first day of each one's ``period``."""
    first, last = F.trunc("from_date", period), F.trunc(F.date_sub("until_date", 1), period)
    start = F.col(period)
    return (
        intervals.withColumn(period, F.explode(F.sequence(first, last, F.expr(f"INTERVAL {months} MONTH"))))
        .withColumn("from_date", F.greatest("from_date", start))
        .withColumn("until_date", F.least("until_date", F.add_months(start, months)))
    )


def monthly(intervals: DataFrame) -> DataFrame:
    """Intervals cut at the ends of months, with their ``month_key``, as they are written.

    Stock that stands still has an interval a month. So that these do not move, intervals move cut at
    the ends of years, and are cut at those of months by the task that writes them. A task sorts
    several times what it reads, so the number of tasks is fixed: by what they read, Spark would merge
    them until they spill.
    """
    tasks = 2 * int(intervals.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    years = _cut(intervals, "year", 12).repartitionByRange(tasks, "year", *_PAIR).drop("year")
    months = _cut(years, "month", 1).withColumn("month_key", month_number(F.col("month"))).drop("month")
    return months.sortWithinPartitions("month_key", *_PAIR, "from_date")


def save_history(intervals: DataFrame, path: str) -> None:
    """Write intervals in monthly folders, cut at the ends of months."""
    writer = monthly(intervals).write.mode("overwrite").option("compression", "zstd")
    with freed_shuffles(intervals.sparkSession):
        writer.partitionBy("month_key").parquet(path)


def stock_on(intervals: DataFrame, days: Iterable[Column]) -> DataFrame:
    """(day, warehouse_id, product_id, quantity_on_hand) for each of a few days of the history.

    Stored intervals are read from the months of the days only.
    """
    days = list(days)
    held = lambda d: (d >= F.col("from_date")) & (d < F.col("until_date"))
    here = reduce(or_, [held(d) for d in days])
    if "month_key" in intervals.columns:
        here &= reduce(or_, [F.col("month_key") == month_number(d) for d in days])
    asked = intervals.where(here).withColumn("day", F.explode(F.array(*days)))
    return asked.where(held(F.col("day"))).select("day", *_PAIR, "quantity_on_hand")


def as_of_day(t: Tables, intervals: DataFrame, day: Column) -> Tables:
    """``t`` with the stock of a past day: nothing is known to be reserved then."""
    held = stock_on(intervals, [day]).drop("day")
    levels = t("inventory", *_PAIR, "reorder_point", "reorder_quantity")
    stock = held.join(levels, _PAIR, "left").select(
        *_PAIR,
        "quantity_on_hand",
        F.lit(0).cast("bigint").alias("quantity_reserved"),
        F.col("quantity_on_hand").alias("quantity_available"),
        "reorder_point",
        "reorder_quantity",
    )
    return t.replaced(inventory=stock)
