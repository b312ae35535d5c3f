"""Column expressions: division, rounding, clipping, label ladders, dates."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DateLike = dt.date | str | None

# A sales or purchase order in this state never counts.
CANCELLED = "Cancelled"
# Fixed value: annual carrying cost as a share of inventory value.
CARRYING_RATE = "0.20"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` as DOUBLE, NULL when the denominator is 0 or NULL."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def pct(num: str | Column, den: str | Column) -> Column:
    return ratio(num, den) * 100


def round_to(c: str | Column, digits: int = 0) -> Column:
    """Half-up decimal rounding of a finite DOUBLE.

    The value goes through DECIMAL first, so a tie such as 1.005 does not depend on its
    binary neighbour.
    """
    return F.round(col(c).cast("decimal(28,8)"), digits).cast("double")


def round_int(c: str | Column) -> Column:
    return F.round(col(c).cast("decimal(28,8)"), 0).cast("bigint")


def round_half_even_int(c: str | Column) -> Column:
    """Nearest integer of the DOUBLE itself, ties to even."""
    return F.rint(col(c)).cast("bigint")


def money(c: str | Column, digits: int = 2) -> Column:
    """Round an exact DECIMAL amount half-up."""
    return F.round(col(c), digits)


def at_least_value(c: str | Column, low: float) -> Column:
    """Lower clip that keeps NULL (``greatest`` would replace it by the bound)."""
    c = col(c)
    return F.when(c < low, F.lit(low)).otherwise(c)


def within(c: str | Column, low: float, high: float) -> Column:
    """Clip to [low, high], keeping NULL."""
    c = col(c)
    return F.when(c < low, F.lit(low)).when(c > high, F.lit(high)).otherwise(c)


def label_up_to(c: str | Column, steps: Sequence[tuple[float, object]], default: object) -> Column:
    """First label whose inclusive upper bound holds; NULL falls to the default."""
    c = col(c)
    out = None
    for bound, label in steps:
        out = F.when(c <= bound, label) if out is None else out.when(c <= bound, label)
    return out.otherwise(default)


def label_from(c: str | Column, steps: Sequence[tuple[float, object]], default: object) -> Column:
    """First label whose inclusive lower bound holds; NULL falls to the default."""
    c = col(c)
    out = None
    for bound, label in steps:
        out = F.when(c >= bound, label) if out is None else out.when(c >= bound, label)
    return out.otherwise(default)


def tier(on_time: Column, fill: Column, steps: Sequence[tuple[float, float, str]], default: str) -> Column:
    """First label for which both rates reach their bounds."""
    out = None
    for t, f, label in steps:
        cond = (on_time >= t) & (fill >= f)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def normal_quantile(p: float) -> float:
    """Inverse standard normal CDF; a driver-side constant, never a column function."""
    return NormalDist().inv_cdf(p)


def anchor(as_of: DateLike, table: DataFrame, column: str) -> Column:
    """The reporting date: the given one, else the latest ``column`` as a scalar subquery."""
    if as_of is not None:
        return F.lit(str(as_of)).cast("date")
    return table.agg(F.max(F.col(column).cast("date"))).scalar()


def not_cancelled(status: str | Column = "status") -> Column:
    """True for live orders; a NULL status is dropped by the filter."""
    return col(status) != CANCELLED


def days_between(end: str | Column, start: str | Column) -> Column:
    return F.datediff(col(end), col(start))


def whole_days(end: str, start: str) -> Column:
    """Elapsed 24-hour days between two timestamps, floored."""
    micros = F.timestamp_diff("MICROSECOND", F.col(start), F.col(end))
    return F.floor(micros / F.lit(86_400_000_000).cast("double")).cast("bigint")


def fractional_days(end: Column, start: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(86_400_000_000).cast("double")


def date_key(d: str | Column) -> Column:
    """yyyymmdd as INT."""
    d = col(d)
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def is_weekend(d: str | Column) -> Column:
    return F.weekday(col(d)) >= 5


def keep_present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Project onto the listed columns, skipping those the frame lacks."""
    have = set(df.columns)
    return df.select([c for c in columns if c in have])
