"""Versions of dimension members: keys, snapshots, and changes that arrive in any order.

A member's versions follow each other without gap or overlap: each ends on the day the next one
begins. So intervals are not kept up one at a time but chained anew, by LEAD over all versions of
a member, whenever a version comes in between. A key holds the day its version begins and stays
the same whatever comes before or after it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# A version key holds the day its version starts in the last five digits.
DAYS_RANGE = 100_000
#: Columns of a versioned dimension beside its key and its attributes.
VERSIONING = ("effective_date", "expiration_date", "is_current")


def key_name(business_key: str) -> str:
    return business_key.replace("_id", "_key")


def version_key(business_key: str, effective: Column) -> Column:
    days = F.datediff(effective, F.lit("1970-01-01").cast("date"))
    return (F.col(business_key).cast("bigint") * DAYS_RANGE + days).alias(key_name(business_key))


def first_versions(df: DataFrame, business_key: str, effective: Column) -> DataFrame:
    """First version of each row: key, start date, open end."""
    return df.select(
        version_key(business_key, effective),
        "*",
        effective.alias("effective_date"),
        F.lit(None).cast("date").alias("expiration_date"),
        F.lit(True).alias("is_current"),
    )


def scd2_merge(
    dim: DataFrame, updates: DataFrame, business_key: str, tracked: Sequence[str], effective: Column
) -> DataFrame:
    """Apply a snapshot of changed rows, valid from ``effective`` on, to a versioned dimension.

    A row that differs (NULL-safe) in a tracked column from the member's version of that day
    opens a version, which lasts until the member's next one, if there is one; before the first
    version, it is compared to that one. New business keys are added; rows without an update
    stay. Merging the same snapshot again changes nothing, and a second change on the same day
    replaces that day's version. Untracked columns keep their value, NULL for a new key.
    """
    wanted = updates.select(F.col(business_key).alias("_member"), F.struct(*tracked).alias("_new"))
    return _chained(dim, wanted.withColumn("_from", effective), business_key, tracked, keep_equal=False)


def scd2_apply(
    dim: DataFrame, changes: DataFrame, business_key: str, tracked: Sequence[str], day: str = "effective_date"
) -> DataFrame:
    """Apply changes, each with its own day, to a versioned dimension, in whatever order they come.

    Every change is a version of its own, equal or not to the one before it, so the result
    depends on the set of changes only and not on how they were split over calls. Of several
    changes of a member on a day the greatest by the tracked columns counts, and it replaces a
    version of that day which the dimension already has.
    """
    wanted = changes.groupBy(F.col(business_key).alias("_member"), F.col(day).cast("date").alias("_from")).agg(
        F.max(F.struct(*tracked)).alias("_new")
    )
    return _chained(dim, wanted, business_key, tracked, keep_equal=True)


def _chained(
    dim: DataFrame, wanted: DataFrame, business_key: str, tracked: Sequence[str], keep_equal: bool
) -> DataFrame:
    """``dim`` with the versions ``wanted`` (_member, _from, _new), and intervals that follow.

    All windows are over one member's versions, in one order, so rows move once.
    """
    own = dim.select(F.col(business_key).alias("_member"), F.col("effective_date").alias("_from"), F.struct(*dim.columns).alias("_own"))
    rows = own.unionByName(wanted.select("_member", "_from", "_new"), allowMissingColumns=True)
    change = F.col("_new").isNotNull()
    order = W.partitionBy("_member").orderBy("_from", change)
    until, after = order.rowsBetween(W.unboundedPreceding, 0), order.rowsBetween(1, W.unboundedFollowing)
    # What a new version lies on: the version before it, else the one after it.
    base = F.coalesce(F.last("_own", ignorenulls=True).over(until), F.first("_own", ignorenulls=True).over(after))
    rows = rows.withColumn("_base", base)
    if not keep_equal:
        differs = reduce(lambda a, b: a | b, [~F.col(f"_new.{c}").eqNullSafe(F.col(f"_base.{c}")) for c in tracked])
        rows = rows.where(~change | F.col("_base").isNull() | differs)
    replaced = ~change & F.coalesce(F.lead("_from").over(order) == F.col("_from"), F.lit(False))
    rows = rows.withColumn("_gone", replaced).where(~F.col("_gone"))
    rows = rows.withColumn("_next", F.lead("_from").over(order))

    end = F.coalesce("_next", "_own.expiration_date")
    versioning = {
        key_name(business_key): version_key("_member", F.col("_from")),
        business_key: F.col("_member"),
        "effective_date": F.col("_from"),
        "expiration_date": end,
        "is_current": end.isNull(),
    }
    types = dict(dim.dtypes)

    def field(c: str) -> Column:
        value = F.when(change, F.col(f"_new.{c}")).otherwise(F.col(f"_own.{c}")) if c in tracked else F.col(f"_base.{c}")
        return versioning.get(c, value).cast(types[c]).alias(c)

    return rows.select(*[field(c) for c in dim.columns])


def opened_since(before: DataFrame, after: DataFrame, business_key: str) -> DataFrame:
    """One row (moved_from, has_new): what a merge changed for the facts' keys.

    ``moved_from`` is the first day that has another version now, NULL where there is none.
    Before the first version of a member its key holds as well, so a new first version counts
    from the beginning of time. ``has_new`` says that members came that had no version at all.
    """
    key = key_name(business_key)
    known = before.groupBy(business_key).agg(F.min("effective_date").alias("_first"))
    opened = after.select(business_key, key, "effective_date").join(before.select(key), key, "left_anti")
    dated = opened.join(known, business_key, "left")
    first = F.col("_first")
    moved = F.when(F.col("effective_date") < first, F.lit("0001-01-01").cast("date")).when(
        first.isNotNull(), F.col("effective_date")
    )
    return dated.agg(F.min(moved).alias("moved_from"), F.coalesce(F.bool_or(first.isNull()), F.lit(False)).alias("has_new"))
