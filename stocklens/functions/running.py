"""Running totals over a whole table, and numbering, without sending a table to one task.

An ordered window without a partition key puts every row in one partition. Here the rows are
summed per distinct value first, and per block of keys where equal values need an order. These
cells fall into buckets by a monotone function of the value; a window runs inside each bucket, and
its sums are offset by those of the buckets before it. No window is over rows of the whole table,
or over all rows of a value. One form serves all sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: log(1 + |value|), below 90 for any DECIMAL(38), times this: at most 2^18 buckets, each with the
#: distinct values that differ by a thousandth.
COARSE = 1 << 10
#: A 64-bit key has 2^20 coarse blocks, each 2^20 fine ones, each 2^24 keys.
COARSE_BITS, FINE_BITS = 44, 24
LAST = (1 << 62) - 1


def _descending(value: str, scale: int) -> Column:
    """A bucket number that never falls as the value falls; NULL comes last."""
    v = F.col(value).cast("double")
    place = F.floor(-F.signum(v) * F.log(1 + F.abs(v)) * scale).cast("bigint")
    return F.coalesce(place, F.lit(LAST))


def _sum_before(column: str, order: str | Column, *partition: str) -> Column:
    window = W.partitionBy(*partition).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(window), F.lit(0))


def _cells(df: DataFrame, value: str, key: str | None) -> DataFrame:
    """Sums of the rows before each cell of equal values, in the order of values, then keys.

    A cell is a distinct value, or with a ``key`` a value and a block of keys, so that equal values
    are cells of bounded size too. Columns: _value, _kb, _rows_before, _sum_before, _sum_upto (the
    value's whole group included), grand_total.
    """
    block = F.lit(0).cast("bigint") if key is None else F.shiftright(F.col(key).cast("bigint"), FINE_BITS)
    cells = (
        df.groupBy(F.col(value).alias("_value"), block.alias("_kb"))
        .agg(F.count("*").alias("_n"), F.coalesce(F.sum(value), F.lit(0)).alias("_s"))
        .withColumn("_c", _descending("_value", COARSE))
    )
    coarse = cells.groupBy("_c").agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"))
    coarse = coarse.select(  # at most 2^18 rows
        "_c",
        _sum_before("_n", "_c").alias("_n0"),
        _sum_before("_s", "_c").alias("_s0"),
        F.sum("_s").over(W.partitionBy()).alias("grand_total"),
    )
    down = F.col("_value").desc_nulls_last()
    here = W.partitionBy("_c").orderBy(down, "_kb").rowsBetween(W.unboundedPreceding, -1)
    group = W.partitionBy("_c").orderBy(down).rangeBetween(W.unboundedPreceding, 0)
    before = lambda c, window: F.coalesce(F.sum(c).over(window), F.lit(0))
    inside = cells.select(
        "_value", "_kb", "_c", before("_n", here).alias("_n1"), before("_s", here).alias("_s1"), before("_s", group).alias("_s2")
    )
    return inside.join(coarse, "_c").select(
        "_value",
        "_kb",
        (F.col("_n0") + F.col("_n1")).alias("_rows_before"),
        (F.col("_s0") + F.col("_s1")).alias("_sum_before"),
        (F.col("_s0") + F.col("_s2")).alias("_sum_upto"),
        "grand_total",
    )


def _numbered(df: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """Number the rows of each group 1..k by a 64-bit key that is unique in the table.

    All joins take NULL for equal, so that no filter is derived for one use of ``df`` and not for
    another: Spark then reads it once for all of them.
    """
    cut = df.withColumns(
        {
            "_kc": F.shiftright(F.col(key).cast("bigint"), COARSE_BITS),
            "_kf": F.shiftright(F.col(key).cast("bigint"), FINE_BITS),
        }
    )
    fine = cut.groupBy(F.col(group).alias("_g"), "_kc", "_kf").agg(F.count("*").alias("_n"))
    coarse = fine.groupBy("_g", "_kc").agg(F.sum("_n").alias("_n"))
    coarse = coarse.select("_g", "_kc", _sum_before("_n", "_kc", "_g").alias("_b0"))
    fine = fine.withColumn("_b1", _sum_before("_n", "_kf", "_g", "_kc"))
    blocks = fine.join(
        coarse.withColumnsRenamed({"_g": "_gc", "_kc": "_kcc"}),
        F.col("_g").eqNullSafe(F.col("_gc")) & F.col("_kc").eqNullSafe(F.col("_kcc")),
    ).select("_g", F.col("_kf").alias("_kb"), (F.col("_b0") + F.col("_b1")).alias("_before"))
    inside = F.row_number().over(W.partitionBy(group, "_kf").orderBy(key))
    return (
        cut.withColumn("_inside", inside)
        .join(blocks, F.col(group).eqNullSafe(F.col("_g")) & F.col("_kf").eqNullSafe(F.col("_kb")))
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_kc", "_kf", "_inside", "_g", "_kb", "_before")
    )


def running_totals(
    df: DataFrame, value: str, tiebreak: str, *, ties: str, position: bool = False
) -> DataFrame:
    """Add ``running`` and ``grand_total`` over ``value`` descending, and ``position`` if asked.

    ``ties="share"``: equal values get the same running total.
    ``ties="split"``: each row adds its own value, ``tiebreak`` deciding.
    ``position`` is 1..n by value, then ``tiebreak``: an integer, unique in the table.
    NULL values come last and add nothing. Money should be DECIMAL, which sums exactly.
    """
    if ties not in ("share", "split"):
        raise ValueError(ties)
    numbered = position or ties == "split"
    rows = df
    if numbered:
        block = F.shiftright(F.col(tiebreak).cast("bigint"), FINE_BITS)
        inside = F.row_number().over(W.partitionBy(value, "_block").orderBy(tiebreak))
        rows = df.withColumn("_block", block).withColumn("_pos", inside)
    match = F.col(value).eqNullSafe(F.col("_value"))
    if numbered:
        match &= F.col("_block").eqNullSafe(F.col("_kb"))
    joined = rows.join(_cells(df, value, tiebreak if numbered else None), match)
    if ties == "share":
        running = F.col("_sum_upto")
    else:
        place = F.col("_pos").cast("decimal(12,0)") if "decimal" in dict(df.dtypes)[value] else F.col("_pos")
        running = F.col("_sum_before") + F.coalesce(place * F.col(value), F.lit(0))
    out = joined.withColumn("running", running)
    if position:
        out = out.withColumn("position", (F.col("_rows_before") + F.col("_pos")).cast("int"))
    return out.select(*df.columns, "running", "grand_total", *(["position"] if position else []))


def number_within(df: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """Number the rows of each group 1..k by an integer ``key``, unique in the table.

    No window partition grows with a group: it is cut into blocks of keys, and the blocks are
    offset by the row counts of the blocks before them.
    """
    return _numbered(df, group, key, name).withColumn(name, F.col(name).cast("int"))
