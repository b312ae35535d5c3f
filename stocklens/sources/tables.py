"""Reading the domain tables and writing results."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DataType,
    DateType,
    IntegralType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from stocklens.sources.schemas import OPERATIONAL

#: How many times the size of its Parquet files a table takes in memory. Dictionaries keep keys and
#: repeated texts in few bytes: a product of 150 bytes is 4 to 9 in a file.
FILE_GROWTH = 64


def estimate_rows_not_files(spark: SparkSession) -> None:
    """Let joins be planned by what tables take in memory, unless the session sets a factor itself.

    By the size of their files, tables of millions of rows would be sent whole to the driver and
    to each executor. What is small after all, adaptive execution finds in the sizes it measures.
    """
    factor = "spark.sql.sources.fileCompressionFactor"
    if spark.conf.get(factor, None) is None:
        spark.conf.set(factor, str(float(FILE_GROWTH)))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What a write or a collected result moves between tasks is deleted as soon as it ends.

    Otherwise it stays until the driver's garbage collection finds it, and a job of several writes
    holds what all of them moved. Nothing reads it later: each write plans its own moves. Only for
    frames that are not run again, as these would have to move their rows anew; a frame that is
    collected must be made inside, since it holds the setting of its making.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


@dataclass(frozen=True)
class Source:
    """A table that can be read a few columns at a time."""

    columns: tuple[str, ...]
    load: Callable[[Sequence[str]], DataFrame]
    #: The key by which the rows are stored in buckets, if they are.
    by: str | None = None

    @classmethod
    def of(cls, df: DataFrame, by: str | None = None) -> Source:
        return cls(tuple(df.columns), lambda wanted: df.select(*wanted), by)


class Tables:
    """Domain tables by name.

    ``t("products", "product_id", "sku")`` is a lazy frame of just those columns, so each
    operator states what it reads and a source can leave out joins nobody asked for.
    """

    def __init__(self, sources: dict[str, Source]):
        self._sources = dict(sources)

    def _source(self, name: str) -> Source:
        if name not in self._sources:
            raise KeyError(f"table {name!r} is not available; have {sorted(self._sources)}")
        return self._sources[name]

    def __call__(self, name: str, *columns: str) -> DataFrame:
        source = self._source(name)
        return source.load(columns or source.columns)

    def __contains__(self, name: str) -> bool:
        return name in self._sources

    def names(self) -> list[str]:
        return list(self._sources)

    def columns(self, name: str) -> tuple[str, ...]:
        return self._source(name).columns

    @classmethod
    def of(cls, **frames: DataFrame) -> Tables:
        """Tables over frames already at hand, generated columns added."""
        return cls({n: Source.of(with_generated(n, df)) for n, df in frames.items()})

    def stored_by(self, name: str) -> str | None:
        return self._source(name).by

    def overlaid(self, other: Tables) -> Tables:
        """These tables, with those of ``other`` in place of their own."""
        return Tables({**self._sources, **other._sources})

    def replaced(self, **frames: DataFrame) -> Tables:
        return Tables({**self._sources, **{n: Source.of(df) for n, df in frames.items()}})


def with_generated(name: str, df: DataFrame) -> DataFrame:
    """Add the columns the data model declares as computed, where they are missing."""
    have = set(df.columns)
    if name == "sales_order_items" and "line_total" not in have:
        net = (
            F.col("quantity_ordered").cast("decimal(10,0)")
            * F.col("unit_price")
            * (F.lit(100).cast("decimal(3,0)") - F.coalesce(F.col("discount_percent"), F.lit(0).cast("decimal(5,2)")))
            * F.lit("0.01").cast("decimal(2,2)")
        )
        df = df.withColumn("line_total", F.round(net, 2).cast("decimal(14,2)"))
    elif name == "purchase_order_items" and "line_total" not in have:
        df = df.withColumn(
            "line_total",
            (F.col("quantity_ordered").cast("decimal(10,0)") * F.col("unit_cost")).cast("decimal(14,2)"),
        )
    elif name == "inventory" and "quantity_available" not in have:
        df = df.withColumn("quantity_available", F.col("quantity_on_hand") - F.col("quantity_reserved"))
    elif name == "product_categories" and dict(df.dtypes).get("parent_category_id") == "double":
        df = df.withColumn("parent_category_id", F.col("parent_category_id").cast("int"))
    return df


#: Columns that hold a CSV row as it stands in the file, and why it does not fit.
RECORD, REASONS = "_record", "_reasons"


def _csv_columns(spark: SparkSession, path: str, declared: StructType) -> list[str]:
    """The columns that the header names, among them all the declared ones."""
    named = spark.read.option("header", True).csv(path).columns
    unknown = [f.name for f in declared if f.name not in named]
    if unknown:
        raise ValueError(f"{path} lacks the columns {unknown}")
    return named


def _typed(name: str, kind: DataType) -> Column:
    """A text as its declared type, NULL where it is not of that type."""
    text = F.trim(F.col(f"`{name}`"))
    if isinstance(kind, BooleanType):
        return F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")
    typed = text.try_cast(kind)
    if isinstance(kind, (DateType, TimestampNTZType)):
        return F.when(text.rlike(r"^\d{4}-\d\d-\d\d"), typed)
    return typed


def _checked_csv(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of a CSV file as typed columns, the record, and the reasons why it does not fit."""
    declared, path = OPERATIONAL[name], f"{folder}/{name}.csv"
    named = _csv_columns(spark, path, declared)
    texts = StructType([*[StructField(c, StringType()) for c in named], StructField(RECORD, StringType())])
    reader = spark.read.schema(texts).option("header", True).option("mode", "PERMISSIVE")
    raw = reader.option("columnNameOfCorruptRecord", RECORD).csv(path)
    # Spark keeps the record only of a row that has too few or too many values.
    torn = F.when(F.col(RECORD).isNotNull(), F.lit(f"not {len(named)} values"))
    faults = [
        F.when(F.col(f"`{f.name}`").isNotNull() & _typed(f.name, f.dataType).isNull(), F.lit(f"{f.name}: no {f.dataType.simpleString()}"))
        for f in declared
        if not isinstance(f.dataType, StringType)
    ]
    reasons = F.when(torn.isNotNull(), F.array(torn)).otherwise(F.array_compact(F.array(*faults)))
    values = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in named])
    typed = [
        F.col(f"`{f.name}`") if isinstance(f.dataType, StringType) else _typed(f.name, f.dataType) for f in declared
    ]
    return raw.select(
        *[c.alias(f.name) for c, f in zip(typed, declared, strict=True)],
        F.coalesce(RECORD, values).alias(RECORD),
        reasons.alias(REASONS),
    )


def read_rejects(spark: SparkSession, folder: str, names: Iterable[str] | None = None) -> DataFrame:
    """(table_name, record, reasons) of the CSV rows that :func:`read_table` leaves out with ``bad="skip"``."""
    out = spark.createDataFrame([], "table_name string, record string, reasons array<string>")
    for name in names or OPERATIONAL:
        try:
            rows = _checked_csv(spark, folder, name).where(F.size(REASONS) > 0)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        out = out.unionByName(
            rows.select(F.lit(name).alias("table_name"), F.col(RECORD).alias("record"), F.col(REASONS).alias("reasons"))
        )
    return out


def _kind(declared: DataType, found: DataType) -> DataType:
    """The type of a Parquet column: as declared, but keys and counts may be wider, and keys texts."""
    if isinstance(declared, IntegralType) and isinstance(found, (IntegralType, StringType)):
        return found
    return declared


def read_table(spark: SparkSession, folder: str, name: str, fmt: str = "csv", bad: str = "fail") -> DataFrame:
    """One operational table with its declared types: CSV with a header, or Parquet.

    CSV columns are taken by their names in the header, whatever their order; a declared column
    that the header lacks fails. A row with a value that does not fit its type, or with too few or
    too many values, fails the query, or is left out with ``bad="skip"``; :func:`read_rejects` has
    those rows with their reasons.
    """
    if name not in OPERATIONAL:
        raise KeyError(f"unknown table {name!r}")
    if bad not in ("fail", "skip"):
        raise ValueError(bad)
    declared = OPERATIONAL[name]
    if fmt == "csv" and bad == "skip":
        rows = _checked_csv(spark, folder, name).where(F.size(REASONS) == 0)
        return with_generated(name, rows.select(declared.names))
    if fmt == "csv":
        path = f"{folder}/{name}.csv"
        by_name = {f.name: f for f in declared}
        fields = [by_name.get(c, StructField(c, StringType())) for c in _csv_columns(spark, path, declared)]
        raw = spark.read.schema(StructType(fields)).option("header", True).option("mode", "FAILFAST").csv(path)
        return with_generated(name, raw.select(declared.names))
    raw = spark.read.format(fmt).load(f"{folder}/{name}.{fmt}")
    have = {f.name: f.dataType for f in raw.schema}
    typed = [F.col(f.name).cast(_kind(f.dataType, have[f.name])).alias(f.name) for f in declared if f.name in have]
    further = [c for c in raw.columns if c not in declared.names]
    return with_generated(name, raw.select(*typed, *further))


def open_tables(
    spark: SparkSession, folder: str, fmt: str = "csv", names: Iterable[str] | None = None, bad: str = "fail"
) -> Tables:
    """All operational tables present in ``folder``; absent ones are left out."""
    estimate_rows_not_files(spark)
    sources: dict[str, Source] = {}
    for name in names or OPERATIONAL:
        try:
            sources[name] = Source.of(read_table(spark, folder, name, fmt, bad))
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return Tables(sources)


def write_extract(df: DataFrame, path: str, fmt: str = "parquet", drop: Iterable[str] = ()) -> str:
    """Write a result as a folder of part files, leaving out internal columns."""
    writer = df.drop(*drop).write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    elif fmt == "parquet":
        writer = writer.option("compression", "zstd")
    with freed_shuffles(df.sparkSession):
        writer.format(fmt).save(path)
    return path


def kept(df: DataFrame, path: str) -> DataFrame:
    """``df`` as written to ``path``: what it moved is gone before what is made of it moves."""
    return df.sparkSession.read.schema(df.schema).parquet(write_extract(df, path))


def insert_into(df: DataFrame, table: str, partition_by: Iterable[str] = ()) -> None:
    """Append rows to a catalogue table, creating it on first use."""
    spark = df.sparkSession
    with freed_shuffles(spark):
        if spark.catalog.tableExists(table):
            df.select(spark.table(table).columns).write.mode("append").insertInto(table)
        else:
            df.write.mode("append").format("parquet").partitionBy(*partition_by).saveAsTable(table)


def register_views(frames: dict[str, DataFrame]) -> None:
    for name, df in frames.items():
        df.createOrReplaceTempView(name)
