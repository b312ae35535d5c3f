"""Orders and lines stored side by side, so that joins between them move nothing.

Orders and their lines are catalogue tables in the same number of buckets by order key, each bucket
one sorted file. A join or an aggregation by that key reads a bucket of both sides in one task,
without an exchange, in every query afterwards; the rows move once, when the tables are written.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from stocklens.sources.tables import Source, Tables, estimate_rows_not_files, freed_shuffles

#: Tables that are joined by an order's key, and that key.
BUCKET_KEYS = {
    "sales_orders": "so_id",
    "sales_order_items": "so_id",
    "purchase_orders": "po_id",
    "purchase_order_items": "po_id",
}


#: Lines that a bucket is to hold: some fifty megabytes.
LINES_PER_BUCKET = 1_000_000
LINES = ("sales_order_items", "purchase_order_items")


def buckets_for(t: Tables, least: int = 8) -> int:
    """As many buckets as the lines need, so that a bucket is the same work at any size of the tables."""
    most = max((t(name, BUCKET_KEYS[name]).count() for name in LINES if name in t), default=0)
    return max(least, -(-most // LINES_PER_BUCKET))


def save_bucketed(t: Tables, database: str, buckets: int | None = None, folder: str | None = None) -> None:
    """Write the tables of ``t`` to a catalogue database, orders and lines in ``buckets`` files each.

    A bucket is read and sorted by one task; left out, their number follows that of the lines.
    Existing tables are replaced.
    """
    spark = None
    buckets = buckets_for(t) if buckets is None else buckets
    for name in t.names():
        df = t(name)
        if spark is None:
            spark = df.sparkSession
            place = f" LOCATION '{folder}'" if folder else ""
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")
        key = BUCKET_KEYS.get(name)
        if key is None:
            writer = df.write
        else:
            # The writer's buckets are those of this partitioning, so each is written by one task.
            writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
        with freed_shuffles(spark):
            writer.mode("overwrite").format("parquet").option("compression", "zstd").saveAsTable(f"{database}.{name}")


def open_bucketed(spark: SparkSession, database: str, names: Iterable[str] | None = None) -> Tables:
    """The tables that :func:`save_bucketed` wrote."""
    estimate_rows_not_files(spark)
    names = names or [x.name for x in spark.catalog.listTables(database)]
    return Tables({name: Source.of(spark.table(f"{database}.{name}"), BUCKET_KEYS.get(name)) for name in names})
