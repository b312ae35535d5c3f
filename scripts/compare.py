"""Run registered queries on Spark and their SQL on DuckDB and compare the results.

usage: python scripts/compare.py <data folder> [query ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from suite.core import Query, load_all  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db


def _cell(x: object) -> str:
    if x is None:
        return "~"
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x)
    return str(x)


def rows_of(rows: list[tuple]) -> list[tuple[str, ...]]:
    return sorted(tuple(_cell(x) for x in r) for r in rows)


def compare(spark: SparkSession, db: duckdb.DuckDBPyConnection, folder: str, q: Query) -> str | None:
    """None when equal, else what differs."""
    got = rows_of([tuple(r) for r in q.run(spark, folder).collect()])
    if q.sql is None:
        return None if got else "no rows"
    cursor = db.execute(q.oracle())
    names = [d[0] for d in cursor.description]
    want = rows_of(cursor.fetchall())
    if names != list(q.columns):
        return f"columns {names}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{len(bad)} of {len(got)} rows differ, first: {bad[0]}" if bad else None


def main() -> int:
    folder, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(folder)
    failed = 0
    for name, q in load_all().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(spark, db, folder, q)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
