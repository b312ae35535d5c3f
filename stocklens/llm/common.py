"""Helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word and line rules: blank, and code points 9 to 13.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def find_package(spark: SparkSession) -> None:
    """Let workers that start on this machine import the package from where the driver has it.

    On a cluster the package is installed or sent with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Rows that a Python worker gets at a time: a batch lies in memory on both sides, as texts and as objects.
ROWS_AT_A_TIME = 1000


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose rows go to Python some at a time, unless the session sets how many itself."""
    spark, rows = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(rows, None) is None:
        spark.conf.set(rows, str(ROWS_AT_A_TIME))
    return df


def _shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names.

    On a cluster it has to be named, since a local one would be lost with its executor; a local
    session without one gets a temporary folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, without its lineage."""
    _shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the shared folder: joins know its size from its files."""
    path = f"{_shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, also where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def schema_of(docs: DataFrame, *names: str) -> str:
    """DDL of the named columns with their own types."""
    kinds = dict(docs.dtypes)
    return ", ".join(f"{name} {kinds[name]}" for name in names)
