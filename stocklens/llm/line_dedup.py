"""Line dedup: drop long lines that many documents hold.

Lines are exploded, normalised to a key and hashed to 128 bits. Keys in ``min_docs`` documents or
more lose all their lines except in the largest doc_id that holds them; what is left is joined
again in order. Only hashes and ids are shuffled until the last join, and a hot key is counted
per (key, document) first, so no task gets all of it.

Null or empty text is one empty line. Rows that repeat a doc_id are one document, each with all
its lines. A row without doc_id counts for nothing and stays whole. An empty table gives an empty
table. Other columns pass; ``text`` is replaced, and columns named ``n_lines`` and ``n_dropped``
are set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.common import SPACE, lower_ascii

MIN_CHARS, MIN_DOCS = 40, 5


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def _digest(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(F.lit(1), key).alias("_h2")]


def repeated_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(doc_id, _h1, _h2): the keys whose lines the document loses."""
    lines = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        "doc_id", F.explode(F.split("text", "\n", -1)).alias("_line")
    )
    keys = lines.select("doc_id", line_key(F.col("_line")).alias("_key"))
    keys = keys.where(F.length("_key") >= min_chars).select("doc_id", *_digest(F.col("_key")))
    held = keys.distinct()
    frequent = (
        held.groupBy("_h1", "_h2")
        .agg(F.count("*").alias("_n"), F.max("doc_id").alias("_last"))
        .where(F.col("_n") >= min_docs)
    )
    return (
        held.join(frequent, ["_h1", "_h2"])
        .where(F.col("doc_id") != F.col("_last"))
        .select("doc_id", "_h1", "_h2")
    )


def dedup_lines(
    docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``docs`` with repeated lines dropped from ``text``, and ``n_lines`` and ``n_dropped``."""
    lost = (
        repeated_lines(docs, min_chars, min_docs)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("_h1", "_h2")).alias("_lost"))
    )
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)

    def stays(line: Column) -> Column:
        key = line_key(line)
        found = F.array_contains(F.col("_lost"), F.struct(*_digest(key)))
        return ~((F.length(key) >= min_chars) & found)

    plain = F.struct(
        F.coalesce("text", F.lit("")).alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        F.lit(0).cast("long").alias("n_dropped"),
    )
    kept = F.filter(lines, stays)
    cut = F.struct(
        F.array_join("_kept", "\n").alias("text"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size("_kept")).cast("long").alias("n_dropped"),
    )
    out = docs.join(lost, "doc_id", "left").withColumn(
        "_kept", F.when(F.col("_lost").isNotNull(), kept)
    )
    out = out.withColumn("_out", F.when(F.col("_lost").isNull(), plain).otherwise(cut))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(
        *[F.col("_out.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
        "_out.n_lines",
        "_out.n_dropped",
    )
