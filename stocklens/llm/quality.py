"""Quality rules: word rules of one text, and cross-document line frequency.

Lines are normalised (ends stripped, lower case) and hashed; distinct documents are counted per
host and line. Lines in more than ``max_docs`` documents of a host are removed. A document is
depleted when fewer than ``min_left`` words or less than ``min_share`` of its words remain, and a
depleted document is rejected, as is one that fails the word rules.

Null text has no words and fails. A null host is a host of its own. Rows that repeat a doc_id are
one document for the counts and each get a row. Rows without doc_id count for no line. An empty
table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.common import SPACE, let

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MAX_DOCS, MIN_LEFT, MIN_SHARE = 10, 10, 0.5
WORD_BREAK = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK, -1), "")


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that the text has twice or more."""

    def of_windows(windows: Column) -> Column:
        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def of_pairs(p: Column) -> Column:
            twice = F.filter(
                p,
                lambda x, k: (x["h"] == F.get(p, k - 1)["h"]).eqNullSafe(F.lit(True))
                | (x["h"] == F.get(p, k + 1)["h"]).eqNullSafe(F.lit(True)),
            )
            starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
            return let(
                starts,
                lambda s: F.aggregate(
                    F.transform(
                        s, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(s, k + 1) - x, F.lit(WINDOW)))
                    ),
                    F.lit(0),
                    lambda a, b: a + b,
                ),
            )

        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(
            let(pairs, of_pairs)
        )

    def of_hashes(h: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))),
        )
        return let(windows, of_windows)

    return F.when(F.size(words) <= WINDOW, 0).otherwise(
        let(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)
    )


def word_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_failed) of every row."""
    text = F.coalesce("text", F.lit(""))
    spoken = F.filter(
        F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0
    )
    counts = let(
        _words(text),
        lambda w: F.struct(F.size(w).alias("n_words"), _repeat_words(w).alias("n_repeat_words")),
    )
    bare = docs.select(
        "doc_id",
        counts.alias("_counts"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(spoken, lambda s: F.size(s) - F.size(F.array_distinct(s))).cast("long").alias("n_dup_lines"),
    )
    n, again = F.col("_counts.n_words"), F.col("_counts.n_repeat_words")
    return bare.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        again.cast("long").alias("n_repeat_words"),
        ((n < 20) | (100 * again.cast("long") > 30 * n.cast("long"))).alias("base_failed"),
    )


def removed_words(docs: DataFrame, max_docs: int = MAX_DOCS, host: str = "source") -> DataFrame:
    """(doc_id, removed_lines, removed_words) of the documents that hold too frequent lines."""
    lines = docs.where(F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(host).alias("_host"), F.explode(F.split("text", "\n", -1)).alias("_line")
    )
    bare = F.lower(F.btrim("_line", F.lit(SPACE)))
    lines = lines.where(F.length(F.btrim("_line", F.lit(SPACE))) > 0).select(
        "doc_id",
        F.xxhash64(F.lit(0), "_host", bare).alias("_h1"),
        F.hash("_host", bare).alias("_h2"),
        F.size(_words(F.col("_line"))).alias("_n"),
    )
    held = lines.groupBy("_h1", "_h2", "doc_id").agg(
        F.sum("_n").alias("_n"), F.count("*").alias("_lines")
    )
    frequent = (
        held.groupBy("_h1", "_h2").agg(F.count("*").alias("_docs")).where(F.col("_docs") > max_docs)
    )
    return (
        held.join(frequent, ["_h1", "_h2"])
        .groupBy("doc_id")
        .agg(F.sum("_lines").alias("removed_lines"), F.sum("_n").alias("removed_words"))
    )


def quality(
    docs: DataFrame,
    max_docs: int = MAX_DOCS,
    min_left: int = MIN_LEFT,
    min_share: float = MIN_SHARE,
    host: str = "source",
) -> DataFrame:
    """Counts, verdict of the word rules and final verdict of every row."""
    out = word_rules(docs).join(removed_words(docs, max_docs, host), "doc_id", "left")
    removed = F.coalesce("removed_words", F.lit(0)).cast("long")
    left = F.col("n_words") - removed
    fine = (left >= min_left) & (left >= min_share * F.col("n_words"))
    return out.select(
        *[c for c in out.columns if c not in ("removed_lines", "removed_words")],
        F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"),
        removed.alias("removed_words"),
        (~F.col("base_failed") & fine).alias("kept"),
    )
