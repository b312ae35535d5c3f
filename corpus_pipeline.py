"""The corpus pipeline: from raw documents to packed training sequences.

Five stages, each on all that the one before it kept: documents in no learnt language go, repeated
lines go, one document of each group of near copies stays, documents that hold a benchmark item go,
and the rest is packed into sequences. Each stage's result is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocklens.llm import decontaminate, language, line_dedup, near_dup, packing
from stocklens.llm.common import read, stored

#: A floor only, texts without letters score 0: what is in no learnt language goes by its evidence.
MIN_LANGUAGE_SCORE = 0.3
TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.train(docs), MIN_LANGUAGE_SCORE)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.keep_one(docs)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language ID", language_id),
    ("line dedup", repeated_lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_items),
    ("best-fit packing", packed_sequences),
]

#: SQL has no tokenizer and no trained kernels; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
