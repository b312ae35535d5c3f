"""What a Python worker holds at a time."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
import pytest

from stocklens.llm import language, near_dup, packing
from stocklens.llm.common import in_small_batches

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def unset(spark):
    before = spark.conf.get(ROWS, None)
    spark.conf.unset(ROWS)
    yield
    spark.conf.unset(ROWS) if before is None else spark.conf.set(ROWS, before)


def test_rows_go_to_python_some_at_a_time(spark, unset):
    def _sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    docs = spark.range(2500).coalesce(1)
    assert sorted(r.n for r in in_small_batches(docs).mapInArrow(_sizes, "n long").collect()) == [500, 1000, 1000]
    spark.conf.set(ROWS, "2000")  # what the session sets holds
    assert sorted(r.n for r in in_small_batches(docs).mapInArrow(_sizes, "n long").collect()) == [500, 2000]


def test_texts_go_to_python_some_at_a_time(spark, unset):
    docs = spark.createDataFrame([(1, "one two three", "en")], "doc_id long, text string, lang string")
    model = language.fit([], language.np.zeros((0, language.WIDTH), language.np.uint8))
    for made in (
        lambda: language.keep_identified(docs, model, 0.3),
        lambda: near_dup.fingerprints(docs),
        lambda: packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")),
    ):
        spark.conf.unset(ROWS)
        made()
        assert spark.conf.get(ROWS) == "1000"


def test_remembered_words_are_few():
    encode = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    for k in range(12):
        encode([" ".join(f"w{'abcdefghij'[k % 10]}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{k}" for i in range(17_576))])
    # Those at hand, and as many older ones with those of the text that went beyond.
    assert len(encode.known) + len(encode.older) < 250_000
