"""The stages on a small corpus, and the registered queries against their SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

import corpus_pipeline
from stocklens.llm.common import read, stored
from stocklens.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


def test_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert set(QUERIES) <= set(names) and "pipeline" in names
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    cursor = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    want = sorted(cursor.fetchall())
    found = sorted(tuple(r) for r in got.select(*names).collect())
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert all(math.isclose(x, y) if isinstance(x, float) else x == y for x, y in zip(a, b, strict=True))


def test_stages(spark):
    docs = first = read(spark, DATA, "documents")
    kept = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, DATA))
        assert docs.dtypes == first.dtypes
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0]
    assert docs.where("n_chars != length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.count()


def test_odd_documents(spark, make_docs, corpus):
    docs = make_docs([*corpus, (500, None), (None, "the of and to in that"), (1, corpus[1][1])])
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, DATA))
        assert stage(spark, before.limit(0), DATA).count() == 0
    assert docs.where("sequence_id is null").count() == 0
