"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import pytest
from compare import compare, connect

from suite.core import load_all

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(load_all()))
def test_query(spark, db, name):
    assert compare(spark, db, FOLDER, load_all()[name]) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns[0] == "abc_class"
    assert set(e.oracle_sql()) <= set(e.queries())
