"""Running totals and numbering against a plain loop, at one form for every size."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from stocklens.functions.running import number_within, running_totals


def _expected(rows, ties):
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    total = sum(v or 0 for _, v in order)
    out, acc = {}, 0
    for position, (i, v) in enumerate(order, 1):
        acc += v or 0
        shared = total if v is None else sum(x for _, x in order if x is not None and x >= v)
        out[i] = (shared if ties == "share" else acc, total, position)
    return out


def _cases():
    rng = random.Random(5)
    return {
        "spread": [(i, rng.randrange(10_000)) for i in range(2000)],
        "hot value": [(i, 50 if i % 3 == 0 else rng.randrange(100)) for i in range(2000)],
        "one value": [(i, 7) for i in range(500)],
        "one value, sparse keys": [(i * (1 << 45) - (1 << 62), 7) for i in range(200)],
        "negative and zero": [(i, rng.randrange(-50, 50)) for i in range(500)],
        "nulls": [(i, None if i % 2 else rng.randrange(20)) for i in range(400)],
        "only nulls": [(i, None) for i in range(20)],
        "single row": [(0, 5)],
        "no rows": [],
    }


@pytest.mark.parametrize("kind", ["bigint", "decimal(24,2)"])
@pytest.mark.parametrize("ties", ["share", "split"])
@pytest.mark.parametrize("case", list(_cases()))
def test_running_totals(spark, case, ties, kind):
    rows = _cases()[case]
    df = spark.createDataFrame(rows, "id bigint, v bigint").repartition(5)
    df = df.select("id", F.col("v").cast(kind))
    got = running_totals(df, "v", "id", ties=ties, position=True).collect()
    assert {r.id: (r.running, r.grand_total, r.position) for r in got} == _expected(rows, ties)


def test_values_that_doubles_cannot_tell_apart(spark):
    rows = [(i, Decimal(10**17) + Decimal(i % 7) / 100) for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, v decimal(24,2)")
    got = running_totals(df, "v", "id", ties="split", position=True).collect()
    assert {r.id: (r.running, r.grand_total, r.position) for r in got} == _expected(rows, "split")


def test_doubles(spark):
    rng = random.Random(1)
    rows = [(i, rng.random() * 10 ** rng.randrange(-3, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, v double")
    got = running_totals(df, "v", "id", ties="split", position=True).collect()
    want = _expected(rows, "split")
    assert all(r.running == pytest.approx(want[r.id][0], rel=1e-12) for r in got)
    assert all(r.position == want[r.id][2] for r in got)


def test_only_buckets_meet_in_one_task(spark):
    """The one window without a partition key reads sums per coarse bucket."""
    df = spark.range(3000).select("id", (F.col("id") % 7).alias("v"))
    plan = running_totals(df, "v", "id", ties="split")._jdf.queryExecution().executedPlan().toString()
    single = [x for x in plan.split("\n") if "SinglePartition" in x]
    assert single
    lines = plan.split("\n")
    for k, line in enumerate(lines):
        if "SinglePartition" in line:
            assert "keys=[_c#" in lines[k + 1]


def test_number_within_splits_a_hot_group(spark):
    rng = random.Random(3)
    rows = [(0 if i % 3 == 0 else rng.randrange(200), i) for i in rng.sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "g bigint, serial bigint")
    got = number_within(df, "g", "serial", "number").collect()
    seen: dict[int, int] = {}
    want = {}
    for g, s in sorted(rows):
        seen[g] = seen.get(g, 0) + 1
        want[g, s] = seen[g]
    assert {(r.g, r.serial): r.number for r in got} == want
