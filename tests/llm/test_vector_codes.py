"""Vector codes against plain k-means on integers."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import pytest

from stocklens.llm import queries
from stocklens.llm import vector_codes as v

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, parts=8, entries=16, rounds=6):
    """Sorted (vec_id, code, error, label_error, sha) of (vec_id, vector, label) rows of one length."""
    kept = [(i, [math.floor(4096 * x) for x in e], lab) for i, e, lab in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    d = len(kept[0][1])
    cuts = [(d * k // parts, d * (k + 1) // parts) for k in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][a:b] for r in first] for a, b in cuts]
    far = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y))

    def near(x, p):
        return min((far(x[cuts[p][0] : cuts[p][1]], entry), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        held = [[[] for _ in book] for book in books]
        for _, x, _ in kept:
            for p in range(parts):
                held[p][near(x, p)[1]].append(x[cuts[p][0] : cuts[p][1]])
        books = [[[sum(c) // len(own) for c in zip(*own)] if own else old for own, old in zip(held[p], books[p])] for p in range(parts)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(i, [near(x, p) for p in range(parts)], lab) for i, x, lab in kept]
    total = {}
    for _, found, lab in out:
        total[lab] = total.get(lab, 0) + sum(f for f, _ in found)
    return sorted(((i, "".join(f"{e:02x}" for _, e in found), sum(f for f, _ in found), total[lab], sha) for i, found, lab in out), key=str)


def got(spark, rows, schema=SCHEMA):
    return sorted(map(tuple, v.compress(spark.createDataFrame(rows, schema)).collect()), key=str)


def vectors(rng, n, d, spread=1.0):
    import numpy as np

    return [(k, [float(np.float32(rng.gauss(0, spread))) for _ in range(d)], rng.choice([None, 0, 0, 0, 1])) for k in range(n)]


@pytest.mark.parametrize(("n", "d", "spread"), [(300, 16, 0.2), (40, 64, 1.0), (7, 10, 1.0), (60, 5, 3e4), (30, 8, 1e13)])
def test_by_brute_force(spark, n, d, spread):
    rows = vectors(random.Random(n), n, d, spread)
    if spread < 1e13:
        assert got(spark, rows) == by_hand(rows)
    else:  # errors exceed 64 bits; codes and entries are exact all the same
        assert [(r[0], r[1], r[4]) for r in got(spark, rows)] == [(r[0], r[1], r[4]) for r in by_hand(rows)]
        assert any(r[2] is None for r in got(spark, rows))


def test_odd_vectors(spark):
    rng = random.Random(3)
    rows = vectors(rng, 50, 8)
    rows += [(100, None, 1), (101, [float("nan")] * 8, 1), (102, [None] + [1.0] * 7, 1), (103, [float("inf")] * 8, 0), (104, [], 0)]
    rows += [(5, rows[5][1], 1), (5, rows[6][1], 1), (None, rows[7][1], None), (60, rows[8][1], 1), (61, rows[8][1], 1)]
    assert got(spark, rows) == by_hand(rows)
    uneven = [*rows, (200, [1.0] * 9, 1), (201, [1.0], 1)]  # of another length than most
    assert got(spark, uneven) == by_hand(rows)
    assert got(spark, []) == [] and got(spark, [(1, None, 2)]) == []
    clash = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA + ", dimensions int, code string")
    assert sorted(map(tuple, v.compress(clash).collect()), key=str) == by_hand(rows)


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = vectors(random.Random(6), 200, 24)
    monkeypatch.setattr(v, "BLOCK", 7)
    df = spark.createDataFrame(rows[::-1], SCHEMA).repartition(6)
    assert sorted(map(tuple, v.compress(df).collect()), key=str) == by_hand(rows)


def test_decoded_vectors_lie_as_far_as_the_error_says(spark):
    rows = vectors(random.Random(1), 120, 20, 0.3)
    df = spark.createDataFrame(rows, SCHEMA)
    found = v.stored(v.blocks(df))
    books = v.train(df, found)
    for r in v.decode(v.encode(found, books), books).collect():
        ints = [math.floor(4096 * x) for x in rows[r.vec_id][1]]
        near = [math.floor(4096 * x) for x in r.approximation]
        assert sum((a - b) ** 2 for a, b in zip(ints, near)) == r.error


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    found = queries.op13_vector_codes(spark, folder)
    cursor = db.execute(queries.ORACLE_SQL["op13_vector_codes"])
    assert [c[0] for c in cursor.description] == found.columns
    assert sorted(cursor.fetchall()) == sorted(map(tuple, found.collect()))
