"""Periodic runs against all periods at all places."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from stocklens.llm import periodic_runs as p


def runs_by_hand(words, min_words=6, power=4):
    out = []
    for q in range(1, len(words) // power + 1):
        at = 0
        while at + q < len(words):
            end = at
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            start, length = at, end - at + q
            shorter = any(a <= start and start + length <= a + n and q % c == 0 and c < q for a, n, c in out)
            if end > at and length >= max(min_words, power * q) and not shorter:
                out.append((start, length, q))
            at = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted_by_hand(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        q = 1 + (n - a) // (3 + g % 8)
        words = [words[a + (i - a) % q] if i >= a else w for i, w in enumerate(words)]
    return words


def row_by_hand(doc_id, text):
    words = planted_by_hand(doc_id, text)
    runs = runs_by_hand(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = 1000 * best[1] // best[2] if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(runs), *best, milli, sha(lines), sha(kept))


def query(docs):
    return [tuple(r) for r in p.summary(p.detect(p.with_planted_periods(docs))).collect()]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=50))
def test_all_runs_of_small_alphabets(words):
    assert p.runs_of(words) == runs_by_hand(words)
    assert p.runs_of(words, 2, 2) == runs_by_hand(words, 2, 2)
    text = " ".join(map(str, words))
    (_, first), (_, none), (_, last) = p.document_runs([text, "", text + " " + text])
    assert first == runs_by_hand(words) and none == [] and last == runs_by_hand(words * 2)


def test_extensions_by_brute_force():
    import numpy as np

    rng = random.Random(8)
    for n in (2, 5, 40, 300):
        words = [rng.randrange(2) if n > 40 else rng.randrange(3) for _ in range(n)]
        tree = p.SuffixTree(words)
        tree.tour()
        pairs = [(a, b) for a in range(n) for b in range(n) if a != b]
        rng.shuffle(pairs)
        a, b = map(np.array, zip(*pairs[:5000]))
        for x, y, k in zip(a.tolist(), b.tolist(), tree.common(a, b).tolist()):
            assert words[x : x + k] == words[y : y + k]
            assert max(x, y) + k == n or words[x + k] != words[y + k]
        assert tree.ranks()[:-1] == [sorted(words[k:] for k in range(n)).index(words[k:]) + 1 for k in range(n)]


def test_query_by_brute_force(make_docs, corpus):
    rng = random.Random(9)
    rows = [r[:2] for r in corpus]
    for k in range(1000, 1400):
        unit = [rng.choice("abc") for _ in range(rng.randint(1, 7))]
        words = [rng.choice("abcdef") for _ in range(rng.randint(0, 30))]
        rows.append((k, " ".join(words + unit * rng.randint(1, 9) + unit[:2] + words[:3])))
    got = query(make_docs(rows).repartition(3))
    assert sorted(got) == sorted(row_by_hand(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 100 and any(r[1] > 1 for r in got)


def test_odd_rows(spark, make_docs):
    long = "z " * 5000 + "one two three " * 20000 + " ".join(map(str, range(60000)))
    planted = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 10 == 0)
    rows = [(1, None), (1, ""), (None, "a a a a a a a"), (planted, " \n"), (planted, "x"), (planted, "x y z " * 9), (planted, "x y z " * 9), (3, "a b " * 8)]
    assert sorted(query(make_docs(rows)), key=str) == sorted((row_by_hand(*r) for r in rows), key=str)
    (row,) = query(make_docs([(2, long)]))
    assert row[1:5] == (2, 5000, 60000, 3)
    assert query(make_docs([])) == []
    extra = spark.createDataFrame([(4, "b b b b b b", 1, 2)], "doc_id int, text string, runs int, collapsed int")
    assert query(extra)[0][:5] == (4, 1, 0, 6, 1)


def test_one_word_repeated_without_end():
    (words, runs), = p.document_runs(["w " * 200_000])
    assert runs == [(0, 200_000, 1)] and p.collapsed(words, runs) == ["w"]
