"""Document fingerprints against plain sets of paragraphs and a plain order of documents."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from stocklens.llm import fingerprints as f


def like(a, b):
    a, b = set(f.digests(a).tolist()), set(f.digests(b).tolist())
    return 1 - len(a ^ b) / (len(a) + len(b)) if a or b else 1.0


def by_hand(rows):
    """{doc_id: [(n_chars, sha, near_edited, near_next)]} of (doc_id, text) rows."""
    order = sorted(((i is None, i or 0, x or "") for i, x, *_ in rows))
    out = {}
    for k, (null, i, text) in enumerate(order):
        following = order[(k + 1) % len(order)][2]
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        row = (len(text), hashlib.sha256(new.encode()).hexdigest(), like(text, new), like(text, following))
        out.setdefault(None if null else i, []).append(row)
    return {k: sorted(v) for k, v in out.items()}


def got(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256, r.near_edited, r.near_next))
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize("stretch", [3, 40, 10**6])
def test_by_brute_force(make_docs, corpus, monkeypatch, stretch):
    monkeypatch.setattr(f, "STRETCH", stretch)
    docs = make_docs(corpus).repartition(5)
    assert got(f.edited_fingerprints(docs)) == by_hand(corpus)


@pytest.mark.parametrize("stretch", [2, 10**6])
def test_odd_rows(make_docs, monkeypatch, stretch):
    monkeypatch.setattr(f, "STRETCH", stretch)
    long = "A sentence of the very long text. " * 30000 + "\n".join(map(str, range(20000)))
    rows = [(5, "Repeated. Repeated. Once."), (5, "Repeated. Repeated. Once."), (5, None), (None, "No id.\nAt all."), (None, ""),
            (-7, long), (9, ""), (2, "é\U0001f600 ü"), (3, "x"), (2**62, "Far away."), (8, " \n\t")]
    assert got(f.edited_fingerprints(make_docs(rows))) == by_hand(rows)


def test_empty_single_and_extra_columns(spark, make_docs):
    assert f.edited_fingerprints(make_docs([])).count() == 0
    row = f.edited_fingerprints(make_docs([(1, "ab")])).first()  # its own successor
    assert (row.n_chars, row.near_next) == (2, 1.0) and row.edited_sha256 == hashlib.sha256(b"aa").hexdigest()
    clash = spark.createDataFrame([(1, "a b", 7, True), (2, "c d", 8, False)], "doc_id int, text string, stretch int, lent boolean")
    assert sorted(r.doc_id for r in f.edited_fingerprints(clash).collect()) == [1, 2]


def test_equal_texts_have_equal_fingerprints(make_docs, corpus):
    rows = {r.doc_id: r for r in f.edited_fingerprints(make_docs(corpus)).collect()}
    plain = {r.doc_id: r.fingerprint for r in f.fingerprint(make_docs(corpus)).collect()}
    texts = {}
    for i, text, *_ in corpus:
        assert plain[i] == rows[i].fingerprint
        assert texts.setdefault(text or "", plain[i]) == plain[i]
    assert len(set(plain.values())) > 150


def test_fingerprints_alone_tell_small_differences():
    rng = random.Random(2)
    text = [" ".join(rng.choices("abcdefgh", k=5)) + "." for _ in range(300)]
    other = list(dict.fromkeys(text[:100] + ["new one.", "new two."] + text[103:]))
    text = list(dict.fromkeys(text))
    (n, a), (m, b) = (f.table_of(f.Tables.of([f.digests("\n".join(x))], f.CELLS).texts([len(x)])[0]) for x in (text, other))
    done, found = a.minus(b).peel()
    keys = {(int(k), int(s)) for _, ks, ss in found for k, s in zip(ks, ss)}
    one = lambda x: int(f.digests(x)[0])
    want = {(one(x), 1) for x in set(text) - set(other)} | {(one(x), -1) for x in set(other) - set(text)}
    assert done.all() and keys == want and (n, m) == (len(text), len(other))


def test_retries_recover_any_difference():
    rng = np.random.default_rng(4)
    for _ in range(40):
        pool = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        sizes = rng.integers(0, 3000, 6)
        a = [np.unique(rng.choice(pool, n)) for n in sizes[:3]]
        b = [np.unique(rng.choice(pool, n)) for n in sizes[3:]]
        for x, y, (left, right) in zip(a, b, f.differences(a, b)):
            assert set(left.tolist()) == set(x.tolist()) - set(y.tolist())
            assert set(right.tolist()) == set(y.tolist()) - set(x.tolist())


def test_versions_name_their_own_paragraphs(spark):
    pairs = spark.createDataFrame(
        [(1, "Kept here. Old one. Kept there.", "Kept here. Kept there. New one. New one."), (2, None, ""), (3, "a", None)],
        "doc_id long, old string, new string",
    )
    rows = {r.doc_id: r for r in f.compare_versions(pairs).collect()}
    assert (rows[1].removed, rows[1].added) == (["Old one."], ["New one.", "New one."])
    assert rows[1].likeness == 1 - 3 / 7 and rows[2].likeness == 1 and rows[3].removed == ["a"]
