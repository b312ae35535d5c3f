"""Every overlap within the guarantee is found, and nothing else."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from stocklens.llm import decontaminate


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def by_hand(docs, items):
    out = {}
    for (d, text), (i, item) in itertools.product(docs, items):
        dw, iw = words(text), words(item)
        if not iw:
            continue
        w = min(13, len(iw))
        allowed = 0 if len(iw) < 8 else w * 2 // 13
        for lag in range(-len(iw), len(dw)):
            same = [0 <= j + lag < len(dw) and dw[j + lag] == x for j, x in enumerate(iw)]
            if max(sum(same[s : s + w]) for s in range(len(iw) - w + 1)) >= w - allowed:
                new = (sum(same), -lag)
                out[d, i] = max(out.get((d, i), new), new)
    return {k: (-b, n) for k, (n, b) in out.items()}


def test_masks_find_two_substitutions():
    for gone in itertools.combinations(range(13), 2):
        assert any(
            all(o + k not in gone for k, x in enumerate(m) if x == "1")
            for m in decontaminate.MASKS
            for o in range(13 - len(m) + 1)
        )


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    vocabulary = [f"{a}{b}" for a in "bdfgklmn" for b in ("an", "el", "ir", "ou")]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, say(rng.randint(13, 40))) for k in range(20)]
    docs = []
    for d in range(150):
        text = say(rng.randint(0, 60))
        if d % 2:
            item = list(rng.choice(items)[1])
            part = item[rng.randint(0, 5) :][: rng.randint(8, 40)]
            for at in rng.sample(range(len(part)), min(len(part), rng.randint(0, 4))):
                part[at] = "XX"
            text[len(text) // 2 : len(text) // 2] = part
        docs.append((d, rng.choice([" ", ", ", "\n", " ### "]).join(text).capitalize()))
    return docs, [(k, " ".join(w) + ".") for k, w in items]


def test_by_brute_force(spark, make_docs, case):
    docs, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(make_docs(docs), bench).collect()
    want = by_hand(docs, items)
    assert {(r["doc_id"], r["item_id"]): (r["at_word"], r["n_matched"]) for r in got} == want
    assert 40 < len(want) < 100
    kept = {r["doc_id"] for r in decontaminate.clean(make_docs(docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_short_items_by_brute_force(spark, make_docs):
    rng = random.Random(6)
    vocabulary = [a + b for a in "bdfg" for b in ("an", "el", "ir", "ou")]
    items = [(k, " ".join(rng.choices(vocabulary, k=k % 12 + 1 + (k % 3 == 0)))) for k in range(8, 68)]
    docs = []
    for d in range(200):
        item = rng.choice(items)[1].split()
        if len(item) > 6 and rng.random() < 0.8:
            for at in rng.sample(range(len(item)), rng.randint(1, 2)):
                item[at] = "XX"
        docs.append((d, " ".join(rng.choices(vocabulary, k=rng.randint(0, 6)) + item + rng.choices(vocabulary, k=rng.randint(0, 6)))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["at_word"], r["n_matched"]) for r in decontaminate.overlaps(make_docs(docs), bench).collect()}
    assert got == by_hand(docs, items)
    # Every single substitution in 8 to 12 words, and none in fewer.
    for n in range(1, 13):
        words_ = [f"w{k}" for k in range(n)]
        one = spark.createDataFrame([(1, " ".join(words_))], "item_id long, text string")
        near = [(k, " ".join(words_[:k] + ["zz"] + words_[k + 1 :])) for k in range(n)] + [(99, "a " + " ".join(words_))]
        found = {r["doc_id"] for r in decontaminate.overlaps(make_docs(near), one).collect()}
        assert found == ({k for k, _ in near} if n >= 8 else {99}), n


@pytest.mark.parametrize("common", [0, 3, 64])
def test_a_phrase_that_many_items_share(spark, make_docs, monkeypatch, common):
    monkeypatch.setattr(decontaminate, "COMMON", common)
    rng = random.Random(7)
    say = lambda n: [f"v{rng.randrange(400)}" for _ in range(n)]
    phrase = "as every one of us has always known".split()
    items = [(k, " ".join(say(k % 4) + phrase + say(9))) for k in range(30)] + [(90 + k, items) for k, items in enumerate([" ".join(phrase + say(1))] * 2)]
    docs = [(d, " ".join(say(5) + phrase + say(d % 12))) for d in range(40)]
    for d in range(40, 80):
        item = items[d % 30][1].split()
        for at in rng.sample(range(len(item)), d % 4):
            item[at] = "XX"
        docs.append((d, " ".join(say(d % 3) + item[d % 2 :])))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["at_word"], r["n_matched"]) for r in decontaminate.overlaps(make_docs(docs), bench).collect()}
    want = by_hand(docs, items)
    assert got == want and len({d for d, _ in want}) > 20


def test_a_very_long_text(spark, make_docs):
    item = " ".join(f"w{k}" for k in range(20))
    long = "filler text without end " * 60_000 + item + " and more " * 1000
    bench = spark.createDataFrame([(1, item), (2, "end")], "item_id long, text string")
    got = {(r["item_id"], r["at_word"]) for r in decontaminate.overlaps(make_docs([(1, long)]), bench).collect()}
    assert got == {(1, 240_000), (2, 3)}  # of equal places the first


def test_native(spark, make_docs, case, capsys):
    bench = spark.createDataFrame(case[1], "item_id long, text string")
    decontaminate.overlaps(make_docs(case[0]), bench).explain()
    assert "Python" not in capsys.readouterr().out


def test_edges(spark, make_docs):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    bench = spark.createDataFrame(
        [(1, item), (1, item), (2, None), (3, "?!"), (None, item)], "item_id long, text string"
    )
    docs = make_docs([(1, f"so {item} on"), (1, f"so {item} on"), (2, None), (3, ""), (None, item)])
    docs = docs.withColumn("item_id", F.lit(0)).withColumn("h", F.lit(0))
    got = decontaminate.overlaps(docs, bench).collect()
    assert [tuple(r) for r in got] == [(1, 1, 1, 14, 14, 1.0)]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["2", "3", "None"]
    assert decontaminate.overlaps(docs.limit(0), bench).count() == 0
    assert decontaminate.clean(docs, bench.limit(0)).count() == 5
