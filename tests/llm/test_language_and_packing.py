"""Held-out accuracy of language ID; exact round trips and invariants of packing."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stocklens.llm import language, packing

from conftest import WORDS, sentence  # isort: skip

PATH = public_tokenizers.path("word_bpe_49k.json")
OTHER = "byte_bpe_50k.json"


def test_kernel_is_cosine_of_presence():
    a, b = np.zeros(language.WIDTH, np.float32), np.zeros(language.WIDTH, np.float32)
    language.mark("ab", a)
    language.mark("ab ab", b)
    # " ", a, b, " a", ab, "b ", " ab", "ab " and, in the second, "b a"
    assert a.sum() == 8 and b.sum() == 9 and (a * b).sum() == 8


def test_held_out_accuracy(make_docs):
    rng = random.Random(1)
    rows = [(k, sentence(rng, lang, rng.randint(8, 40)), lang) for k, lang in enumerate(list(WORDS) * 120)]
    docs = make_docs(rows)
    got = language.identify(docs, language.train(docs, per_lang=40, landmarks=30)).collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {k for k, *_ in rows if zlib.crc32(str(k).encode()) % 4 == 2}
    truth = {k: lang for k, _, lang in rows}
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_held_out_documents_change_nothing(make_docs):
    rng = random.Random(1)
    rows = [(k, sentence(rng, lang, 12), lang) for k, lang in enumerate(list(WORDS) * 20)]
    lied = [(k, t, "xx" if zlib.crc32(str(k).encode()) % 4 == 2 else x) for k, t, x in rows]
    a, b = (
        [tuple(r) for r in language.identify(make_docs(x), language.train(make_docs(x))).orderBy("doc_id").collect()]
        for x in (rows, lied)
    )
    assert a == b


def test_language_edges(make_docs):
    rows = [(k, sentence(random.Random(k), lang, 12), lang) for k, lang in enumerate(list(WORDS) * 20)]
    odd = [(900, None, "en"), (901, "", "de"), (902, "12 34 !", "en"), (None, "the of and", None), (0, rows[0][1], "en")]
    odd += [(903, "und der schön " * 20000, None)]
    docs = make_docs(rows + odd).withColumn("score", F.lit("x"))
    model = language.train(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, model).collect()}
    assert got[900] == got[901] == got[902] == ("und", 0.0)
    assert got[903][0] == "de" and got[None][0] == "en"
    kept = language.keep_identified(docs, model, 0.3)
    assert kept.columns == docs.columns and kept.where("doc_id in (900, 901, 902)").count() == 0
    assert language.identify(docs.limit(0), model).count() == 0
    nothing = language.train(docs.limit(0))
    assert {r["lang_pred"] for r in language.identify(docs, nothing).collect()} == {"und"}


def test_numbers_of_all_kinds_are_no_letters(make_docs):
    assert [language.letters(x) for x in ("½ ² ①", "Ⅷ ⅻ", "12³", "x²y½", "É1é", "ªº", None)] == ["", "", "", "x y", "é é", "ªº", ""]
    rng = random.Random(2)
    rows = [(k, sentence(rng, "en", 20), "en") for k in range(40)] + [(100, "½ ² ①", "en"), (101, "Ⅷ ⅻ", None), (102, "12³", None)]
    docs = make_docs(rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(docs, language.train(docs)).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)


FOREIGN = [
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "人人生而自由,在尊严和权利上一律平等。他们赋有理性和良心。",
    "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
    "xkcd qzrt bvnm wrtp fghj klmn bcdf ghjk zxcv qwrt plkj mnbv",
    "zq",
]


def test_only_learnt_languages_stay(make_docs):
    rng = random.Random(3)
    rows = [(k, sentence(rng, lang, rng.randint(8, 40)), lang) for k, lang in enumerate(list(WORDS) * 60)]
    weak = ["der", "the of", "pour la", "12 that 34 was !!", "AND AND AND AND", "sont été où", "für sich über"]
    weak.append(sentence(rng, "en", 20) + "\n" + sentence(rng, "de", 6))
    docs = make_docs(rows + [(1000 + k, t, None) for k, t in enumerate(FOREIGN)] + [(2000 + k, t) for k, t in enumerate(weak)])
    model = language.train(docs)
    kept = {r["doc_id"] for r in language.keep_identified(docs, model, corpus_pipeline.MIN_LANGUAGE_SCORE).collect()}
    assert kept == {k for k, *_ in rows} | {2000 + k for k in range(len(weak))}
    # A few mislabelled texts neither lower the level nor let their language in.
    lied = docs.unionByName(make_docs([(3000 + k, FOREIGN[0], "en") for k in range(2)]))
    assert min(language.train(lied).levels) > 0.5


TEXTS = [
    "Hello, world. It's 3.14, isn't it?", "a b ́x", "x\x1cy\x85z DON'T İstanbul ΑΣ ΑΣ, foo", "", "  a\t\tb\n\n",
    "<|endoftext|> a<|startoftext|>b", "Ärger, ÀÉ. x_. y., 1.5. a.. b ..", "Σ. J̌, Á.", "xy  z",
    "\U00010000", "日本語 text, 日本.", "é. É,", "word" * 3000,
]


def test_ids_are_the_tokenizers():
    tokenizer = Tokenizer.from_file(PATH)
    encode = packing.Encoder(PATH)
    got = encode(TEXTS)
    again = packing.Encoder(PATH)
    for text, ids in zip(TEXTS, got, strict=True):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert again([text])[0].tolist() == ids.tolist()


def test_ids_of_odd_words_and_a_small_memory(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 50)
    tokenizer = Tokenizer.from_file(PATH)
    encode = packing.Encoder(PATH)
    assert encode.by_words
    rng = random.Random(1)
    letters = "abé'sSTx.,!_-09 \n\t²İßœ́漢я|<>"
    for _ in range(40):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(50)]
        for text, ids in zip(texts, encode(texts), strict=True):
            assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_words_are_looked_up_once_and_remembered_without_their_signs():
    encode = packing.Encoder(PATH)
    learnt, learn = [], encode._learn_runs
    encode._learn_runs = lambda runs: (learnt.extend(runs), learn(runs))
    texts = ["stone stone, river. stone;\nriver: stone! river?", "River, STONE. stone"] * 3
    tokenizer = Tokenizer.from_file(PATH)
    for text, ids in [*zip(texts, encode(texts)), *zip(texts, encode(texts))]:
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
    assert sorted(learnt) == sorted(encode.known) == ["river", "stone"]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path(OTHER)
    tokenizer = Tokenizer.from_file(path)
    encode = packing.Encoder(path)
    for text, ids in zip(TEXTS, encode(TEXTS), strict=True):
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


@pytest.mark.parametrize("seed", range(30))
def test_best_step_by_brute_force(seed):
    rng = random.Random(seed)
    capacity = rng.choice([12, 40])
    lengths, bins = [], []
    for _ in range(rng.randint(2, 5)):
        room, own = capacity, []
        for _ in range(rng.randint(1, 40)):
            size = rng.randint(1, rng.choice([2, 9]))
            if size <= room:
                room -= size
                own.append(len(lengths))
                lengths.append(size)
        bins.append(own)
    fill = [sum(lengths[k] for k in b) for b in bins]
    under = [b for b in range(len(bins)) if fill[b] < capacity]
    for donor in under:
        gains = [0]
        for target in under:
            if target == donor:
                continue
            mine, theirs = ([lengths[k] for k in bins[b]] for b in (donor, target))
            two = lambda x: [x[i] + x[j] for i in range(len(x)) for j in range(i)]
            moves = [a - b for a in mine for b in [0, *theirs, *two(theirs)]] + [a - b for a in two(mine) for b in theirs]
            gains += [2 * d * (fill[target] - fill[donor] + d) for d in moves if 0 < d <= capacity - fill[target]]
        step = packing._best_step(donor, under, bins, fill, lengths, capacity)
        if step is None:
            assert max(gains) <= 0
            continue
        target, given, taken = step
        d = sum(lengths[k] for k in given) - sum(lengths[k] for k in taken)
        assert set(given) <= set(bins[donor]) and set(taken) <= set(bins[target])
        assert 2 * d * (fill[target] - fill[donor] + d) == max(gains)


def check_packed(rows, texts, length):
    tokenizer = Tokenizer.from_file(PATH)
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for d, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        parts = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(-(-len(ids) // length)))
        for r in parts:
            assert r["start"] == r["piece"] * length
            part = ids[r["start"] : r["start"] + length]
            assert r["length"] == len(part)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by_sequence), -(-sum(r["length"] for r in rows) // length)


def test_packing_round_trip(make_docs, corpus):
    used, least = check_packed(
        packing.pack_documents(make_docs(corpus), PATH, 128).collect(), [r[:2] for r in corpus], 128
    )
    assert used <= 1.02 * least + 1


def test_packing_in_blocks(spark):
    rng = random.Random(4)
    rows = [(k, 0, 0, min(2048, int(rng.expovariate(1 / 900)) + 1), k) for k in range(4000)]
    found = spark.createDataFrame(rows, f"doc_id long, {packing.PIECE}")
    out = packing.pack(found, 2048, block=500).collect()
    assert sorted(r["doc_id"] for r in out) == list(range(4000))
    fill = {}
    for r in out:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    least = sum(r[3] for r in rows) / 2048
    assert max(fill.values()) <= 2048 and len(fill) <= 1.005 * least + 2


@pytest.mark.parametrize("lengths", [[6, 6, 6, 4, 4, 4], [7, 5, 5, 3, 6, 4], [9, 1, 8, 2, 5, 5], [10, 10], []])
def test_local_search_never_overfills(lengths):
    bins = [[k] for k in range(len(lengths))]
    before = sum(x * x for x in lengths)
    packing.improve(bins, lengths, 10)
    fills = [sum(lengths[k] for k in b) for b in bins]
    assert sorted(k for b in bins for k in b) == list(range(len(lengths)))
    assert max(fills, default=0) <= 10 and sum(x * x for x in fills) >= before
    assert sum(1 for x in fills if x) == -(-sum(lengths) // 10)


def test_packing_edges(make_docs):
    docs = make_docs([(1, None), (2, ""), (2, ""), (None, "a b"), (3, "long " * 30000)])
    docs = docs.withColumn("length", F.lit("x")).withColumn("offset", F.lit(1))
    rows = packing.pack_documents(docs, PATH).collect()
    assert sorted((str(r["doc_id"]), r["length"]) for r in rows if r["length"] < 100) == [
        ("1", 1), ("2", 1), ("2", 1), ("None", 3),
    ]
    whole = {}
    for r in rows:
        whole[r["sequence_id"]] = whole.get(r["sequence_id"], 0) + r["length"]
    assert max(whole.values()) <= 2048
    assert sum(r["length"] for r in rows if r["doc_id"] == 3) == 30001
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
