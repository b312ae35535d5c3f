"""Line dedup and quality rules against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from stocklens.llm import line_dedup, quality

SPACE = " \t\n\x0b\x0c\r"


def key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def kept_by_hand(rows, min_chars=40, min_docs=5):
    held = defaultdict(set)
    for d, text, *_ in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(d)
    out = {}
    for d, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [
            x
            for x in lines
            if len(key(x)) < min_chars or len(held[key(x)]) < min_docs or max(held[key(x)]) == d
        ]
        out[d] = ("\n".join(stay), len(lines), len(lines) - len(stay))
    return out


def test_line_dedup_by_brute_force(make_docs, corpus):
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.dedup_lines(make_docs(corpus)).collect()}
    assert got == kept_by_hand(corpus)
    assert sum(x[2] for x in got.values()) > 20


def test_line_key_lowers_only_ascii(make_docs):
    line = "ÀÉ Straße İI ABC ﬁ " + "x" * 30
    rows = [(k, line + ("\xa0" if k == 9 else " \t")) for k in range(6)]
    got = make_docs(rows).select(line_dedup.line_key(F.col("text")).alias("k")).distinct().collect()
    assert [r["k"] for r in got] == [key(line)]


def test_line_dedup_edges(spark, make_docs):
    line = "this line is in many documents and is long enough"
    rows = [(k, f"{line}\nown {k}") for k in range(5)]
    rows += [(4, f"{line}\nown 4"), (None, line), (7, None), (8, "\n")]
    docs = make_docs(rows).withColumn("n_lines", F.lit("x")).withColumn("key", F.lit(1))
    got = line_dedup.dedup_lines(docs)
    assert sorted(got.columns) == sorted(docs.columns + ["n_dropped"])
    out = sorted((str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in got.collect())
    both = f"{line}\nown 4"
    assert out == sorted(
        [(str(k), f"own {k}", 2, 1) for k in range(4)]
        + [("4", both, 2, 0), ("4", both, 2, 0), ("None", line, 1, 0), ("7", "", 1, 0), ("8", "\n", 2, 0)]
    )
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def quality_by_hand(rows):
    held = defaultdict(set)
    for d, text, _, source in rows:
        for line in (text or "").split("\n"):
            if line.strip(SPACE):
                held[source, line.strip(SPACE).lower()].add(d)
    out = {}
    for d, text, _, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        counts, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            if counts[g] > 1:
                covered.update(range(i, i + 8))
        lines = [x for x in text.split("\n") if x.strip(SPACE)]
        gone = [x for x in lines if len(held[source, x.strip(SPACE).lower()]) > quality.MAX_DOCS]
        lost = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in gone)
        failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
        left = len(words) - lost
        out[d] = (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(covered), failed, len(gone), lost,
            not failed and left >= 10 and left >= 0.5 * len(words),
        )
    return out


def test_quality_by_brute_force(make_docs, corpus):
    boiler = " ".join(f"w{k}" for k in range(30))
    rows = corpus + [(300 + k, f"{boiler}\nonly {k} here #$", "en", "s9") for k in range(11)]
    rows += [(400, "a b c d e f g h i " * 9, "en", "s9"), (401, ("x " * 5000).strip(), "en", "s9")]
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.quality(make_docs(rows)).collect()}
    assert got == quality_by_hand(rows)
    assert {(x[5], x[8]) for x in got.values()} == {(True, False), (False, True), (False, False)}


def test_quality_edges(make_docs):
    docs = make_docs([(1, "a b"), (1, "a b"), (None, "c"), (2, None)]).withColumn("kept", F.lit(7))
    got = quality.quality(docs)
    assert got.count() == 4 and got.where("kept").count() == 0
    assert quality.quality(docs.limit(0)).count() == 0


def test_digest_is_of_utf8(make_docs):
    got = make_docs([(1, "é")]).select(F.sha2("text", 256).alias("h")).first()["h"]
    assert got == hashlib.sha256("é".encode()).hexdigest()
