from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)

WORDS = {
    "en": "the of and to in that is was for with as his they be at one have this from or had".split(),
    "de": "der die und das nicht ein eine ich auf mit für sich dem den von ist über schön".split(),
    "fr": "le la les des une est que qui dans pour pas sur avec ce il sont été où très".split(),
}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    out = []
    for _ in range(n):
        w = rng.choice(WORDS[lang])
        out.append(w + rng.choice(WORDS[lang]) if rng.random() < 0.5 else w)
    return " ".join(out)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """Documents of (doc_id, text[, lang[, source]])."""
        full = [(*r, *(None, "s")[len(r) - 2 :]) if len(r) < 4 else r for r in rows]
        return spark.createDataFrame([(*r, len(r[1] or "")) for r in full], DOCS)

    return make


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): texts with copies, near copies, shared and repeated lines."""
    rng = random.Random(5)
    rows = []
    shared = ["  Accept the terms of this SITE before you read any further  ", "Short line"]
    for k in range(160):
        lang = rng.choice(list(WORDS))
        lines = [sentence(rng, lang, rng.randint(4, 30)) for _ in range(rng.randint(1, 8))]
        if k % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), shared[0].swapcase() if k % 2 else shared[0])
        if k % 7 == 0:
            lines.append(shared[1])
            lines += lines[:2]
        rows.append((k, "\n".join(lines), lang, f"s{k % 3}"))
    for k in range(160, 200):  # copies, and copies with one word more
        text = rows[k - 160][1]
        rows.append((k, text + " one more" if k % 2 else text, rows[k - 160][2], "s0"))
    rows += [(200, None, "en", "s0"), (201, "", None, None), (202, " \n\t\n", "en", None), (203, "123 !!!", "de", "s1")]
    return rows
