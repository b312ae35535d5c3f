"""Language ID: string kernels, Nyström landmarks and one-versus-rest kernel ridge regression.

A text is reduced to its letters in lower case, runs of anything else becoming one blank. The
blended-spectrum kernel counts the character n-grams of 1 to ``MAX_GRAM`` letters that two texts
share, each counted once (presence), over the root of the product of their own counts; n-grams
are hashed to ``WIDTH`` places. Landmarks are texts of the training sample, as many of each
language; the Nyström map K(x, L) K(L, L)^-1/2 gives features, on which ridge regression is solved
once per language against the rest. Prediction multiplies batches: presence rows by landmarks,
then kernel values by coefficients.

Regression always names a language, and a text that resembles none gets a middling score. Whether a
text is in a learnt language at all is told by evidence instead: the share of its n-grams that occur
in the sample of the predicted language. The level it must reach is taken from the sample itself:
``SLACK`` of the ``TAIL`` quantile of that share, each sample text held against the others of its
language. A language of one sample text has no others, hence level 0: it rejects nothing.

The model learns from a bounded sample: at most ``per_lang`` labelled documents of each language,
those of the smallest hash of doc_id; only their presence bits (4 KB each) reach the driver.

Null text, or text without a letter, is ``und`` with score 0, as is every text if there is nothing
to learn from. Rows that repeat a doc_id each get a row. An empty table gives an empty table;
further columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.common import in_small_batches, schema_of, stored

MAX_GRAM, LOG_WIDTH = 3, 15
WIDTH = 1 << LOG_WIDTH
PER_LANG, LANDMARKS, RIDGE = 240, 128, 1e-2
#: So much of a sample may be foreign to its label; texts may know so much less than the rest of it.
TAIL, SLACK = 0.05, 0.72
BATCH = 32
UNKNOWN = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def letters(text: str | None) -> str:
    """The letters of a text in lower case, single blanks for what lies between them."""
    bare = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if bare.isascii() or bare.replace(" ", "").isalpha():
        return bare
    # Fractions, superscripts, and Roman and circled numbers are of words, and no letters.
    return " ".join("".join(c if c.isalpha() else " " for c in bare).split())


def mark(text: str, row: np.ndarray) -> None:
    """Set the places of the n-grams of ``text`` (letters and single blanks) in ``row``."""
    codes = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = codes.astype(np.uint64)
    grams = np.zeros_like(codes)
    for n in range(MAX_GRAM):
        grams = (grams[: len(codes) - n] << np.uint64(21)) | codes[n:]
        # 21 bits hold any code point, so that three of them fill one number without loss.
        row[((grams + np.uint64(n)) * _MIX) >> np.uint64(64 - LOG_WIDTH)] = 1


@dataclass
class Model:
    langs: list[str]
    landmarks: np.ndarray  # WIDTH x landmarks, each column of length one
    coefficients: np.ndarray  # landmarks x languages
    known: np.ndarray  # WIDTH x languages, 1 where an n-gram occurs in the language's sample
    levels: np.ndarray  # least share of known n-grams, one a language

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Regression values of presence rows, one column a language."""
        size = np.sqrt(np.maximum(rows.sum(axis=1, keepdims=True), 1))
        return (rows @ self.landmarks) / size @ self.coefficients

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, best, _ = self.judge(texts, False)
        return langs, best

    def judge(self, texts: list[str | None], evidence: bool = True) -> tuple[list[str], list[float], list[bool]]:
        """Language and score of each text and, if asked for, whether its evidence suffices."""
        langs, best, backed = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        bare = [letters(x) for x in texts]
        spoken = [k for k, x in enumerate(bare) if x] if self.langs else []
        for at in range(0, len(spoken), BATCH):
            chosen = spoken[at : at + BATCH]
            rows = np.zeros((len(chosen), WIDTH), np.float32)
            for row, k in zip(rows, chosen, strict=True):
                mark(bare[k], row)
            # Targets are -1 and 1, so that (value + 1) / 2 lies near a probability.
            near = np.clip((self.scores(rows) + 1) / 2, 0, 1)
            top = near.argmax(axis=1)
            for k, j, p in zip(chosen, top, near[np.arange(len(top)), top], strict=True):
                langs[k], best[k] = self.langs[j], float(p)
            if evidence:
                share = (rows @ self.known)[np.arange(len(top)), top] / rows.sum(axis=1)
                for k, fine in zip(chosen, share >= self.levels[top], strict=True):
                    backed[k] = bool(fine)
        return langs, best, backed


def evidence(labels: np.ndarray, rows: np.ndarray, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(known, levels) of a model."""
    known, levels = np.zeros((WIDTH, len(langs)), np.float32), np.zeros(len(langs))
    for j, lang in enumerate(langs):
        of = rows[labels == lang]
        count = of.sum(axis=0, dtype=np.int64)
        known[:, j] = count > 0
        shared = count > 1  # in a sample text and another one
        levels[j] = SLACK * np.quantile([row[shared].sum() / row.sum() for row in of], TAIL)
    return known, levels


def fit(labels: list[str], rows: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """``rows``: presence of the n-grams, one row a label."""
    langs = sorted(set(labels))
    if not langs:
        none = np.zeros((WIDTH, 0), np.float32)
        return Model([], none, np.zeros((0, 0), np.float32), none, np.zeros(0))
    of = {x: [k for k, y in enumerate(labels) if y == x] for x in langs}
    share = max(1, landmarks // len(langs))
    chosen = [k for x in langs for k in of[x][:share]]
    marks = rows[chosen].astype(np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    near = np.empty((len(rows), len(chosen)), np.float64)
    for at in range(0, len(rows), BATCH):
        part = rows[at : at + BATCH].astype(np.float32)
        near[at : at + BATCH] = part @ marks.T / np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh(near[chosen])
    sound = values > values.max() * 1e-6
    to_features = vectors[:, sound] / np.sqrt(values[sound])
    features = near @ to_features
    targets = np.array([[1.0 if y == x else -1.0 for x in langs] for y in labels])
    # Each language weighs the same however many samples it has.
    weight = np.array([1 / len(of[y]) for y in labels])[:, None]
    square = features.T @ (features * weight) + ridge * np.eye(features.shape[1]) / len(labels)
    solved = np.linalg.solve(square, features.T @ (targets * weight))
    coefficients = (to_features @ solved).astype(np.float32)
    return Model(langs, np.ascontiguousarray(marks.T), coefficients, *evidence(np.array(labels), rows, langs))


def held_out(doc_id: Column) -> Column:
    """The documents that nothing is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bare = [letters(x) for x in batch.column("text").to_pylist()]
        packed = []
        for text in bare:
            row = np.zeros(WIDTH, np.uint8)
            if text:
                mark(text, row)
            packed.append(np.packbits(row).tobytes() if text else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), pa.array(packed, pa.binary())], ["lang", "grams"]
        )


def train(docs: DataFrame, per_lang: int = PER_LANG, landmarks: int = LANDMARKS) -> Model:
    """The model of at most ``per_lang`` documents a language, held-out ones left aside."""
    labelled = docs.where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    )
    spread = Window.partitionBy("lang").orderBy("_hash", "doc_id")
    chosen = (
        labelled.where(F.col("text").rlike(r"\p{L}"))
        .select("doc_id", "lang", F.xxhash64("doc_id").alias("_hash"))
        .withColumn("_rank", F.row_number().over(spread))
        .where(F.col("_rank") <= per_lang)
        .select("doc_id")
        .distinct()
    )
    # A table of known, bounded size: no text is shuffled to find the sample.
    sample = labelled.join(stored(chosen), "doc_id", "left_semi").select("lang", "text")
    found = in_small_batches(sample).mapInArrow(_presence, "lang string, grams binary").where("grams is not null")
    got = sorted((r["lang"], bytes(r["grams"])) for r in found.toLocalIterator())
    rows = np.zeros((len(got), WIDTH), np.uint8)
    for row, (_, grams) in zip(rows, got, strict=True):
        row[:] = np.unpackbits(np.frombuffer(grams, np.uint8))
    return fit([lang for lang, _ in got], rows, landmarks)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, best = sent.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in batch.schema.names if c != "text"),
                 pa.array(langs, pa.string()), pa.array(best, pa.float64())],
                [*(c for c in batch.schema.names if c != "text"), "lang_pred", "score"],
            )

    kept = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = f"{schema_of(docs, 'doc_id')}, held_out boolean, lang_pred string, score double"
    return in_small_batches(kept).mapInArrow(rows, schema)


def keep_identified(docs: DataFrame, model: Model, min_score: float) -> DataFrame:
    """The rows whose text is in a learnt language by evidence, with a score of at least ``min_score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, best, backed = sent.value.judge(batch.column("text").to_pylist())
            fine = [x and p >= min_score for x, p in zip(backed, best, strict=True)]
            yield batch.filter(pa.array(fine, pa.bool_()))

    return in_small_batches(docs).mapInArrow(rows, docs.schema)
