"""Codes for vectors by a product quantizer of integers, with a dictionary of values per dimension.

Components become integers, ``floor(SCALE * x)``, and vectors are cut into ``PARTS`` consecutive
parts. Each part position has a codebook of ``ENTRIES`` entries, learnt in ``ROUNDS`` rounds of
k-means over all vectors. No distance is computed vector by vector: a block of vectors holds, for
each dimension, the dictionary of the distinct integers met there and the vectors' codes in it.
A round tabulates the squared differences of every dictionary value to all entries, and the
distance of a part is the sum of the table rows that its codes gather. New entries come from the
same dictionaries: values times a count of (code, entry) pairs.

All arithmetic is on integers and exact: 32 or 64 bits wide where a block's values allow it, else
Python's. Sums over the table are DECIMAL(38). So codes do not depend on the order of rows.

Vectors that are null, or hold a null or non-finite component, or one whose integer has no 64 bits,
are dropped; so are empty ones and those that have another number of components than most (ties:
the longer). Vectors whose length is no multiple of ``PARTS`` have parts as even as can be, some of
them empty. Fewer than ``ENTRIES`` vectors give so many entries. Rows that repeat an id each
have a code; an id that is null is no starting entry unless there are too few others, and equal ids
start by their vectors. An error, or sum of errors, that exceeds 64 bits is null. An empty table
gives an empty table; further columns are not read.

Blocks of codes are written once to the shared folder, and each round reads them. What a round
shuffles and brings to the driver is (dimension, entry, count, sum), as large as the codebook.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.common import schema_of, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Vectors in a block; memory for one is about this times the dimension times 20 bytes.
BLOCK = 8192
#: Integers are kept in 64 bits.
LARGEST = float(1 << 63)


@dataclass(frozen=True)
class Codebooks:
    """Entries of each part: ``entries[part][entry]`` is a tuple of integers."""

    entries: tuple[tuple[tuple[int, ...], ...], ...]

    @property
    def cuts(self) -> list[int]:
        """Where the parts begin, and the number of dimensions."""
        sizes = [len(part[0]) if part else 0 for part in self.entries]
        return [sum(sizes[:k]) for k in range(len(sizes) + 1)]

    def sha256(self) -> str:
        flat = (str(x) for part in self.entries for entry in part for x in entry)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()


def cuts(dimensions: int, parts: int = PARTS) -> list[int]:
    return [dimensions * k // parts for k in range(parts + 1)]


def usable(vector: Column, scale: int = SCALE) -> Column:
    """True for vectors that have integers."""
    x = lambda c: c.cast("double")
    fits = lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < LARGEST / scale)
    return F.coalesce(F.forall(vector, fits) & (F.size(vector) > 0), F.lit(False))


def _integers(flat: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(flat.astype(np.float64) * scale).astype(np.int64)


def blocks(vectors: DataFrame, scale: int = SCALE, column: str = "embedding") -> DataFrame:
    """Blocks of vectors of one length: their ids and labels, dictionaries, and codes in them.

    ``values`` holds the dictionaries one after the other, ``ends`` where each stops, ``codes`` the
    vectors' codes in row order, as 16 bits where the largest dictionary allows it, else 32.
    """
    kinds = dict(vectors.dtypes)
    schema = (
        f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, dimensions int, n long, "
        "values binary, ends array<int>, codes binary"
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                listed = batch.column(column)
                sizes = np.diff(listed.offsets.to_numpy())
                for d in np.unique(sizes):
                    mine = pa.array(np.flatnonzero(sizes == d))
                    flat = listed.take(mine).flatten().to_numpy(zero_copy_only=False)
                    yield _block(batch, mine, _integers(flat, scale).reshape(-1, d))

    kept = vectors.where(usable(F.col(column), scale)).select("vec_id", "label", column)
    return kept.mapInArrow(rows, schema)


def _block(batch: pa.RecordBatch, mine: pa.Array, ints: np.ndarray) -> pa.RecordBatch:
    found = [np.unique(ints[:, k], return_inverse=True) for k in range(ints.shape[1])]
    ends = np.cumsum([len(values) for values, _ in found])
    width = np.uint16 if max(len(values) for values, _ in found) <= 1 << 16 else np.uint32
    codes = np.stack([inverse for _, inverse in found], axis=1).astype(width)
    one = lambda name: batch.column(name).take(mine)
    listed = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    return pa.RecordBatch.from_arrays(
        [
            listed(one("vec_id")),
            listed(one("label")),
            pa.array([ints.shape[1]], pa.int32()),
            pa.array([len(ints)], pa.int64()),
            pa.array([np.concatenate([values for values, _ in found]).tobytes()]),
            pa.array([ends.tolist()], pa.list_(pa.int32())),
            pa.array([codes.tobytes()]),
        ],
        ["vec_id", "label", "dimensions", "n", "values", "ends", "codes"],
    )


class Block:
    """A block read back: a dictionary and a column of codes for each dimension."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        get = lambda name: batch.column(batch.schema.get_field_index(name))[row]
        self.n, self.dimensions = get("n").as_py(), get("dimensions").as_py()
        values, ends = np.frombuffer(get("values").as_py(), np.int64), get("ends").as_py()
        self.values = [values[a:b] for a, b in zip([0, *ends], ends)]
        raw = get("codes").as_py()
        width = np.uint16 if len(raw) == 2 * self.n * self.dimensions else np.uint32
        self.codes = np.ascontiguousarray(np.frombuffer(raw, width).reshape(self.n, -1).T)

    def nearest(self, books: Codebooks) -> tuple[np.ndarray, list[np.ndarray]]:
        """(entry of each part and vector, the distances to these entries)."""
        places, errors = [], []
        at = books.cuts
        for part, entries in enumerate(books.entries):
            total = None
            for k in range(at[part], at[part + 1]):
                own = [entry[k - at[part]] for entry in entries]
                table = _squares(self.values[k], own, at[part + 1] - at[part])
                rows = table.take(self.codes[k], axis=0)
                total = rows if total is None else np.add(total, rows, out=total)
            if total is None:  # a part without dimensions
                total = np.zeros((self.n, len(entries)), np.int32)
            best = total.argmin(axis=1)  # the first of equal ones
            places.append(best)
            errors.append(total[np.arange(self.n), best])
        return np.stack(places), errors

    def sums(self, places: np.ndarray, books: Codebooks) -> Iterator[tuple[int, np.ndarray, list[int]]]:
        """(dimension, vectors per entry, their sum per entry), summed by dictionary value."""
        at = books.cuts
        for part, entries in enumerate(books.entries):
            size = len(entries)
            held = np.bincount(places[part], minlength=size)
            for k in range(at[part], at[part + 1]):
                pairs = self.codes[k].astype(np.int64) * size + places[part]
                counts = np.bincount(pairs, minlength=len(self.values[k]) * size).reshape(-1, size)
                values = self.values[k]
                if _largest(values) * self.n >= 1 << 62:
                    values, counts = values.astype(object), counts.astype(object)
                yield k, held, [int(x) for x in values @ counts]


def _largest(values: np.ndarray) -> int:
    return max(abs(int(values.min())), abs(int(values.max())))


def _squares(values: np.ndarray, entries: list[int], terms: int) -> np.ndarray:
    """Squared differences of each value to each entry, wide enough for the sum of ``terms``."""
    most = (_largest(values) + max(abs(x) for x in entries)) ** 2 * terms
    kind = np.int32 if most < 1 << 31 else np.int64 if most < 1 << 63 else object
    difference = values.astype(kind)[:, None] - np.array(entries, kind)[None, :]
    return difference * difference


def _first_entries(vectors: DataFrame, dimensions: int, parts: int, entries: int, scale: int, column: str) -> Codebooks:
    order = [F.col("vec_id").asc_nulls_last(), F.col(column)]
    kept = vectors.where(usable(F.col(column), scale) & (F.size(column) == dimensions))
    first = kept.select("vec_id", column).orderBy(*order).limit(entries).collect()
    ints = [_integers(np.array(r[column]), scale).tolist() for r in first]
    at = cuts(dimensions, parts)
    return Codebooks(tuple(tuple(tuple(x[a:b]) for x in ints) for a, b in zip(at, at[1:])))


def _next(found: DataFrame, books: Codebooks) -> Codebooks:
    """One round: entries become the means, rounded down, of the parts nearest to them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[int, int], list[int]] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                places, _ = block.nearest(books)
                for k, held, sums in block.sums(places, books):
                    for entry in np.flatnonzero(held):
                        own = totals.setdefault((k, int(entry)), [0, 0])
                        own[0] += int(held[entry])
                        own[1] += sums[entry]
        yield pa.RecordBatch.from_pydict(
            {
                "dimension": pa.array([k for k, _ in totals], pa.int32()),
                "entry": pa.array([e for _, e in totals], pa.int32()),
                "n": pa.array([n for n, _ in totals.values()], pa.int64()),
                "s": pa.array([Decimal(s) for _, s in totals.values()], pa.decimal128(38, 0)),
            }
        )

    part = found.select("n", "dimensions", "values", "ends", "codes")
    sums = part.mapInArrow(rows, "dimension int, entry int, n long, s decimal(38,0)")
    means = {
        (r.dimension, r.entry): int(r.s) // r.n
        for r in sums.groupBy("dimension", "entry").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    }
    at = books.cuts
    return Codebooks(
        tuple(
            tuple(
                tuple(means.get((at[p] + j, e), x) for j, x in enumerate(entry))
                for e, entry in enumerate(entries)
            )
            for p, entries in enumerate(books.entries)
        )
    )


def train(
    vectors: DataFrame,
    found: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    column: str = "embedding",
) -> Codebooks | None:
    """The codebooks of ``vectors``, whose stored blocks are ``found``; None without vectors."""
    lengths = found.groupBy("dimensions").agg(F.sum("n").alias("n"))
    usual = lengths.orderBy(F.desc("n"), F.desc("dimensions")).limit(1).collect()
    if not usual:
        return None
    dimensions = usual[0]["dimensions"]
    books = _first_entries(vectors, dimensions, parts, entries, scale, column)
    found = found.where(F.col("dimensions") == dimensions)
    for _ in range(rounds):
        books = _next(found, books)
    return books


def encode(found: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of the vectors in blocks: entry numbers as hex, squared error."""
    dimensions = books.cuts[-1]
    kinds = {c: k.removeprefix("array<").removesuffix(">") for c, k in found.dtypes}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row)
                places, errors = block.nearest(books)
                exact = [sum(map(int, x)) for x in zip(*errors)]
                one = lambda name: batch.column(name).slice(row, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [
                        one("vec_id"),
                        one("label"),
                        pa.array([x.tobytes().hex() for x in places.T.astype(np.uint8)]),
                        pa.array([x if x < 1 << 63 else None for x in exact], pa.int64()),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return found.where(F.col("dimensions") == dimensions).mapInArrow(
        rows, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    )


def decode(codes: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``codes`` with ``approximation``: the middle of the integers' intervals, as doubles."""
    values = [[[(x + 0.5) / scale for x in entry] for entry in part] for part in books.entries]
    book = F.lit([float(x) for part in values for entry in part for x in entry])
    at, parts = 0, []
    for p, part in enumerate(values):
        size = len(part[0]) if part else 0
        entry = F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
        parts.append(F.slice(book, F.lit(at + 1) + entry * size, F.lit(size)))
        at += size * len(part)
    return codes.withColumn("approximation", F.concat(*parts))


def compress(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of all vectors of an embeddings table.

    Errors are summed per label before they meet the vectors again, so a label that a third of all
    vectors carry is one row of the smaller side; unlabelled vectors are one group.
    """
    found = stored(blocks(vectors))
    books = train(vectors, found)
    if books is None:
        schema = f"{schema_of(vectors, 'vec_id')}, code string, error long, label_error long, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    coded = stored(encode(found, books))
    totals = coded.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error"))
    return coded.join(stored(totals), F.col("label").eqNullSafe(F.col("_label")), "inner").select(
        "vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256")
    )
