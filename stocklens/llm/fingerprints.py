"""Document fingerprints that say which paragraphs two versions do not share.

A text is a set of paragraphs: lines, cut at the ends of sentences and after each ``GROUP`` words
of a long one, white space made single. Each has a 64-bit digest; a paragraph that occurs again in
the text has another one for each time. The fingerprint is an invertible Bloom lookup table of
these digests: a digest adds one to the counts of a cell in each of three subtables and joins the
cells' digests and checks by exclusive or. Cells of two versions subtract; what both hold
vanishes, and a cell left with a single digest gives it away, is taken out of its other cells, and
so on until all are empty. Then the digests of both sides are known. If cells stay filled, the
difference was too large for the table, and both sides are tabulated again, ``GROWTH`` times as
large with other places, until it comes out. Nothing is estimated or cut short.

The likeness of two texts is the number of paragraphs they share over the mean of their numbers:
``1 - differing / (n_a + n_b)``, which is 1 for two texts without a paragraph.

A fingerprint is the number of paragraphs, a colon, and the base-64 form of ``CELLS`` cells (count,
digest, check; little-endian). Equal texts have equal ones. A null text is an empty one. A
document's successor is the next one by doc_id, nulls last, rows of the same id by their texts; the
last one's is the first, and a single document's is itself. Equal rows follow each other in any
order. An empty table gives an empty table; further columns are not read.

Texts move once: documents go to stretches of neighbouring ids, whose bounds are quantiles of the
ids, and the first document of each stretch also goes to the one before it. Within a stretch they
come in order, a batch at a time, so a task's memory is that of ``CHARS`` characters or of the
longest text and its successor.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm.common import schema_of

#: Words a paragraph at most.
GROUP = 8
#: Cells of a fingerprint, a multiple of three, and how much larger the next try is.
CELLS, GROWTH = 24, 3
CELL = np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")])
CHARS = 1 << 20
#: Documents in a stretch of ids, and stretches at most.
STRETCH, STRETCHES = 1000, 1 << 16
LAST_ID = (1 << 63) - 1
_END = re.compile(r"(?<=[.!?…。！？।؟])\s+|\n+")
_ONE, _TWO = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def paragraphs(text: str) -> list[str]:
    out = []
    for part in _END.split(text):
        words = part.split()
        out += [" ".join(words[k : k + GROUP]) for k in range(0, len(words), GROUP)]
    return out


def digests(text: str) -> np.ndarray:
    """64-bit digests of the paragraphs, all different."""
    seen: dict[int, int] = {}
    for paragraph in paragraphs(text):
        digest = xxhash.xxh3_64_intdigest(paragraph.encode())
        if digest in seen:
            seen[digest] += 1
            digest = xxhash.xxh3_64_intdigest(f"{digest}:{seen[digest]}".encode())
        seen[digest] = 1
    return np.fromiter(seen, np.uint64, len(seen))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _ONE
    x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


def _check(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys + np.uint64(7)) >> np.uint64(32)).astype(np.uint32)


def _places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """The cell of each key in each of the three subtables."""
    third = cells // 3
    salt = _mixed(np.array([cells, cells + 1, cells + 2], np.uint64) * _ONE)
    return [(_mixed(keys ^ s) % np.uint64(third)).astype(np.int64) + j * third for j, s in enumerate(salt)]


class Tables:
    """Lookup tables of several sets of keys: rows are sets, columns cells."""

    def __init__(self, n: int, cells: int):
        self.cells = cells
        self.count = np.zeros((n, cells), np.int32)
        self.key = np.zeros((n, cells), np.uint64)
        self.check = np.zeros((n, cells), np.uint32)

    @classmethod
    def of(cls, sets: list[np.ndarray], cells: int) -> Tables:
        out = cls(len(sets), cells)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        keys = np.concatenate([*sets, np.zeros(0, np.uint64)])
        out.add(owner, keys, np.ones(len(keys), np.int32))
        return out

    def add(self, owner: np.ndarray, keys: np.ndarray, times: np.ndarray) -> None:
        check = _check(keys)
        for place in _places(keys, self.cells):
            np.add.at(self.count, (owner, place), times)
            np.bitwise_xor.at(self.key, (owner, place), keys)
            np.bitwise_xor.at(self.check, (owner, place), check)

    def minus(self, other: Tables) -> Tables:
        out = Tables(0, self.cells)
        out.count = self.count - other.count
        out.key = self.key ^ other.key
        out.check = self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Empty the tables: (which of them came out empty, found (owner, key, sign))."""
        found = []
        for _ in range(self.cells + 1):  # each round that matters empties a cell
            owner, cell = np.nonzero((np.abs(self.count) == 1) & (self.check == _check(self.key)))
            keys, signs = self.key[owner, cell], self.count[owner, cell]
            own = np.zeros(len(keys), bool)
            for place in _places(keys, self.cells):
                own |= place == cell
            owner, keys, signs = owner[own], keys[own], signs[own]
            if not len(keys):
                break
            # A key alone in two cells counts once.
            order = np.lexsort((keys, owner))
            owner, keys, signs = owner[order], keys[order], signs[order]
            first = np.ones(len(keys), bool)
            first[1:] = (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])
            owner, keys, signs = owner[first], keys[first], signs[first]
            found.append((owner, keys, signs))
            self.add(owner, keys, -signs)
        done = ~((self.count != 0) | (self.key != 0) | (self.check != 0)).any(axis=1)
        return done, found

    def texts(self, sizes: list[int]) -> list[str]:
        """The fingerprints of the sets."""
        out = np.zeros(self.count.shape, CELL)
        out["count"], out["key"], out["check"] = self.count, self.key, self.check
        return [f"{n}:{base64.b64encode(row.tobytes()).decode()}" for n, row in zip(sizes, out)]


def table_of(fingerprint: str) -> tuple[int, Tables]:
    """(number of paragraphs, the lookup table) of a fingerprint."""
    size, cells = fingerprint.split(":")
    raw = np.frombuffer(base64.b64decode(cells), CELL)
    out = Tables(1, len(raw))
    out.count[0], out.key[0], out.check[0] = raw["count"], raw["key"], raw["check"]
    return int(size), out


def differences(
    a: list[np.ndarray], b: list[np.ndarray], tables: tuple[Tables, Tables] | None = None, cells: int = CELLS
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pair of sets the keys that only ``a`` holds and those that only ``b`` holds.

    ``tables`` are those of the first try, if they are known already.
    """
    none = np.zeros(0, np.uint64)
    out = [(none, none)] * len(a)
    todo = np.arange(len(a))
    while len(todo):
        left, right = tables or (Tables.of([a[k] for k in todo], cells), Tables.of([b[k] for k in todo], cells))
        done, found = left.minus(right).peel()
        if found:
            owner, keys, signs = map(np.concatenate, zip(*found))
            order = np.argsort(owner, kind="stable")
            owner, keys, signs = owner[order], keys[order], signs[order]
            edge = np.searchsorted(owner, np.arange(len(todo) + 1))
            for k in np.flatnonzero(done & (np.diff(edge) > 0)):
                own, sign = keys[edge[k] : edge[k + 1]], signs[edge[k] : edge[k + 1]]
                out[todo[k]] = (own[sign > 0], own[sign < 0])
        todo = todo[~done]
        tables, cells = None, cells * GROWTH
    return out


def likeness(size_a: int, size_b: int, differing: int) -> float:
    return 1 - differing / (size_a + size_b) if size_a + size_b else 1.0


def _in_lists(rows: Iterator[tuple], chars: int = CHARS) -> Iterator[list[tuple]]:
    """(doc_id, text, ...) rows in lists of about so many characters."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += sum(len(x) for x in row[1:])
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def fingerprint(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """(doc_id, fingerprint) of every document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            texts = batch.column("text").to_pylist()
            for some in _in_lists((None, x or "") for x in texts):
                sets = [digests(x) for _, x in some]
                out = Tables.of(sets, cells).texts([len(s) for s in sets])
                ids = batch.column("doc_id").slice(at, len(some))
                yield pa.RecordBatch.from_arrays([ids, pa.array(out)], ["doc_id", "fingerprint"])
                at += len(some)

    return docs.select("doc_id", "text").mapInArrow(rows, f"{schema_of(docs, 'doc_id')}, fingerprint string")


def compare_versions(pairs: DataFrame, cells: int = CELLS) -> DataFrame:
    """Of (doc_id, old, new): likeness, and the paragraphs that only one of the texts has.

    ``removed`` and ``added`` are the texts of the paragraphs whose digests the peeling recovers.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("old", "new"))
            at = 0
            for some in _in_lists((None, x or "", y or "") for x, y in zip(*columns)):
                old, new = [digests(x) for _, x, _ in some], [digests(y) for _, _, y in some]
                apart = differences(old, new, cells=cells)
                like = [likeness(len(a), len(b), len(x) + len(y)) for a, b, (x, y) in zip(old, new, apart)]
                gone = [_named(x, a, d[0]) for (_, x, _), a, d in zip(some, old, apart)]
                come = [_named(y, b, d[1]) for (_, _, y), b, d in zip(some, new, apart)]
                listed = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(some)),
                        pa.array(like, pa.float64()),
                        pa.array(gone, listed),
                        pa.array(come, listed),
                    ],
                    ["doc_id", "likeness", "removed", "added"],
                )
                at += len(some)

    schema = f"{schema_of(pairs, 'doc_id')}, likeness double, removed array<string>, added array<string>"
    return pairs.select("doc_id", "old", "new").mapInArrow(rows, schema)


def _named(text: str, keys: np.ndarray, some: np.ndarray) -> list[str]:
    """The paragraphs of ``text`` whose digests are in ``some``, in text order."""
    wanted = set(some.tolist())
    return [p for p, key in zip(paragraphs(text), keys.tolist()) if key in wanted]


def _stretches(docs: DataFrame) -> list[int]:
    """The ids at which the stretches begin; the first is the least of all."""
    n = min(STRETCHES, docs.count() // STRETCH)
    if n < 2:
        return []
    shares = [k / n for k in range(n)]
    exact = max(10_000, 8 * n)
    found = docs.agg(F.percentile_approx("doc_id", shares, exact).alias("p"), F.min("doc_id").alias("low")).first()
    return sorted({int(x) for x in found.p or []} | ({int(found.low)} if found.low is not None else set()))


def over_successors(
    docs: DataFrame, body: Callable[[list[tuple[object, str, str]]], pa.RecordBatch], schema: str
) -> DataFrame:
    """``body`` over lists of (doc_id, text, text of the next document), all documents once."""
    bounds = np.array(_stretches(docs.select("doc_id")), np.int64)
    n = max(1, len(bounds))

    @F.pandas_udf("long")
    def stretch(ids: pd.Series) -> pd.Series:
        """Twice the number of the id's stretch, and one more where the stretch begins with it."""
        at = np.searchsorted(bounds, ids.to_numpy(), side="right")
        place = np.maximum(at - 1, 0)
        return pd.Series(2 * place + ((at > 0) & (bounds[place] == ids.to_numpy())))

    wide = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    home = lambda place, lent: F.struct(place.alias("stretch"), F.lit(lent).alias("lent"))
    if n > 1:
        placed = docs.select("doc_id", "text", stretch(wide).alias("_at"))
        own = F.floor(F.col("_at") / 2)
        lent = F.when(
            (F.col("_at") % 2 == 1) & F.col("doc_id").isNotNull(),
            F.array(home(own, False), home((own + n - 1) % n, True)),
        )
        placed = placed.withColumn("_to", F.explode(F.coalesce(lent, F.array(home(own, False)))))
        placed = placed.select("doc_id", "text", "_to.*")
    else:
        placed = docs.select("doc_id", "text", F.lit(0).alias("stretch"), F.lit(False).alias("lent"))
    text = F.coalesce("text", F.lit(""))
    ordered = placed.withColumn("text", text).repartition("stretch")
    ordered = ordered.sortWithinPartitions("stretch", "lent", F.asc_nulls_last("doc_id"), "text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = chain.from_iterable(
            zip(*(b.column(c).to_pylist() for c in ("stretch", "lent", "doc_id", "text"))) for b in batches
        )
        for some in _in_lists(_successive(read)):
            yield body(some)

    return ordered.mapInArrow(rows, schema)


def _successive(rows: Iterator[tuple[int, bool, object, str]]) -> Iterator[tuple[object, str, str]]:
    """(doc_id, text, next text) of rows in order; a stretch without a lent row goes round."""
    here = held = first = None
    for stretch, lent, doc_id, text in rows:
        if held is not None:
            yield (*held, text if stretch == here else first)
            held = None
        if stretch != here:
            here, first = stretch, text
        if not lent:
            held = (doc_id, text)
    if held is not None:
        yield (*held, first)


def edited(text: str, following: str) -> str:
    """``text`` with the latter half of its code points replaced by as many first ones of the other."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and what the first say of likeness.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """

    def body(some: list[tuple[object, str, str]]) -> pa.RecordBatch:
        changed = [edited(x, y) for _, x, y in some]
        # A text's successor is mostly the next of the list.
        known: dict[str, np.ndarray] = {}

        def sets(texts: list[str]) -> list[np.ndarray]:
            return [known[x] if x in known else known.setdefault(x, digests(x)) for x in texts]

        own, next_, new = sets([x for _, x, _ in some]), sets([y for _, _, y in some]), sets(changed)
        tables = [Tables.of(s, CELLS) for s in (own, next_, new)]
        near = [
            [likeness(len(a), len(b), len(x) + len(y)) for a, b, (x, y) in zip(own, other, differences(own, other, (tables[0], table)))]
            for other, table in ((new, tables[2]), (next_, tables[1]))
        ]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([i for i, _, _ in some], pa.int64()),
                "n_chars": pa.array([len(x) for _, x, _ in some], pa.int64()),
                "edited_sha256": [hashlib.sha256(x.encode()).hexdigest() for x in changed],
                "fingerprint": tables[0].texts([len(s) for s in own]),
                "edited_fingerprint": tables[2].texts([len(s) for s in new]),
                "near_edited": pa.array(near[0], pa.float64()),
                "near_next": pa.array(near[1], pa.float64()),
            }
        )

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"
    )
    return over_successors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), body, schema)
