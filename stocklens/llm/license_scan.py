"""License scans: winnowed fingerprints pick candidates, banded alignment confirms them.

Templates and texts are words (runs of letters and digits, lower case). Every ``GRAM`` words in a
row are hashed; of every ``WINDOW`` hashes of a template in a row the smallest is kept, and the kept
ones of all templates form an inverted index. All hashes of a text are looked up in it, so that any
agreement of ``GRAM + WINDOW - 1`` words is found. Those that it holds vote for (template, offset);
offsets close to each other are one candidate, which is aligned with the template inside a band
around them: words match or not, and skipped words cost, so that other words in between split no
match. One candidate may hold a notice many times: what the found spans leave of it is aligned again
until nothing is covered enough. Reported is how much of the template is covered, and the span in the text.

A match counts if it covers ``MIN_COVERAGE`` of the template and, for templates below ``NOTICE``
words, the names and version numbers of the template stand in the span in their order, and no word
does that makes the notice one of another licence of the family. Of matches that overlap in the text
the one with most matched words stays, then the better covered, then the first by name.

Every row is scanned by itself over its whole text; spans are in code points, ends exclusive. Null
text has no matches. Rows without a match give no row; rows that repeat a doc_id give theirs each.
An empty table, or no templates, gives an empty table; further columns are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stocklens.llm.common import schema_of
from stocklens.llm.license_texts import MODIFIERS, NAMES, TEMPLATES

GRAM, WINDOW = 3, 3
BAND = 6
MIN_COVERAGE = 0.75
#: Longer templates tell themselves apart by their texts.
NOTICE = 200
#: Share of a longer template's fingerprints that its candidates have.
LEAST_SHARE = 0.1
_WORD = re.compile(r"[^\W_]+")


def _winnow(codes: np.ndarray) -> np.ndarray:
    """Positions of the kept hashes: the last smallest of every window."""
    if len(codes) == 0:
        return np.zeros(0, np.int64)
    if len(codes) < WINDOW:
        return np.array([len(codes) - 1 - int(codes[::-1].argmin())])
    views = np.lib.stride_tricks.sliding_window_view(codes, WINDOW)
    last = WINDOW - 1 - views[:, ::-1].argmin(axis=1)
    return np.unique(last + np.arange(len(views)))


def _telling(words: list[str]) -> list[str]:
    """The names, version numbers and words of a family's other licences, in order."""
    return [w for w in words if w in NAMES or w in MODIFIERS or w.isdigit() and len(w) <= 2]


def _same_licence(template: list[str], span: list[str]) -> bool:
    own, found = _telling(template), _telling(span)
    if [w for w in own if w in MODIFIERS] != [w for w in found if w in MODIFIERS]:
        return False
    rest = iter(found)
    return all(w in rest for w in own)


def _apart(taken: list[tuple[int, int]], first: int, last: int) -> bool:
    """Whether the span meets none of the sorted, disjoint ones."""
    k = bisect_left(taken, (last + 1, 0))
    return k == 0 or taken[k - 1][1] < first


class Index:
    """The templates' words, numbered, and the inverted index of their fingerprints."""

    def __init__(self, templates: dict[str, str]):
        self.names, self.words, self.texts, self.kept = [], [], [], []
        self.number: dict[str, int] = {}
        for name, text in templates.items():
            words = [w.lower() for w in _WORD.findall(text)]
            self.names.append(name.partition("#")[0])
            self.words.append([self.number.setdefault(w, len(self.number) + 1) for w in words])
            self.texts.append(words if len(words) < NOTICE else None)
        # Hashes of word numbers, mixed so that no frequent word is always the smallest.
        self.mix = np.array([zlib.crc32(str(k).encode()) for k in range(len(self.number) + 1)], np.uint64)
        self.grams: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.words):
            codes = self.codes(np.array(ids, np.int64))
            kept = _winnow(codes).tolist()
            self.kept.append(len(kept))
            for at in kept:
                self.grams[int(codes[at])].append((t, at))

    def codes(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) < GRAM:
            return np.zeros(0, np.uint64)
        mixed, out = self.mix[ids], np.zeros(len(ids) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            out = out * np.uint64(0x100000001B3) + mixed[k : len(ids) - GRAM + 1 + k]
        return (out * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, least offset, greatest offset) of the votes that lie within a band."""
        votes: dict[int, set[int]] = defaultdict(set)
        places: dict[int, set[int]] = defaultdict(set)
        # A hash over a word that no template has cannot be in the index.
        if len(ids) < GRAM:
            return []
        full = np.convolve(ids > 0, np.ones(GRAM, np.int64), "valid") == GRAM
        if not full.any():
            return []
        codes = self.codes(ids)
        for at in np.flatnonzero(full).tolist():
            for t, place in self.grams.get(int(codes[at]), ()):
                votes[t].add(at - place)
                places[t].add(place)
        out = []
        for t, offsets in votes.items():
            # A long text that is covered enough has more fingerprints in common than some phrases.
            if len(self.words[t]) >= NOTICE and len(places[t]) < LEAST_SHARE * self.kept[t]:
                continue
            run = None
            for offset in sorted(offsets):
                if run is None or offset - run[1] > BAND:
                    run = [offset, offset]
                    out.append((t, run))
                run[1] = offset
        return [(t, low, high) for t, (low, high) in out]

    def align(
        self, ids: np.ndarray, t: int, low: int, high: int, begin: int, end: int, least: float
    ) -> list[tuple[int, int, int, int]]:
        """(-matched words, -score, first, last word in the text), best first, of the alignments in
        the band that lie from ``begin`` to before ``end`` and match ``least`` words.

        The score of a match is 2, of a word skipped on either side -1, and it never falls
        below zero: an agreement ends where too much lies between.
        """
        template = self.words[t]
        part = ids[begin:end].tolist()
        width = high - low + 2 * BAND
        out = []
        before: dict[int, tuple[int, int, int]] = {}
        for i, word in enumerate(template):
            now: dict[int, tuple[int, int, int]] = {}
            first = i + low - BAND - begin
            for j in range(max(0, first), min(len(part), first + width + 1)):
                found = (0, 0, j)  # score, matched, first
                if part[j] == word:
                    s, m, f = before.get(j - 1, (0, 0, j))
                    found = (s + 2, m + 1, f if m else j)
                    if found[1] >= least:
                        out.append((-found[1], -found[0], found[2] + begin, j + begin))
                for s, m, f in (before.get(j, (0, 0, j)), now.get(j - 1, (0, 0, j))):
                    if s - 1 > found[0]:
                        found = (s - 1, m, f)
                now[j] = found
            before = now
        # Among equals the one that ends earliest in the template, then in the text.
        return sorted(out, key=lambda x: x[:2])

    def matches(
        self, ids: np.ndarray, t: int, low: int, high: int, min_coverage: float
    ) -> list[tuple[int, int, int]]:
        """(matched words, first, last word in the text) of all matches of a candidate, apart."""
        size = len(self.words[t])
        out, least = [], max(1.0, min_coverage * size - 1e-9)
        left = [(max(0, low - BAND), min(len(ids), high + size + BAND))]
        while left:
            begin, end = left.pop()
            if end - begin < least:
                continue
            taken = []
            for matched, _, first, last in self.align(ids, t, low, high, begin, end, least):
                if _apart(taken, first, last):
                    insort(taken, (first, last))
                    out.append((-matched, first, last))
            if taken:
                edges = [begin, *(x for a, b in taken for x in (a, b + 1)), end]
                left += zip(edges[::2], edges[1::2], strict=True)
        return out

    def scan(self, text: str, min_coverage: float) -> list[tuple[str, int, int, int, float]]:
        """(licence, start, end, matched words, coverage), by start."""
        number = self.number.get
        words = list(_WORD.finditer(text))
        ids = np.array([number(m[0].lower(), 0) for m in words], np.int64)
        found = []
        for t, low, high in self.candidates(ids):
            for matched, first, last in self.matches(ids, t, low, high, min_coverage):
                own = self.texts[t]
                if own and not _same_licence(own, [m[0].lower() for m in words[first : last + 1]]):
                    continue
                found.append((-matched, -matched / len(self.words[t]), self.names[t], first, last))
        out, taken = [], []
        for matched, coverage, name, first, last in sorted(found):
            if _apart(taken, first, last):
                insort(taken, (first, last))
                out.append((name, words[first].start(), words[last].end(), -matched, -coverage))
        return sorted(out, key=lambda x: x[1])


def license_scan(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """(doc_id, license, start, end, n_words, coverage) of every match."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            found = [
                (k, *match)
                for k, text in enumerate(batch.column("text").to_pylist())
                if text
                for match in index.scan(text, min_coverage)
            ]
            columns = list(zip(*found, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(columns[0], pa.int64())),
                    pa.array(columns[1], pa.string()),
                    *(pa.array(columns[c], pa.int64()) for c in (2, 3, 4)),
                    pa.array(columns[5], pa.float64()),
                ],
                ["doc_id", "license", "start", "end", "n_words", "coverage"],
            )

    schema = (
        f"{schema_of(docs, 'doc_id')}, license string, start long, end long, "
        "n_words long, coverage double"
    )
    return docs.select("doc_id", "text").mapInArrow(rows, schema)
