"""Runs of periodically repeated words, by suffix-tree longest common extensions.

A run is a maximal stretch of consecutive words with smallest period q, at least ``MIN_WORDS`` and
``MIN_POWER * q`` words long. Every run has a Lyndon root: under the usual or the reversed order of
words, one whole period in it is the longest Lyndon word that starts at its place. So the longest
Lyndon word at each place, under both orders, is a candidate (place, period) and all runs are found
among these, two candidates a word. Each is extended to the right by the longest common extension
of its place and the place a period later, and to the left likewise in the reversed words; what
comes to the lengths named is a run. Extensions are depths of lowest common ancestors in two suffix
trees, of the words and of their reversal, built in one pass each (Ukkonen) and numbered by an
Euler tour; an ancestor is the minimum of a stretch of the tour, looked up in constant time. The
tour also gives the suffixes' ranks, and the next suffix of lower rank ends the Lyndon word.

Before that, stretches that cannot touch a run are left out, exactly: a run of power four or more
holds each of its groups of four words twice or more, so words that lie in no such group, counted
within the stretch between two left-out words, are in no run, nor does any run cross them. That
is repeated until nothing changes, for all documents of a batch at once, and only what stays is
put into trees.

Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; null and empty texts have none and no run.
Repeated rows and ids are worked on each by itself, an empty table gives an empty table, further
columns are not read. Memory grows with a batch of ``CHARS`` characters, or the longest text beyond.
Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.common import let, schema_of

#: The filter of stretches holds for a power of 4 and 6 words or more.
MIN_WORDS, MIN_POWER = 6, 4
GRAM = 4
CHARS = 1 << 21
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Marks the end of the words; before all of them in either order.
END = -1
#: Tour entries a block of the minimum table; a query looks at less than this one by one.
WIDTH = 16


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of numbers, with an Euler tour for common extensions."""

    def __init__(self, words: list[int]):
        self.words = [*words, END]
        self._build()

    def _build(self) -> None:
        """Extend all suffixes word by word; nodes are numbers, edges are ``words[start:stop]``."""
        words, n = self.words, len(self.words)
        start, stop, link = [-1], [0], [0]  # of the edge into each node; leaves end with the words
        child: list[dict[int, int] | None] = [{}]
        node, edge, length, left = 0, 0, 0, 0  # the active place, and the suffixes still to add
        for at, word in enumerate(words):
            left += 1
            inner = 0  # the node made last, whose link is due
            while left:
                if not length:
                    edge = at
                below = child[node].get(words[edge])
                if below is None:
                    child[node][words[edge]] = len(start)
                    start.append(at), stop.append(n), link.append(0), child.append(None)
                    if inner:
                        link[inner] = node
                        inner = 0
                else:
                    size = min(stop[below], at + 1) - start[below]
                    if length >= size:
                        node, edge, length = below, edge + size, length - size
                        continue
                    begin = start[below]
                    if words[begin + length] == word:
                        length += 1
                        if inner:
                            link[inner] = node
                        break
                    split = len(start)
                    start.append(begin), stop.append(begin + length), link.append(0)
                    child.append({words[begin + length]: below})
                    child[node][words[edge]] = split
                    start[below] = begin + length
                    child[split][word] = len(start)
                    start.append(at), stop.append(n), link.append(0), child.append(None)
                    if inner:
                        link[inner] = split
                    inner = split
                left -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = at - left + 1
        self.start, self.stop, self.child = start, stop, child

    def ranks(self, descending: bool = False) -> list[int]:
        """The place of each suffix among all in order; the end counts as the least word always."""
        n = len(self.words)
        rank, count = [0] * n, 0
        stack = [(0, 0)]
        while stack:
            node, depth = stack.pop()
            below = self.child[node]
            if below is None:
                rank[n - depth] = count
                count += 1
                continue
            # What is to come first goes onto the stack last.
            keys = sorted(below, reverse=not descending)
            if END in below:
                keys.remove(END)
                keys.append(END)
            for key in keys:
                at = below[key]
                stack.append((at, depth + self.stop[at] - self.start[at]))
        return rank

    def tour(self) -> None:
        """Depths of the nodes in Euler order, where each leaf stands, and minima of blocks."""
        n = len(self.words)
        depths: list[int] = []
        place = np.zeros(n, np.int64)
        # A node is met again, at its own depth, before each further child.
        stack = [(0, 0, False)]
        while stack:
            node, depth, again = stack.pop()
            below = self.child[node]
            if again or below is None:
                if below is None:
                    place[n - depth] = len(depths)
                depths.append(depth)
                continue
            first = True
            for at in below.values():
                if not first:
                    stack.append((node, depth, True))
                stack.append((at, depth + self.stop[at] - self.start[at], False))
                first = False
        self.place = place
        spare = -len(depths) % WIDTH
        flat = np.array(depths + [n] * spare, np.int64).reshape(-1, WIDTH)
        self.depths = flat
        self.from_left = np.minimum.accumulate(flat, axis=1)
        self.from_right = np.minimum.accumulate(flat[:, ::-1], axis=1)[:, ::-1]
        self.minima = [flat.min(axis=1)]
        while (size := 1 << len(self.minima)) <= len(flat):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[: -(size // 2)], last[size // 2 :]))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at ``a`` and at ``b`` (unequal)."""
        x, y = self.place[a], self.place[b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        left, right = x // WIDTH, y // WIDTH
        out = np.minimum(self.from_right[left, x % WIDTH], self.from_left[right, y % WIDTH])
        same = np.flatnonzero(left == right)
        if len(same):
            step = np.arange(WIDTH)
            rows = self.depths[left[same]]
            inside = (step >= (x[same] % WIDTH)[:, None]) & (step <= (y[same] % WIDTH)[:, None])
            out[same] = np.where(inside, rows, len(self.words)).min(axis=1)
        between = right - left - 1
        far = np.flatnonzero(between > 0)
        if len(far):
            level = np.frexp(between[far].astype(float))[1] - 1
            for k in np.unique(level):
                mine = far[level == k]
                table = self.minima[k]
                low = np.minimum(table[left[mine] + 1], table[right[mine] - (1 << int(k))])
                out[mine] = np.minimum(out[mine], low)
        return out


def _next_lower(rank: list[int]) -> list[int]:
    """The next place of lower rank, for each place but the last, which is the end's own."""
    out, open_ = [0] * (len(rank) - 1), []
    for at, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = at
        open_.append(at)
    return out


def runs_of(words: list[int], min_words: int = MIN_WORDS, min_power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``min_power`` >= 2 periods, by start."""
    n = len(words)
    if n < 2:
        return []
    ahead, back = SuffixTree(words), SuffixTree(words[::-1])
    ahead.tour()
    back.tour()
    at = np.arange(n)
    begins, periods = [], []
    for descending in (False, True):
        ends = np.array(_next_lower(ahead.ranks(descending)))
        begins.append(at)
        periods.append(ends - at)
    begin, period = np.concatenate(begins), np.concatenate(periods)
    inside = begin + period < n
    begin, period = begin[inside], period[inside]
    right = ahead.common(begin, begin + period)
    # The words before a place, backwards, are the suffix at n - place of the reversal.
    left = back.common(n - begin, n - begin - period)
    length = left + period + right
    enough = length >= np.maximum(min_words, min_power * period)
    found = np.stack([(begin - left)[enough], length[enough], period[enough]], axis=1)
    return sorted(set(map(tuple, found.tolist())), key=lambda r: (r[0], r[2]))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches that can hold runs, in the joined words of several documents.

    A group of four that only looks repeated, by an equal hash, keeps words and loses none.
    """
    n = len(words)
    if n < MIN_WORDS:
        return []
    gram = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(GRAM):
        gram = _mixed(gram + words[k : n - GRAM + 1 + k].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    at = np.flatnonzero(owner[: n - GRAM + 1] == owner[GRAM - 1 :])
    part = owner[at].astype(np.uint64)
    while len(at):
        # How often each group of four occurs in its stretch.
        key = gram[at] ^ _mixed(part + np.uint64(1))
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        twin = ordered[1:] == ordered[:-1]
        again = np.zeros(len(at), bool)
        again[order[1:]] |= twin
        again[order[:-1]] |= twin
        kept, own = at[again], part[again]
        if not len(kept):
            return []
        fresh = np.ones(len(kept), bool)
        fresh[1:] = (np.diff(kept) > 1) | (own[1:] != own[:-1])
        number = np.cumsum(fresh) - 1
        wide = np.bincount(number) >= MIN_WORDS - GRAM + 1
        kept, number = kept[wide[number]], number[wide[number]]
        if len(kept) == len(at):
            edge = np.flatnonzero(np.diff(number)) + 1
            first, last = np.concatenate([[0], edge]), np.concatenate([edge, [len(kept)]]) - 1
            return list(zip(kept[first].tolist(), (kept[last] + GRAM).tolist()))
        at, part = kept, number.astype(np.uint64)
    return []


def document_runs(texts: list[str]) -> list[tuple[list[str], list[tuple[int, int, int]]]]:
    """The words of each text and its runs (start, length, period), by start and period."""
    split = [WORD.findall(text) for text in texts]
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for words in split for w in words], np.int64)
    sizes = [len(words) for words in split]
    owner = np.repeat(np.arange(len(split)), sizes)
    begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for a, b in stretches(ids, owner):
        k = int(owner[a])
        out[k] += [(a - int(begin[k]) + s, n, q) for s, n, q in runs_of(ids[a:b].tolist())]
    return list(zip(split, out))


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    if not runs:
        return words
    return [w for w, k in zip(words, np.cumsum(gone)) if not k]


def in_turn(texts: list[str | None], chars: int = CHARS) -> Iterator[list[str]]:
    """The texts in order, null as empty, in lists of about so many characters."""
    some, size = [], 0
    for text in texts:
        some.append(text or "")
        size += len(text or "")
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, runs array<struct<start, length, period>>, collapsed): one row a document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in in_turn(batch.column("text").to_pylist()):
                found = document_runs(texts)
                names = ("start", "length", "period")
                runs = [[dict(zip(names, r)) for r in own] for _, own in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(at, len(texts)),
                        pa.array(runs, pa.list_(pa.struct([(n, pa.int64()) for n in names]))),
                        pa.array([" ".join(collapsed(w, own)) for w, own in found], pa.string()),
                    ],
                    ["doc_id", "runs", "collapsed"],
                )
                at += len(texts)

    kind = "array<struct<start: long, length: long, period: long>>"
    return docs.select("doc_id", "text").mapInArrow(
        rows, f"{schema_of(docs, 'doc_id')}, runs {kind}, collapsed string"
    )


def strongest(runs: Column) -> Column:
    """The run of greatest length per period; ties: the first, then the shortest period."""

    def better(a: Column, b: Column) -> Column:  # by products of whole numbers, exactly
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(y > x, b).otherwise(a)

    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def summary(found: DataFrame) -> DataFrame:
    """Per document the number of runs, the strongest one, and digests of all and of the collapsed text."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    best = F.col("best")
    return found.withColumn("best", strongest(F.col("runs"))).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[best[name].alias(name) for name in ("start", "length", "period")],
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """``docs`` where one document in ten goes on periodically from some word on.

    With h the CRC-32 of the id as decimal text and g = h div 10, a document with h mod 10 = 0 and
    n > 0 words has the original word a + (i - a) mod p in place of each word i >= a, where
    a = g mod n and p = 1 + (n - a) div (3 + g mod 8). Others stay, those without an id too.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def planted(words: Column) -> Column:
        n = F.size(words)

        def periodic(places: Column) -> Column:
            a, p = places["a"], places["p"]
            tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(words, a + i % p))
            return F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")

        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (g % 8 + 3))).cast("int")
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), periodic)).otherwise(F.lit(""))

    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, planted)).otherwise(F.col("text")).alias("text"))
