"""Best-fit packing of token sequences by swap-based local search.

Each document becomes its token ids and a final 0. Only documents longer than a sequence are cut,
into pieces of full length and a last shorter one. Pieces are dealt by hash into blocks of about
``BLOCK`` pieces, whose size does not grow with the table; each block is packed by best fit,
longest piece first, and improved by local search over its underfull sequences: pieces move,
trade places one for one, or two for one, whenever that raises the sum of squared fills, until the
sequences that lose pieces are empty and go. What a block leaves poorly filled is dealt again, in
fewer blocks, and packed anew.

Only (id, position, length, checksum) of a piece is shuffled, never text. Null text is empty: a
single 0. Rows that repeat a doc_id are packed each by itself. An empty table gives an empty table;
further columns are not read.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stocklens.llm.common import in_small_batches, saved, schema_of

LENGTH, END = 2048, 0
IDS = np.dtype("<u4")
#: A private-use character between parts that are encoded together.
MARKER = "\ue000"
#: Pieces, and runs of letters remembered at a time; those met since are twice as many at most.
BLOCK, CACHE = 3000, 200_000
#: Sequences filled less than this share go into the second deal.
SETTLED = 0.995
PIECE = "piece int, start long, length long, ids_crc32 long"
#: Letters, single digits and runs of signs, which the tokenizer sets apart; no apostrophes.
_SPLIT = re.compile(r"[a-zà-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
_RUN = re.compile(r"[a-zà-öø-ÿ]+")
_SIGNS = ",.;:!?"
# How tokenizers that split so are described in their files.
_STEPS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_END = "</w>"


def _lowered(text: str) -> str:
    """In lower case where that is sure."""
    if not text.isascii():
        try:
            text.encode("latin-1")  # then it holds no combining marks and no letters that need context
        except UnicodeEncodeError:
            return text
    return text.lower()


class Encoder:
    """Token ids of whole texts, as bytes, remembering those of words met before.

    A tokenizer that splits at white space, and letters from digits and signs, gives a text the
    ids of its parts, one after the other. So words are taken apart, and the ids of each new run of
    letters are found once, many runs at a time, by a tokenizer that has the same vocabulary and
    does nothing else; the tokens that end words tell the runs apart. Words with other characters
    go through the whole tokenizer, with a marker between them whose ids stand for its bytes,
    which no word without it can yield. Other kinds of tokenizers encode whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        spec = json.loads(self.tokenizer.to_str())
        self.by_words = _splits_words(spec)
        if self.by_words:
            self.marker = self._ids(MARKER)
            self.signs = {x: self._ids(x).tobytes() for x in _SIGNS}
            self.plain = Tokenizer.from_file(path)
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            added = [re.escape(x["content"]) for x in spec["added_tokens"]]
            self.added = re.compile("|".join(added) or "(?!)").search
            self.ends[[k for token, k in vocabulary.items() if token.endswith(_WORD_END)]] = True

    def _ids(self, text: str) -> np.ndarray:
        (found,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, IDS)

    def _ids_of(self, words: list[str]) -> list[bytes]:
        """The ids of different words; their parts are remembered, signs after letters only once."""
        if len(self.known) > CACHE:
            # What the next texts use is found among the older ones and stays.
            self.known, self.older = {}, self.known
        known, older, signs, letters = self.known, self.older, self.signs, _RUN.fullmatch
        ids = list(map(known.get, words))
        runs: set[str] = set()
        waiting, mixed = [], []
        for at, x in enumerate(ids):
            if x is not None:
                continue
            w = words[at]
            if letters(w):
                base, sign = w, b""
            elif w and w[-1] in signs and letters(w[:-1]):
                base, sign = w[:-1], signs[w[-1]]
            else:
                mixed.append(at)
                continue
            x = known.get(base)
            if x is None and (x := older.get(base)) is not None:
                known[base] = x
            if x is None:
                waiting.append((at, base, sign))
                runs.add(base)
            else:
                ids[at] = x + sign if sign else x
        parts = []
        for at in mixed:
            w = words[at]
            own = _SPLIT.findall(w.lower() if w.isascii() else w)
            parts.append((at, own if sum(map(len, own)) == len(w) and not self.added(w) else [w]))
        others = set()
        for x in set(chain.from_iterable(own for _, own in parts)).difference(known):
            if x in older:
                known[x] = older[x]
            else:
                (runs if letters(x) else others).add(x)
        self._learn_runs(list(runs))
        self._learn_others(list(others))
        for at, base, sign in waiting:
            ids[at] = known[base] + sign
        for at, own in parts:
            ids[at] = b"".join([known[x] for x in own])
        return ids

    def _learn_runs(self, runs: list[str]) -> None:
        for at in range(0, len(runs), 2000):
            some = runs[at : at + 2000]
            (found,) = self.plain.encode_batch_fast([some], is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, IDS)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):
                self._learn_others(some)
                continue
            raw, stops = ids.tobytes(), (4 * stops).tolist()
            self.known.update(zip(some, [raw[a:b] for a, b in zip([0, *stops], stops)]))

    def _learn_others(self, words: list[str]) -> None:
        plain = [w for w in words if MARKER not in w]
        self.known.update((w, self._ids(w).tobytes()) for w in words if MARKER in w)
        width = len(self.marker)
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = self._ids(f" {MARKER} ".join(some))
            ends = np.ones(max(0, len(ids) - width + 1), bool)
            for k, x in enumerate(self.marker):
                ends &= ids[k : len(ids) - width + 1 + k] == x
            stops = [*np.flatnonzero(ends).tolist(), len(ids)]
            raw, begin = ids.tobytes(), 0
            for word, stop in zip(some, stops, strict=True):
                self.known[word] = raw[4 * begin : 4 * stop]
                begin = stop + width

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        stop = np.array([END], IDS)
        if not self.by_words:
            found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            return [np.array([*x.ids, END], IDS) for x in found]
        # What stands between blanks and line ends: each different word is looked up once.
        lines = pa.array(map(_lowered, texts), pa.large_string())
        words = pc.split_pattern(pc.replace_substring(lines, "\n", " "), " ")
        ends = np.cumsum(words.value_lengths().to_numpy())
        words = words.flatten().dictionary_encode()
        ids = self._ids_of(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        starts = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // IDS.itemsize, out=starts[1:])
        found = pa.LargeListArray.from_arrays(starts, np.frombuffer(b"".join(ids), IDS)).take(words.indices)
        values, stops = found.flatten().to_numpy(), found.offsets.to_numpy()[ends].tolist()
        return [np.append(values[a:b], stop) for a, b in zip([0, *stops], stops)]


def _splits_words(spec: dict) -> bool:
    """Whether a tokenizer is of the kind whose words can be encoded one by one."""
    steps, rules = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    steps, rules = steps.get("normalizers", []), rules.get("pretokenizers", [])
    return (
        ([x["type"] for x in steps], [x["type"] for x in rules]) == _STEPS
        and rules[0]["pattern"] == {"Regex": _RULE}
        and rules[0]["invert"]
        and spec["model"].get("end_of_word_suffix") == _WORD_END
        and all(not x["content"].isalpha() and not re.search(r"\s", x["content"]) for x in spec["added_tokens"])
    )


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for all tasks that a worker runs."""
    return Encoder(path)


def _in_turn(texts: list[str | None], chars: int = 1 << 22) -> Iterator[list[str]]:
    """The texts in order, in lists of about so many characters."""
    some, size = [], 0
    for text in texts:
        some.append(text or "")
        size += len(text or "")
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            at, out = [], []
            encoded = chain.from_iterable(map(encode, _in_turn(batch.column("text").to_pylist())))
            for k, ids in enumerate(encoded):
                for piece, start in enumerate(range(0, len(ids), length)):
                    part = ids[start : start + length]
                    at.append(k)
                    out.append((piece, start, len(part), zlib.crc32(part.tobytes())))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int64())),
                    pa.array(columns[0], pa.int32()),
                    *(pa.array(c, pa.int64()) for c in columns[1:]),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    found = in_small_batches(docs.select("doc_id", "text"))
    return found.mapInArrow(rows, f"{schema_of(docs, 'doc_id')}, {PIECE}")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of piece numbers: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = bisect.bisect_left(room, (lengths[k], -1))
        if at == len(room):
            free, b = capacity, len(bins)
            bins.append([])
        else:
            free, b = room.pop(at)
        bins[b].append(k)
        if free > lengths[k]:
            bisect.insort(room, (free - lengths[k], b))
    return bins


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> None:
    """Local search in place; emptied bins stay as empty lists.

    Every step raises the sum of squared fills, which is bounded. It ends when none does, or when
    no fewer bins could hold the pieces.
    """
    fill = [sum(lengths[k] for k in b) for b in bins]
    least = -(-sum(fill) // capacity)
    changed = True
    while changed and sum(1 for x in fill if x) > least:
        changed = False
        under = [b for b in range(len(bins)) if 0 < fill[b] < capacity]
        for donor in sorted(under, key=lambda b: fill[b]):
            while bins[donor] and (step := _best_step(donor, under, bins, fill, lengths, capacity)):
                target, given, taken = step
                moved = sum(lengths[k] for k in given) - sum(lengths[k] for k in taken)
                bins[donor] = [k for k in bins[donor] if k not in given] + list(taken)
                bins[target] = [k for k in bins[target] if k not in taken] + list(given)
                fill[donor] -= moved
                fill[target] += moved
                changed = True


def _choices(members: list[int], lengths: list[int]) -> tuple[list[tuple[int, tuple]], list[tuple[int, tuple]]]:
    """Single pieces and pairs by their length, shortest first, one of each length.

    A bin has few different lengths, as they add up to its capacity at most, so these are few
    however many pieces it holds.
    """
    by_size: dict[int, list[int]] = {}
    for k in members:
        by_size.setdefault(lengths[k], []).append(k)
    sizes = sorted(by_size)
    pairs: dict[int, tuple] = {}
    for i, x in enumerate(sizes):
        if len(by_size[x]) > 1:
            pairs.setdefault(2 * x, tuple(by_size[x][:2]))
        for y in sizes[i + 1 :]:
            pairs.setdefault(x + y, (by_size[x][0], by_size[y][0]))
    return [(x, (by_size[x][0],)) for x in sizes], sorted(pairs.items())


def _best_step(donor, under, bins, fill, lengths, capacity):
    """The step from ``donor`` that raises the squared fill most: (bin, pieces given, taken).

    Moving d tokens changes the sum of squares by 2 d (target - donor + d), so into one bin the
    largest d that fits is best, and the room of a bin bounds what it can bring.
    """
    singles, pairs = _choices(bins[donor], lengths)
    one_sizes, two_sizes = [x for x, _ in singles], [x for x, _ in pairs]
    hopeful = []
    for target in under:
        free = capacity - fill[target]
        if target != donor and free > 0 and (most := 2 * free * (fill[target] - fill[donor] + free)) > 0:
            hopeful.append((-most, target))
    best, gain = None, 0
    for most, target in sorted(hopeful):
        if -most <= gain:
            break
        free = capacity - fill[target]
        ones, twos = _choices(bins[target], lengths)
        tries = [(singles, one_sizes, [(0, ()), *ones, *twos]), (pairs, two_sizes, ones)]
        for gifts, sizes, backs in tries:
            for back, taken in backs:
                at = bisect.bisect_right(sizes, free + back) - 1
                if at >= 0 and (d := sizes[at] - back) > 0 and (value := 2 * d * (fill[target] - fill[donor] + d)) > gain:
                    best, gain = (target, gifts[at][1], taken), value
    return best


def _packed(block: pd.DataFrame, capacity: int, number: int) -> pd.DataFrame:
    block = block.sort_values(["length", "doc_id", "piece", "start"], ignore_index=True)
    lengths = block["length"].tolist()
    bins = best_fit(lengths, capacity)
    improve(bins, lengths, capacity)
    sequence, offset = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
    filled = np.zeros(len(block), np.int64)
    for b, members in enumerate(x for x in bins if x):
        at = 0
        for k in members:
            sequence[k], offset[k] = (number << 24) + b, at
            at += lengths[k]
        filled[members] = at
    return block.assign(sequence_id=sequence, offset=offset, _fill=filled)


def pack(found: DataFrame, length: int = LENGTH, block: int = BLOCK) -> DataFrame:
    """``found`` (from ``pieces``) with sequence_id and offset."""
    names = found.columns
    kind = ", ".join(f"{n} {k}" for n, k in found.dtypes)

    def dealt(df: DataFrame, deal: int) -> DataFrame:
        blocks = max(1, -(-df.count() // block))
        place = F.pmod(F.xxhash64(F.lit(deal), "doc_id", "piece"), F.lit(blocks))

        def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            out = _packed(rows[names], length, 2 * int(key[0]) + deal)
            return out[[*names, "sequence_id", "offset", "_fill"]]

        packed = df.withColumn("_block", place).groupBy("_block")
        return packed.applyInPandas(one, f"{kind}, sequence_id long, offset long, _fill long")

    first = saved(dealt(found, 0))
    settled = F.col("_fill") >= SETTLED * length
    second = dealt(first.where(~settled).select(names), 1)
    return first.where(settled).unionByName(second).drop("_fill")


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH) -> DataFrame:
    """One row a piece: what it holds, the sequence it goes to and its place there."""
    return pack(saved(pieces(docs, tokenizer, length)), length)
