"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

Texts become words (runs of letters and digits, lower case), words hashes. A seed hashes the words
that a mask selects from ``SPAN`` words in a row and ignores the others, so that substituted words
may stand there. Seeds of documents and benchmark items join on their hash; a hit gives a document,
an item and how they lie against each other. Around each hit, all words of the item are held
against the document: the pair is contaminated when some ``WINDOW`` words in a row of the item
(all of it, if shorter) agree with the document but for ``SUBSTITUTED`` words at most; one in items
of 8 to 12 words, none in shorter ones.

No such overlap is missed. The masks were chosen so that any two substitutions in 13 words leave
one of the two masks whole somewhere. One substitution in 8 to 12 words leaves the first or the
last ``END`` words whole, which are the seeds of such items; shorter items are seeds as a whole.

A masked seed that more than ``COMMON`` places of the benchmark share (a phrase that many items hold)
proves little and would meet all its places in every document that has it. There the windows of
``WINDOW`` words around it are compared instead, by one seed for each choice of substituted words:
these join only windows that do overlap. Before the joins, positions of documents are tested
against bitmaps of the benchmark's seeds, which only ever let too much through and keep the shuffle
near the number of true hits. They have ``BITS_PER_SEED`` bits a seed, 64 KB to 2 MB. Spark
broadcasts or shuffles the seeds by their size.

Null text has no words. Rows that repeat a doc_id or item_id are one document or item with all
their words. Rows without an id are not compared (``clean`` keeps such documents), nor are items
without a word. Empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.common import let, saved

MASKS = ("11101011", "11001111")
SPAN = 8
WINDOW, SUBSTITUTED = 13, 2
#: Words of the seeds at both ends of items shorter than a window; items shorter than ``SPAN`` are seeds.
END = 4
#: Places of the benchmark that share a seed before whole windows are compared.
COMMON = 64
BITS_PER_SEED, LEAST_BITS, MOST_BITS = 16, 19, 24
#: Seeds are told apart by their kind: masks from 0, ends, windows, then whole items by their length.
_ENDS, _WINDOWS, _WHOLE = 10, 11, 20


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def allowed(n: Column) -> Column:
    """How many words of the best window of an item of ``n`` words may be substituted."""
    window = F.least(F.lit(WINDOW), n)
    return F.when(n < SPAN, 0).otherwise(F.floor(window * SUBSTITUTED / WINDOW))


def _pair(h: Column, i: Column) -> Column:
    """Hash of the word at ``i`` (from 1) and the next; every mask begins with these two."""
    return F.xxhash64(F.get(h, i - 1), F.get(h, i))


def _seeds(h: Column) -> Column:
    """(kind, h), one a mask, of ``SPAN`` word hashes."""
    kept = [[k for k, x in enumerate(m) if x == "1"] for m in MASKS]
    return F.array(
        *[
            F.struct(F.lit(n).alias("kind"), F.xxhash64(F.lit(n), *[F.get(h, F.lit(k)) for k in ks]).alias("h"))
            for n, ks in enumerate(kept)
        ]
    )


def _phrase(kind: int, h: Column, i: Column, length: int) -> Column:
    """(kind, h) of ``length`` words in a row from ``i`` (from 1)."""
    return F.struct(F.lit(kind).alias("kind"), F.xxhash64(F.lit(kind), F.slice(h, i, F.lit(length))).alias("h"))


def _window_seeds(h: Column) -> Column:
    """(kind, h) of ``WINDOW`` word hashes, one for each choice of ``SUBSTITUTED`` words left out."""
    gone = [F.array(F.lit(p), F.lit(q)) for p in range(WINDOW) for q in range(p)]
    rest = lambda pair: F.filter(h, lambda _, k: ~F.array_contains(pair, k))
    return F.transform(
        F.array(*gone),
        lambda pair: F.struct(F.lit(_WINDOWS).alias("kind"), F.xxhash64(pair, rest(pair)).alias("h")),
    )


@dataclass(frozen=True)
class Bitmap:
    """Bits of hashes, as an array of longs of 2^(log - 6) entries."""

    words: Column
    log: int

    def has(self, h: Column) -> Column:
        place = h.bitwiseAND(F.lit((1 << self.log) - 1))
        return F.getbit(F.get(self.words, F.shiftright(place, 6).cast("int")), (place % 64).cast("int")) == 1


def _bitmap(hashes: DataFrame, n: int) -> Bitmap:
    """A bitmap of the column ``h`` for about ``n`` hashes, a constant."""
    log = min(MOST_BITS, max(LEAST_BITS, (BITS_PER_SEED * n).bit_length()))
    place = F.col("h").bitwiseAND(F.lit((1 << log) - 1))
    words = (
        hashes.select(F.shiftright(place, 6).alias("w"), (place % 64).cast("int").alias("b"))
        .groupBy("w")
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b"))).alias("v"))
    )
    bits = [0] * (1 << (log - 6))
    for row in words.collect():
        bits[row["w"]] = row["v"]
    return Bitmap(F.from_json(F.lit(json.dumps(bits)), "array<bigint>"), log)


def _places(h: Column, length: int) -> Column:
    """Positions from 1 at which ``length`` words in a row begin."""
    return F.when(F.size(h) >= length, F.sequence(F.lit(1), F.size(h) - (length - 1))).otherwise(F.array().cast("array<int>"))


def _spans(h: Column, good=None) -> Column:
    """(i, s): positions from 1 that ``good`` accepts, and the word hashes from there."""
    at = _places(h, SPAN)
    at = at if good is None else F.filter(at, lambda i: good(h, i))
    return F.transform(at, lambda i: F.struct(i.alias("i"), F.slice(h, i, F.lit(SPAN)).alias("s")))


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, ih): distinct items that have an id and a word, with their word hashes."""
    return (
        benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
        .select("item_id", word_hashes(F.col("text")).alias("ih"))
        .distinct()
        .where(F.size("ih") >= 1)
        .select(F.xxhash64("item_id", "ih").alias("item"), "item_id", "ih")
    )


def _item_seeds(items: DataFrame, lengths: list[int]) -> DataFrame:
    """(kind, h, item, n, j): the seeds of items and where in them they begin, from 1."""
    h, n = F.col("ih"), F.size("ih")
    masked = F.transform(
        _places(h, SPAN), lambda j: F.struct(_seeds(F.slice(h, j, F.lit(SPAN))).alias("seeds"), j.alias("j"))
    )
    ends = [F.lit(1), F.greatest(n - (END - 1), F.lit(1))]
    ended = F.array(*[F.struct(F.array(_phrase(_ENDS, h, j, END)).alias("seeds"), j.alias("j")) for j in ends])
    # Whole items have all the words there are.
    whole = F.struct((F.lit(_WHOLE) + n).alias("kind"), F.xxhash64(F.lit(_WHOLE) + n, h).alias("h"))
    single = F.array(F.struct(F.array(whole).alias("seeds"), F.lit(1).alias("j")))
    found = F.when(n >= WINDOW, masked)
    if any(SPAN <= k < WINDOW for k in lengths):
        found = found.when(n >= SPAN, ended)
    if any(k < SPAN for k in lengths):
        found = found.when(n < SPAN, single)
    spread = items.select("item", n.alias("n"), F.explode(found).alias("p"))
    return spread.select(F.explode("p.seeds").alias("seed"), "item", "n", "p.j").select("seed.*", "item", "n", "j").distinct()


def _candidates(texts: DataFrame, items: DataFrame, seeds: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, i, kind, h): places of documents whose seeds the bitmaps know."""
    out = []
    if any(k >= WINDOW for k in lengths):
        masked = seeds.where(F.col("kind") < _ENDS)
        spans = items.where(F.size("ih") >= WINDOW).select(F.explode(_spans(F.col("ih"))).alias("p"))
        n = masked.count()
        pairs = _bitmap(spans.select(_pair(F.col("p.s"), F.lit(1)).alias("h")), n)
        known = _bitmap(masked.select("h"), n)
        found = let(word_hashes(F.col("text")), lambda h: _spans(h, lambda x, i: pairs.has(_pair(x, i))))
        places = texts.select("doc_id", F.explode(found).alias("p"))
        hashed = places.select("doc_id", F.col("p.i").alias("i"), F.explode(_seeds(F.col("p.s"))).alias("seed"))
        out.append(hashed.select("doc_id", "i", "seed.*").where(known.has(F.col("h"))))
    short = [(_WHOLE + k, k) for k in lengths if k < SPAN]
    if any(SPAN <= k < WINDOW for k in lengths):
        short.append((_ENDS, END))
    if short:
        rest = seeds.where(F.col("kind") >= _ENDS)
        known = _bitmap(rest.select("h"), rest.count())

        def phrases(h: Column, kind: int, length: int) -> Column:
            at = F.transform(_places(h, length), lambda i: F.struct(i.alias("i"), _phrase(kind, h, i, length).alias("seed")))
            return F.filter(at, lambda p: known.has(p["seed"]["h"]))

        found = let(word_hashes(F.col("text")), lambda h: F.concat(*[phrases(h, kind, length) for kind, length in short]))
        places = texts.select("doc_id", F.explode(found).alias("p"))
        out.append(places.select("doc_id", "p.i", "p.seed.*"))
    return reduce(DataFrame.unionByName, out)


def _window_hits(texts: DataFrame, items: DataFrame, places: DataFrame, common: DataFrame) -> DataFrame:
    """(doc_id, item, n, d) of windows that overlap, around seeds that are ``common`` in the benchmark.

    ``places`` (doc_id, i) are the seeds' places in documents.
    """
    reach = WINDOW - SPAN
    starts = lambda i, n: F.sequence(F.greatest(i - reach, F.lit(1)), F.least(i, n - (WINDOW - 1)))
    cut = lambda h: F.slice(h, F.col("at"), F.lit(WINDOW))
    of_items = (
        items.join(common.select("item", "j").distinct(), "item")
        .where(F.size("ih") >= WINDOW)
        .select("item", F.size("ih").alias("n"), "ih", F.explode(starts(F.col("j"), F.size("ih"))).alias("at"))
        .select("item", "n", "at", F.explode(_window_seeds(cut(F.col("ih")))).alias("seed"))
        .select("item", "n", F.col("at").alias("j"), "seed.h")
        .distinct()
    )
    near = places.groupBy("doc_id").agg(F.collect_set("i").alias("held"))
    size = F.size("dh")
    of_docs = (
        texts.join(near, "doc_id")
        .select("doc_id", word_hashes(F.col("text")).alias("dh"), "held")
        # A text that ends inside the window has no window, as an item has none that ends outside it.
        .where(size >= WINDOW)
        .select("doc_id", "dh", F.explode(F.array_distinct(F.flatten(F.transform(F.filter("held", lambda i: i - reach <= size - (WINDOW - 1)), lambda i: starts(i, size))))).alias("at"))
        .select("doc_id", "at", F.explode(_window_seeds(cut(F.col("dh")))).alias("seed"))
        .select("doc_id", F.col("at").alias("i"), "seed.h")
    )
    return of_docs.join(of_items, "h").select("doc_id", "item", "n", (F.col("i") - F.col("j")).alias("d"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, at_word, n_matched, n_item_words, overlap) of contaminated pairs.

    ``at_word`` is the place of the item's first word in the document, counted from 0 in words;
    it is negative where the document begins inside the item.
    """
    items = _items(benchmark)
    # At most as many as there are lengths below a window; longer ones count as one.
    lengths = [r["n"] for r in items.select(F.least(F.size("ih"), F.lit(WINDOW)).alias("n")).distinct().collect()]
    if not lengths:
        none = docs.limit(0).crossJoin(benchmark.limit(0).select(F.col("item_id").alias("_item")))
        zero = F.lit(0).cast("long")
        return none.select(
            "doc_id", F.col("_item").alias("item_id"), zero.alias("at_word"), zero.alias("n_matched"),
            zero.alias("n_item_words"), F.lit(0.0).alias("overlap"),
        )
    seeds = _item_seeds(items, lengths)
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    found = _candidates(texts, items, seeds, lengths)
    shared = seeds.where(F.col("kind") < _ENDS).groupBy("kind", "h").agg(F.count("*").alias("_n")).where(F.col("_n") > COMMON)
    if shared.isEmpty():
        hits = found.join(seeds, ["kind", "h"])
        hits = hits.select("doc_id", "item", "n", (F.col("i") - F.col("j")).alias("d")).distinct()
    else:
        shared = saved(shared.select("kind", "h"))
        few = found.join(seeds.join(shared, ["kind", "h"], "left_anti"), ["kind", "h"])
        few = few.select("doc_id", "item", "n", (F.col("i") - F.col("j")).alias("d"))
        places = found.join(shared, ["kind", "h"], "left_semi").select("doc_id", "i")
        common = seeds.join(shared, ["kind", "h"], "left_semi")
        hits = few.unionByName(_window_hits(texts, items, places, common)).distinct()
    near = hits.groupBy("doc_id").agg(F.collect_list(F.struct("item", "n", "d")).alias("hits"))
    begin = F.greatest(F.col("hit.d"), F.lit(0))
    beside = (
        texts.join(near, "doc_id")
        .select("doc_id", "hits", word_hashes(F.col("text")).alias("dh"))
        .select("doc_id", "dh", F.explode("hits").alias("hit"))
        .select(
            "doc_id",
            "hit.item",
            "hit.d",
            F.slice("dh", begin + 1, F.col("hit.n")).alias("dh"),
        )
    )
    shift = F.col("d") - F.greatest(F.col("d"), F.lit(0))
    same = F.transform("ih", lambda w, j: F.coalesce(F.get(F.col("dh"), j + shift) == w, F.lit(False)))
    n = F.size("ih")
    window = F.least(F.lit(WINDOW), n)
    best = let(
        F.col("same"),
        lambda s: F.array_max(
            F.transform(
                F.sequence(F.lit(1), n - window + 1),
                lambda i: F.size(F.filter(F.slice(s, i, window), lambda x: x)),
            )
        ),
    )
    checked = beside.join(items, "item").withColumn("same", same)
    return (
        checked.where(best >= window - allowed(n))
        .select(
            "doc_id",
            "item_id",
            n.alias("n"),
            F.size(F.filter("same", lambda x: x)).alias("n_matched"),
            (-F.col("d")).alias("back"),
        )
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("n_matched", "back", "n")).alias("m"))
        .select(
            "doc_id",
            "item_id",
            (-F.col("m.back")).cast("long").alias("at_word"),
            F.col("m.n_matched").cast("long").alias("n_matched"),
            F.col("m.n").cast("long").alias("n_item_words"),
            (F.col("m.n_matched") / F.col("m.n")).alias("overlap"),
        )
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no benchmark item contaminates."""
    found = overlaps(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
