"""SimHash near-dedup by covering locality-sensitive hashing.

Fingerprints: words are runs without white space, A-Z lower-cased; shingles of ``n_words`` words,
repeats included, are hashed by XXH64 (seed 42); a bit of the fingerprint is 1 if it is set in over
half of the hashes. Fingerprints link when they differ in at most ``radius`` bits.

Candidates: give each of the 64 positions a nonzero vector m(i) of radius + 1 bits; table v, for
each nonzero v, keeps the positions where <m(i), v> is odd. The vectors of any ``radius`` differing
positions leave some nonzero v orthogonal to all of them, so that table keeps none of them and
the pair shares its value there: no pair within the radius is missed, by construction.

Equal fingerprints are one node, so copies cost nothing. A bucket's nodes give a spanning forest of
their links, never all pairs. Buckets of more than ``direct`` nodes are dealt again by a second,
independent covering: members then agree on the union of two masks, so that the free bits bound
a bucket whatever the data. Components come from alternating star contractions.

Null text or a text without words has fingerprint zero, linked like any other. Rows that repeat a
doc_id each have a fingerprint; their links join the components. A row without doc_id gets the
component of its fingerprint. An empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stocklens.llm.common import in_small_batches, saved, schema_of

BITS = 64
N_WORDS, RADIUS, SEED, DIRECT = 3, 3, 42, 256


def fingerprint(text: str | None, n_words: int = N_WORDS) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < n_words:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(n_words)), strict=False))
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, n_words: int = N_WORDS) -> DataFrame:
    """(doc_id, fp)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x, n_words) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"]
            )

    sent = in_small_batches(docs.select("doc_id", "text"))
    return sent.mapInArrow(rows, f"{schema_of(docs, 'doc_id')}, fp long")


def covering_masks(radius: int = RADIUS, seed: int = 0) -> list[int]:
    """2^(radius + 1) - 1 masks of 64 bits: any ``radius`` positions are all left out of one."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(BITS)]
    vectors = np.random.default_rng(seed).permutation(vectors).tolist()
    return [
        sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)
    ]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def spanning_links(nodes: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links that connect the distinct ``nodes`` as all links within the radius would."""
    rest, links = nodes, []
    while rest.size > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and rest.size:
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= radius
            if near.any():
                found = rest[near]
                links += [(node, other) for other in found]
                queue.extend(found)
                rest = rest[~near]
    return links


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b), a < b, from a column ``nodes`` of arrays."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for nodes in batch.column("nodes"):
                links += spanning_links(nodes.values.to_numpy().view(np.uint64), radius)
            pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
            pairs.sort(axis=1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"]
            )

    return buckets.select("nodes").mapInArrow(rows, "a long, b long")


def links(nodes: DataFrame, radius: int = RADIUS, direct: int = DIRECT) -> DataFrame:
    """(a, b): links that connect distinct fingerprints ``fp`` as all links would."""
    first, second = covering_masks(radius, 0), covering_masks(radius, 1)

    def mask(masks: list[int], table: str) -> Column:
        return F.get(F.array(*[F.lit(_signed(m)) for m in masks]), F.col(table))

    tables = F.explode(F.sequence(F.lit(0), F.lit(len(first) - 1)))
    placed = nodes.select("fp", tables.alias("t")).withColumn(
        "k", F.col("fp").bitwiseAND(mask(first, "t"))
    )
    sizes = placed.groupBy("t", "k").agg(F.count("*").alias("_n")).where("_n > 1")
    shared = placed.join(sizes, ["t", "k"])
    small = (
        shared.where(F.col("_n") <= direct).groupBy("t", "k").agg(F.collect_list("fp").alias("nodes"))
    )
    large = (
        shared.where(F.col("_n") > direct)
        .select("t", "fp", tables.alias("u"))
        .withColumn("k", F.col("fp").bitwiseAND(mask(first, "t").bitwiseOR(mask(second, "u"))))
        .groupBy("t", "u", "k")
        .agg(F.collect_list("fp").alias("nodes"))
        .where(F.size("nodes") > 1)
    )
    return _links(small, radius).unionByName(_links(large, radius)).distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of the nodes of ``pairs`` (a, b); root is the smallest node reachable."""

    def large_star(edges: DataFrame) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Saved, so that a hub with most of the edges is not bound to the task that finds its
        # minimum: the join can split its rows, or broadcast the minima if they are few.
        least = saved(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
        return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")

    def small_star(edges: DataFrame) -> DataFrame:
        least = saved(edges.groupBy("b").agg(F.min("a").alias("m")))
        joined = edges.join(least, "b")
        out = joined.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        return out.unionByName(least.select(F.col("m").alias("a"), "b"))

    def mark(edges: DataFrame):
        return edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()

    edges = saved(pairs.select("a", "b").where("a < b").distinct())
    before, now = None, mark(edges)
    while now != before:
        edges = saved(small_star(large_star(edges)).where("a < b").distinct())
        before, now = now, mark(edges)
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(
    docs: DataFrame, n_words: int = N_WORDS, radius: int = RADIUS, direct: int = DIRECT
) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that the document reaches."""
    prints = saved(fingerprints(docs, n_words))
    nodes = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(nodes.select("fp"), radius, direct))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, **rule) -> DataFrame:
    """The document with the smallest doc_id of each group, one row each.

    Rows without doc_id stay, as nothing can name them.
    """
    found = near_duplicates(docs, **rule)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(docs.columns)
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
