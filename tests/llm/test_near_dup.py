"""Fingerprints, the covering's guarantee, links and components against brute force."""

from __future__ import annotations

import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from stocklens.llm import near_dup


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    if 0 < len(words) < 3:
        shingles = [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def components_by_hand(prints, radius=3):
    ids = list(prints)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_masks_cover_every_radius():
    for seed in (0, 1):
        masks = near_dup.covering_masks(3, seed)
        assert len(masks) == 15
        for three in itertools.combinations(range(64), 3):
            bits = sum(1 << i for i in three)
            assert any(m & bits == 0 for m in masks)
    both = [m | n for m in near_dup.covering_masks(3, 0) for n in near_dup.covering_masks(3, 1)]
    assert min(m.bit_count() for m in both) >= 44  # a second deal leaves 2^20 nodes a bucket at most


def test_near_duplicates_by_brute_force(make_docs, corpus):
    got = near_dup.near_duplicates(make_docs(corpus)).collect()
    prints = {d: fingerprint_by_hand(text) for d, text, *_ in corpus}
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == components_by_hand(prints)
    hexed = make_docs(corpus).limit(1).select(near_dup.as_hex(F.lit(255)).alias("h")).first()["h"]
    assert hexed == f"{255:016x}"


def test_dense_groups_are_dealt_again(spark):
    """Chains and clouds of fingerprints, with buckets over the limit for direct comparison."""
    rng = random.Random(3)
    nodes = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(60):
            for k in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << k
            nodes.add(x)
    nodes |= {x ^ 1 << k for x in list(nodes)[:5] for k in range(64)}
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in nodes]
    for direct in (8, 256):
        pairs = near_dup.links(spark.createDataFrame(signed, "fp long"), 3, direct)
        for a, b in pairs.collect():
            assert ((a ^ b) % (1 << 64)).bit_count() <= 3
        roots = {r["node"]: r["root"] for r in near_dup.components(pairs).collect()}
        want = components_by_hand({x: x for (x,) in signed_as_unsigned(signed)})
        groups = {}
        for x, r in want.items():
            groups.setdefault(r, set()).add(x - (1 << 64) if x >> 63 else x)
        for members in groups.values():
            if len(members) > 1:
                assert {roots[m] for m in members} == {min(members)}
            else:
                assert not members & roots.keys()


def signed_as_unsigned(rows):
    return [(x % (1 << 64),) for (x,) in rows]


def test_long_chain_is_one_component(spark):
    pairs = spark.createDataFrame([(k, k + 1) for k in range(100)], "a long, b long")
    got = near_dup.components(pairs).collect()
    assert len(got) == 101 and {r["root"] for r in got} == {0}


def test_edges(make_docs):
    docs = make_docs([(5, None), (3, ""), (4, " "), (9, "a B"), (8, "A b"), (None, "x y z"), (8, "A b")])
    docs = docs.withColumn("fp", F.lit("other"))
    got = sorted((str(r["doc_id"]), r["component_id"]) for r in near_dup.near_duplicates(docs).collect())
    assert got == [("3", 3), ("4", 3), ("5", 3), ("8", 8), ("8", 8), ("9", 8), ("None", None)]
    assert sorted(str(r["doc_id"]) for r in near_dup.keep_one(docs).collect()) == ["3", "8", "None"]
    assert near_dup.keep_one(docs).columns == docs.columns
    assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_long_text():
    text = " ".join(str(k * k) for k in range(30000))
    assert near_dup.fingerprint(text) % (1 << 64) == fingerprint_by_hand(text)
    assert near_dup.spanning_links(np.array([], np.uint64)) == []
