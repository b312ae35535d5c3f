"""Sharding by balanced label propagation under the law of even row counts.

Documents are linked through hubs: a hub is whatever several documents have in common (their text,
a page, a group), and all documents of a hub are neighbours of each other. Every linked document
starts in the shard its hash names. Then, round by round, each hub chooses the shards its members
should gather in (the one where most are, if the whole hub fits there; else as few as take it) and
members elsewhere vote with their hubs where to move. Moves into a shard are admitted as far as it
has room, counting the documents that leave it in the same round, so full shards exchange documents
among each other; during the rounds a shard may exceed its quota by a share of ``SLACK``. Rounds go
on while they leave fewer documents apart from their hubs, and end when nothing moves.

At the end the shards are made even. Those above their quota let documents go, hub by hub, and
what was let go fills the shards below theirs, hub by hub again, so that a hub is cut for the sake
of evenness at the edge of a quota only. Documents without links belong anywhere and fill up the
rest. The shards' row counts differ by one at most.

Neighbours are never listed: a hub's members are counted per shard, at most one row a shard. Rooms,
loads and flows are one number a shard or pair of shards. Numbers within a shard come from offsets
of blocks whose number grows with the table; a large hub is spread over blocks.

Every row is a document: rows that repeat a doc_id, or have none, are placed each by itself, and
rows of equal text are linked whatever their ids. A null text has no links. An empty table gives an
empty table; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocklens.llm.common import stored

SHARDS = 24
#: What a shard may hold beyond its quota while rounds go on, and rounds without gain that end them.
SLACK, PATIENCE = 0.2, 2
#: Blocks in which rows are numbered: at least so many, and no more than so many rows in one by chance.
BLOCKS, BLOCK_ROWS = 1024, 100_000
#: Hubs of more rows are spread over blocks.
LARGE_HUB = 10_000


def text_nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, hub): one row a document; equal texts share a hub.

    ``doc_id`` is unique: the document's own id, its text's hashes, and a number among equal rows.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(
            F.col("text").isNotNull(),
            F.struct(F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")),
        ).alias("hub"),
    )
    copies = rows.groupBy("doc_id", "size", "text_crc32", "hub").agg(F.count("*").alias("_n"))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    return copies.select(F.struct("doc_id", "hub", "copy").alias("doc_id"), "size", "text_crc32", "hub")


def _loads(labels: DataFrame, shards: int) -> list[int]:
    out = [0] * shards
    for row in labels.groupBy("shard").count().collect():
        out[row["shard"]] = row["count"]
    return out


def _per_shard(values: list[int], shard: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), shard)


def _share(*of: str | Column) -> Column:
    """A number from 0 to below 1 that the columns name."""
    return F.pmod(F.xxhash64(*of), F.lit(1 << 30)) / float(1 << 30)


def _plans(placed: DataFrame, room: list[int], tight: list[int], quota: int) -> DataFrame:
    """(hub, plan, total, apart): the shards a hub gathers in, each with the room taken up to it.

    A hub that no shard can hold goes by the ``tight`` room, without slack. ``apart`` counts the
    members outside its fullest shards, as many as it needs at least.
    """
    held = placed.groupBy("hub", "shard").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("hub")
    largest = F.row_number().over(whole.orderBy(F.desc("c"), "shard"))
    held = held.withColumn("n", F.sum("c").over(whole)).withColumn("place", largest)
    beyond = F.when(F.col("place") > F.ceil(F.col("n") / quota), F.col("c")).otherwise(0)
    held = held.withColumn("apart", F.sum(beyond).over(whole))
    place = F.when(F.col("n") > quota, _per_shard(tight, F.col("shard"))).otherwise(_per_shard(room, F.col("shard")))
    held = held.withColumn("takes", F.col("c") + F.greatest(place, F.lit(0)))
    fits = F.col("takes") >= F.col("n")
    # At most one row a shard and hub, whatever the hub's size.
    order = whole.orderBy(
        fits.desc(), F.when(fits, F.col("c")).otherwise(F.col("takes")).desc(), F.xxhash64("hub", "shard")
    )
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = held.withColumn("before", F.coalesce(F.sum("takes").over(earlier), F.lit(0)))
    chosen = ranked.where(F.col("before") < F.col("n")).withColumn(
        "get", F.greatest(F.least("takes", F.col("n") - F.col("before")) - F.col("c"), F.lit(0))
    )
    upto = chosen.withColumn("upto", F.sum("get").over(whole.orderBy("before", "shard")))
    return upto.groupBy("hub").agg(
        F.sort_array(F.collect_list(F.struct("upto", "shard", "get", "c"))).alias("plan"),
        F.max("upto").alias("total"),
        F.max("apart").alias("apart"),
    )


def _admitted(flows: dict[tuple[int, int], int], room: list[float]) -> list[float]:
    """The share of the moves into each shard that its room and what leaves it allow.

    A move out of a shard makes room there, so the shares depend on each other; from all moves
    admitted they fall until no shard takes in more than it has place for.
    """
    shards = range(len(room))
    share = [1.0] * len(room)
    into = [sum(n for (_, t), n in flows.items() if t == k) for k in shards]
    for _ in range(1000):
        out = [sum(n * share[t] for (s, t), n in flows.items() if s == k) for k in shards]
        new = [min(share[k], (room[k] + out[k]) / into[k]) if into[k] else 0.0 for k in shards]
        if max(a - b for a, b in zip(share, new, strict=True)) < 1e-4:
            return new
        share = new
    return share


def propagate(links: DataFrame, quota: list[int], slack: float = SLACK, rounds: int | None = None) -> DataFrame:
    """(doc_id, shard) of the documents of ``links`` (doc_id, hub); ``rounds`` may end it early."""
    shards = len(quota)
    labels = stored(
        links.select("doc_id")
        .distinct()
        .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    )
    best, least, idle, turn = labels, None, 0, 0
    while rounds is None or turn <= rounds:
        loads = _loads(labels, shards)
        room = [max(0, int(q * (1 + slack)) - n) for q, n in zip(quota, loads, strict=True)]
        tight = [max(0, q - n) for q, n in zip(quota, loads, strict=True)]
        placed = links.join(labels, "doc_id")
        # Stored, one row a hub: then a hub with a third of all documents can be split in the join.
        plans = stored(_plans(placed, room, tight, max(quota)))
        apart = plans.agg(F.sum("apart")).first()[0] or 0
        if least is None or apart < least:
            best, least, idle = labels, apart, 0
        else:
            idle += 1
        if not apart or idle >= PATIENCE or turn == rounds:
            break
        drawn = _share(F.lit(turn), "hub", "doc_id") * F.col("total")
        into = F.get(F.filter("plan", lambda x: x["upto"] > drawn), F.lit(0))
        stays = F.get(F.filter("plan", lambda x: x["shard"] == F.col("shard")), F.lit(0))
        votes = (
            placed.join(plans, "hub")
            .select("doc_id", "shard", F.coalesce(stays, into).alias("goal"))
            .where("goal is not null")
            .groupBy("doc_id", "shard", F.col("goal.shard").alias("goal"))
            .agg(F.sum(F.col("goal.c")).alias("weight"))
            .groupBy("doc_id", "shard")
            .agg(F.max(F.struct("weight", (F.col("goal") == F.col("shard")).alias("stay"), "goal")).alias("v"))
            .select("doc_id", F.col("v.goal").alias("goal"))
        )
        wished = stored(labels.join(votes, "doc_id", "left"))
        moves = wished.where("goal != shard").groupBy("shard", "goal").count().collect()
        shares = _admitted({(r["shard"], r["goal"]): r["count"] for r in moves}, room)
        if not any(shares):
            break
        chance = F.get(F.array(*[F.lit(a) for a in shares]), F.col("goal"))
        goes = (F.col("goal") != F.col("shard")) & (_share(F.lit(turn), F.lit("go"), "doc_id") < chance)
        labels = stored(
            wished.select("doc_id", F.when(goes, F.col("goal")).otherwise(F.col("shard")).alias("shard"))
        )
        turn += 1
    return best


def numbered(df: DataFrame, name: str, *groups: str, rows: int, hub: bool = False) -> DataFrame:
    """``df``, of about ``rows`` rows, with gapless numbers from 0 in each group, as column ``name``.

    With ``hub`` the numbers of a hub's rows (columns _hub, null for none, and _large) follow each other.
    """
    blocks = F.lit(max(BLOCKS, rows // BLOCK_ROWS))
    place = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    order = ["doc_id"]
    if hub:
        # Small hubs come whole in a block, the others block by block of their own.
        whole = F.pmod(F.xxhash64("_hub"), blocks).cast("int")
        place = F.when(F.col("_hub").isNull() | F.col("_large"), place).otherwise(whole)
        order = ["_hub", "doc_id"]
    placed = df.withColumn("_block", place)
    sizes = placed.groupBy(*groups, "_block").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_from", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inner = Window.partitionBy(*groups, "_block").orderBy(*order)
    return (
        placed.join(offsets, [*groups, "_block"])
        .withColumn(name, F.col("_from") + F.row_number().over(inner) - 1)
        .drop("_block", "_from")
    )


def balance(nodes: DataFrame, labels: DataFrame, quota: list[int]) -> DataFrame:
    """``nodes`` with a column ``shard`` whose counts are the quota exactly.

    ``labels`` (doc_id, shard, _hub, _large) are what propagation gave.
    """
    total = sum(quota)
    over = [max(0, n - q) for q, n in zip(quota, _loads(labels, len(quota)), strict=True)]
    let_go = labels.limit(0)
    if any(over):
        full = F.get(F.array(*[F.lit(x > 0) for x in over]), F.col("shard"))
        ranked = stored(numbered(labels.where(full), "_rank", "shard", rows=total, hub=True))
        goes = F.col("_rank") < _per_shard(over, F.col("shard"))
        let_go = ranked.where(goes).drop("_rank")
        labels = stored(labels.join(let_go.select("doc_id"), "doc_id", "left_anti"))
    need = [q - n for q, n in zip(quota, _loads(labels, len(quota)), strict=True)]
    upto = [sum(need[: k + 1]) for k in range(len(need))]
    limits = F.array(*[F.lit(x).cast("long") for x in upto])
    shard = F.size(F.filter(limits, lambda x: x <= F.col("_rank"))).cast("int")
    # What was let go takes the first places, hub by hub, and documents without links the rest.
    again = numbered(let_go.select("doc_id", "_hub", "_large"), "_rank", rows=total, hub=True)
    moved = stored(again.withColumn("shard", shard).select("doc_id", "shard"))
    first = moved.count()
    known = labels.select("doc_id", "shard").unionByName(moved)
    placed = nodes.join(known, "doc_id", "left")
    free = numbered(placed.where("shard is null").drop("shard"), "_rank", rows=total)
    free = free.withColumn("_rank", F.col("_rank") + first).withColumn("shard", shard).drop("_rank")
    return placed.where("shard is not null").unionByName(free)


def shard(
    nodes: DataFrame, links: DataFrame, shards: int = SHARDS, slack: float = SLACK, rounds: int | None = None
) -> DataFrame:
    """``nodes`` (one row a doc_id) with shard and slot; ``links`` (doc_id, hub) join neighbours."""
    total = nodes.count()
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    links = links.where("doc_id is not null and hub is not null").distinct()
    shared = links.groupBy("hub").agg(F.count("*").alias("_n")).where("_n > 1")
    linked = stored(links.join(stored(shared), "hub").select("doc_id", "hub", "_n"))
    labels = propagate(linked.select("doc_id", "hub"), quota, slack, rounds)
    # A document of several hubs goes with the largest.
    homes = linked.groupBy("doc_id").agg(F.max(F.struct("_n", "hub")).alias("_home"))
    homes = homes.select("doc_id", F.col("_home.hub").alias("_hub"), (F.col("_home._n") > LARGE_HUB).alias("_large"))
    out = stored(balance(nodes, stored(labels.join(homes, "doc_id")), quota))
    return numbered(out, "slot", "shard", rows=total)


def shard_by_text(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document."""
    nodes = stored(text_nodes(docs))
    out = shard(nodes.drop("hub"), nodes.select("doc_id", "hub"), shards)
    return out.select(
        "doc_id.doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
