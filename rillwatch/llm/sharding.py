"""Sharding by balanced label propagation over linked documents.

Links are memberships: rows of a node and a group, and documents of a group are neighbours (an ordinary
link is a group of two). Linked nodes start evenly dealt. In every round, joins give each node the
shards of its neighbours, and it wants to go where more of them are. A shard takes as many nodes as it
has free places and as leave it in the same round, so full shards exchange nodes, along cycles as well;
the largest gains go first. Rounds in turn offer all shards, those that could take somebody, and those
with free places, so the rest of a group too large for one shard goes to its next best. They end once
nobody wants to move, or IDLE rounds in a row have brought no more neighbours together; a node whose
shard of choice stays full, with nobody to change places with, stays where it is. Nodes without links are
dealt last, into the places left, which makes the shards' row counts at most one apart whatever the
groups are. Groups only meet as counts per shard, so one may hold any share of all rows.

Defined cases: null text has no bytes and size 1; null and empty texts are two groups; rows that repeat
or share a doc_id, or lack one, are nodes of their own; an empty table has no rows.
"""

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Rounds, numbered, stored, table, text_key

SHARDS = 16
IDLE = 9  # rounds in a row, three of each kind, without a gain that end the propagation


def _quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def _looked_up(shard: Column, values: list[int]) -> Column:
    """The value of a shard out of a list of one value for each shard."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), shard + 1)


def _flows(wanted: np.ndarray, free: np.ndarray) -> np.ndarray:
    """Moves from shard (row) to shard (column): as many of the wanted ones as can be made.

    A shard takes no more than its free places and those leaving it. Moves are a flow that returns through
    one more place, which takes what fills free places; cycles that add moves are found until none is left.
    """
    shards = len(free)
    moves = np.minimum(wanted, wanted.T)  # equal numbers both ways
    net = np.zeros(shards, np.int64)
    while True:
        gain = np.full((shards + 1, shards + 1), -np.inf)
        gain[:shards, :shards] = np.where(moves < wanted, 1.0, np.where(moves.T > 0, -1.0, -np.inf))
        gain[:shards, shards] = np.where(net < free, 0.0, -np.inf)
        gain[shards, :shards] = 0.0
        np.fill_diagonal(gain, -np.inf)
        reach, source = np.zeros(shards + 1), np.zeros(shards + 1, np.int64)
        for _ in range(shards + 2):
            ways = reach[:, None] + gain
            longer = ways.max(0) > reach
            source[longer] = ways.argmax(0)[longer]
            reach = np.maximum(reach, ways.max(0))
            if not longer.any():
                return moves
        at = int(np.flatnonzero(longer)[0])
        for _ in range(shards + 1):
            at = int(source[at])
        cycle = [at]
        while source[cycle[-1]] != at:
            cycle.append(int(source[cycle[-1]]))
        steps = list(zip([*cycle[1:], at], cycle))  # from, to
        rooms = []
        for x, y in steps:
            if y == shards:
                rooms.append(free[x] - net[x])
            elif x != shards:
                rooms.append(wanted[x, y] - moves[x, y] if gain[x, y] > 0 else moves[y, x])
        size = min(rooms)
        for x, y in steps:
            if y == shards:
                net[x] += size
            elif x == shards:
                net[y] -= size
            elif gain[x, y] > 0:
                moves[x, y] += size
            else:
                moves[y, x] -= size


def _wishes(state: DataFrame, counts: DataFrame, open_shards: list[bool], turn: int) -> DataFrame:
    """node, shard, wanted shard and gain of every node that has more neighbours in another open shard.

    Of equally many neighbours, the shard first in the group's own order counts as more, so that two
    documents do not just change places; the order is another one in every turn, as the way that one of
    them can go may be the one that the other cannot.
    """
    rank = F.pmod(F.xxhash64("group", "shard", F.lit(turn)), F.lit(1 << 20))
    counts = counts.withColumn("pull", F.struct("count", rank.alias("rank"), F.col("shard").alias("to")))
    room = _looked_up(F.col("shard"), [int(o) for o in open_shards]) == 1
    best = counts.where(room).groupBy("group").agg(F.max("pull").alias("best"))
    pulls = counts.join(best, "group").where(F.col("best") > F.col("pull"))
    pulls = pulls.select("group", "shard", "best.to", (F.col("best.count") - F.col("pull.count")).alias("gain"))
    # each (group, shard) holds at most a shard's quota of nodes
    return (
        state.join(pulls, ["group", "shard"])
        .groupBy("node", "shard")
        .agg(F.max(F.struct("gain", "to")).alias("wish"))
        .select(
            "node",
            F.col("shard").alias("from"),
            F.col("wish.to").alias("to"),
            F.floor(F.log2(F.col("wish.gain") + 1)).cast("int").alias("gain"),
        )
    )


def _accepted(wishes: DataFrame, wanted: list, moves: np.ndarray) -> DataFrame:
    """The wishes that become moves: of each pair of shards as many as ``moves`` says, large gains first."""
    left, limits = moves.copy(), []
    for row in sorted(wanted, key=lambda r: -r["gain"]):
        limit = int(min(row["count"], left[row["from"], row["to"]]))
        left[row["from"], row["to"]] -= limit
        limits.append((row["from"], row["to"], row["gain"], limit))
    if sum(limit for *_, limit in limits) == sum(row["count"] for row in wanted):
        return wishes
    # one row for two shards and a power of two of the gain
    limits = wishes.sparkSession.createDataFrame(limits, "`from` int, `to` int, gain int, limit bigint")
    keys = ["from", "to", "gain"]
    places = numbered(wishes, keys, ["node"], "place")
    return places.join(limits, keys).where(F.col("place") < F.col("limit"))


def balanced_shards(nodes: DataFrame, memberships: DataFrame, shards: int = SHARDS) -> DataFrame:
    """node and shard of every row of ``nodes`` (column node, distinct).

    ``memberships`` has the columns node and group. Row counts of the shards are at most one apart.
    """
    shared = memberships.groupBy("group").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("group")
    # distinct comes first: behind the join it would keep a large group's rows in one task
    links = stored(memberships.select("node", "group").distinct().join(shared, "group"), "shard-links")
    linked = stored(links.select("node").distinct(), "linked-nodes")
    total = nodes.count()
    quotas = _quotas(total, shards)
    rounds = Rounds()
    placed = rounds.store(
        numbered(linked, [], ["node"], "number").select(
            "node", F.pmod("number", F.lit(shards)).cast("int").alias("shard")
        ),
        "shard-state",
    )

    def sizes(rows: DataFrame, column: str) -> list[int]:
        found = {r[0]: r[1] for r in rows.groupBy(column).count().collect()}  # one row a shard
        return [found.get(s, 0) for s in range(shards)]

    counts, taking = None, [True] * shards
    most, best = -1.0, placed
    turn = idle = 0
    while idle < IDLE:
        if counts is None:
            state = links.join(placed, "node")
            counts = state.groupBy("group", "shard").agg(F.count(F.lit(1)).alias("count"))
            counts = rounds.store(counts, "shard-counts")
            held = sizes(placed, "shard")
            # with groups that overlap, moves made at the same time can also part neighbours
            together = counts.agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
            if together > most:
                most, best, idle = together, placed, 0
                rounds.keep("shard-state")
        idle += 1
        free = [q - h for q, h in zip(quotas, held)]
        kind, turn = turn % 3, turn + 1
        if kind == 0:
            taking = [True] * shards
        open_shards = [f > 0 for f in free] if kind == 2 else [t or f > 0 for t, f in zip(taking, free)]
        if not any(open_shards):
            continue
        wishes = rounds.store(_wishes(state, counts, open_shards, turn), "shard-wishes")
        wanted = wishes.groupBy("from", "to", "gain").count().collect()  # few rows for two shards
        if not wanted and all(open_shards):
            break
        asked = np.zeros((shards, shards), np.int64)
        for row in wanted:
            asked[row["from"], row["to"]] += row["count"]
        moves = _flows(asked, np.array(free))
        taking = [bool(m or not a) for m, a in zip(moves.sum(0), asked.sum(0))]
        if not moves.any():
            continue
        moved = _accepted(wishes, wanted, moves).select("node", "to")
        placed = rounds.store(
            placed.join(moved, "node", "left").select("node", F.coalesce("to", "shard").alias("shard")),
            "shard-state",
        )
        counts = None
    placed, held = best, sizes(best, "shard")
    # the rest fills the places left, shard after shard
    free = [q - h for q, h in zip(quotas, held)]
    others = stored(nodes.select("node").join(linked, "node", "left_anti"), "single-nodes")
    ends = [sum(free[: s + 1]) for s in range(shards)]
    shard = F.lit(shards - 1)
    for s in reversed(range(shards - 1)):
        shard = F.when(F.col("number") < ends[s], F.lit(s)).otherwise(shard)
    filled = numbered(others, [], ["node"], "number").select("node", shard.cast("int").alias("shard"))
    return placed.unionByName(filled)


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null) of every row of ``docs``.

    Documents of equal text are linked; the law is ``rows``. ``slot`` numbers a shard's rows from 0.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            text_key().alias("h1"),
            F.xxhash64(F.lit("group"), F.col("text")).alias("h2"),
        ),
        "shard-rows",
    )
    numbers = numbered(rows, [], ["doc_id", "h1"], "node")
    ids = stored(numbers.withColumn("group", F.struct("h1", "h2")), "shard-nodes")
    found = balanced_shards(ids.select("node"), ids.select("node", "group"), shards)
    named = stored(ids.select("node", "doc_id", "size", "text_crc32").join(found, "node"), "shard-found")
    return numbered(named, ["shard"], ["node"], "slot").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
