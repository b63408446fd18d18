"""Prefix trie of conversations by Spark SQL's ROLLUP.

A node is a distinct sequence of first turns; all conversations that start
with it are its members. A turn becomes an id (16 bytes of the SHA-256 of role
and text), so texts are read once and never shuffled. A row holds ``BLOCK``
turn ids of a conversation in columns. ``GROUP BY ..., ROLLUP (t1, ..., t8)``
aggregates all its prefixes together and ``grouping_id`` tells a group's depth.
A longer conversation goes on in further rows, keyed by the node that the row
before ended in: 128 bits that join the hashes of all turns so far with their
places. All rows of all conversations meet in one ROLLUP, however long.

Two rollups give everything. The first counts members, finds the smallest (the
node's owner) and whether a node has children. Whoever owns a node owns all
deeper nodes on its path, so the sum over a node's subtree is the sum of what
its members own altogether, less what its owner owns above it: the second rollup
adds up one number a conversation.

Skew: a node of many members is summed in parts before the shuffle. Turns are
numbered and sums run over a conversation in runs of ``RUN`` turns, which are
put after one another, so a long conversation is not one task's work. The digest
of ended members reads ids in order, joined to strings of ``CHUNK`` ids before,
as a stream that holds one string at a time.

Defined cases: null roles and texts are empty; turns with equal numbers (null
is before all) follow each other by their ids; repeated rows are turns of their
own; rows without a conversation id take no part; a conversation that is
rebuilt without turns is a member of the root; long texts are hashed whole; an
empty table has no nodes; columns beside those named don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from occgraph.session import materialize

BLOCK = 8
RUN = 256
CHUNK_BITS = 12
SHARED = 9
FAMILY = 5
_NODE = ["depth", "key1", "key2"]


def running(rows: DataFrame, key: str, place: Column, order: list[Column], totals: dict[str, Column]) -> DataFrame:
    """``rows`` with the totals (an aggregate's column by new name) over all earlier rows of their key.

    ``place`` is a number that never falls along the order. Rows are taken in
    runs of ``RUN`` places, and the runs' totals are then carried forward.
    """
    rows = rows.withColumn("run", F.coalesce(F.floor(place / RUN), F.lit(-(1 << 60))))
    before = W.partitionBy(key, "run").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    runs = rows.groupBy(F.col(key).alias("k"), F.col("run").alias("r")).agg(*[t.alias(f"all_{n}") for n, t in totals.items()])
    earlier = W.partitionBy("k").orderBy("r").rowsBetween(W.unboundedPreceding, -1)
    # every total is a sum or an exclusive or: 0 is its start and adding runs is the same function again
    carried = runs.select("k", "r", *[(F.bit_xor(f"all_{n}") if n.startswith("xor") else F.sum(f"all_{n}")).over(earlier).alias(f"up_{n}") for n in totals])
    joined = rows.select("*", *[t.over(before).alias(f"own_{n}") for n, t in totals.items()]).join(carried, (F.col(key) == F.col("k")) & (F.col("run") == F.col("r")))
    zero = F.lit(0).cast("long")

    def whole(n: str) -> Column:
        own, up = F.coalesce(f"own_{n}", zero), F.coalesce(f"up_{n}", zero)
        return (own.bitwiseXOR(up) if n.startswith("xor") else own + up).alias(n)

    return joined.select(*[c for c in rows.columns if c != "run"], *[whole(n) for n in totals])


def numbered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``n`` (1, 2, ...), ``id`` and ``bytes`` (of the text) of each turn."""
    role, text = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    ids = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16).alias("id"),
        F.octet_length(text).cast("long").alias("bytes"))
    placed = running(ids, "conv_id", F.col("turn"), [F.col("turn").asc_nulls_first(), F.col("id")], {"earlier": F.count(F.lit(1))})
    return placed.select("conv_id", (F.col("earlier") + 1).alias("n"), "id", "bytes")


def shared_beginnings(numbered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as others of their family do, as branched chats: turns and lengths.

    Conversation c takes the first h turns of conversation c - c % ``FAMILY``
    and goes on with its own turns after its first h; h is crc32 of the decimal
    c, modulo ``SHARED``. A family's first conversation serves at most
    2 * ``FAMILY`` - 1 others.
    """
    counts = numbered.groupBy("conv_id").agg(F.count("*").alias("own"))
    given = counts.select(F.col("conv_id").alias("first"), F.col("own").alias("offered"))
    convs = counts.withColumns({
        "donor": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED,
    }).join(given, F.col("donor") == F.col("first"), "left").select(
        "conv_id", "donor", "h", "own", F.least("h", F.coalesce("offered", F.lit(0).cast("long"))).alias("taken"))
    firsts = numbered.filter(F.col("n") < SHARED).select(F.col("conv_id").alias("first"), "n", "id", "bytes")
    taken = convs.join(firsts, (F.col("donor") == F.col("first")) & (F.col("n") <= F.col("taken"))).select("conv_id", F.col("n").alias("depth"), "id", "bytes")
    later = numbered.join(convs.select(F.col("conv_id").alias("c"), "h", "taken"), F.col("conv_id") == F.col("c")).filter(F.col("n") > F.col("h")).select(
        "conv_id", (F.col("taken") + F.col("n") - F.col("h")).alias("depth"), "id", "bytes")
    lengths = convs.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    return taken.unionByName(later), lengths


def _hash(seed: int, turn_id: str, depth: str) -> str:
    """SQL of a turn's share in the keys of the nodes that it leads to; 0 where there is no turn."""
    return f"CASE WHEN {turn_id} IS NULL THEN 0L ELSE xxhash64({seed}, {turn_id}, {depth}) END"


def blocks_of(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """A row for each ``BLOCK`` turns of a conversation: the node before (``xor1``, ``xor2``) and the turns ``t1``, ``t2``, ...

    ``turns`` are (conv_id, depth from 1, id, bytes), ``lengths`` (conv_id, length),
    a row a conversation. A conversation without turns has one empty row.
    """
    placed = turns.withColumns({"block": F.expr(f"(depth - 1) div {BLOCK}"), "at": (F.col("depth") - 1) % BLOCK})
    wide = placed.groupBy("conv_id", "block").agg(
        *[F.max(F.when(F.col("at") == i, F.struct("id", "bytes"))).alias(f"t{i + 1}") for i in range(BLOCK)],
        *[F.bit_xor(F.expr(_hash(s, "id", "depth"))).alias(f"in{s}") for s in (1, 2)])
    chained = running(wide, "conv_id", F.col("block"), [F.col("block")], {f"xor{s}": F.bit_xor(f"in{s}") for s in (1, 2)})
    zero = F.lit(0).cast("long")
    return lengths.join(chained.withColumnRenamed("conv_id", "c"), F.col("conv_id") == F.col("c"), "left").select(
        "conv_id", "length", *[F.coalesce(c, zero).alias(c) for c in ("block", "xor1", "xor2", "in1", "in2")], *[f"t{i + 1}" for i in range(BLOCK)])


def _rollup(blocks: DataFrame, aggregates: str) -> DataFrame:
    """All prefixes of all rows: ``depth``, ``key1``, ``key2``, ``up1``, ``up2`` (the parent's key), ``bytes`` and the aggregates."""
    spark, names = blocks.sparkSession, [f"t{i + 1}" for i in range(BLOCK)]
    at = [f"block * {BLOCK} + {i + 1}" for i in range(BLOCK)]
    grouped = spark.sql(
        f"SELECT block, xor1, xor2, {', '.join(names)}, {BLOCK} - bit_count(grouping_id()) AS level, {aggregates} "
        f"FROM {{blocks}} GROUP BY block, xor1, xor2, ROLLUP ({', '.join(names)})", blocks=blocks)
    last = "CASE level " + " ".join(f"WHEN {i + 1} THEN {n}" for i, n in enumerate(names)) + " END"
    # a row's root is the node that the row before ended in; a group whose last turn is null holds conversations that ended earlier
    named = grouped.withColumn("last", F.expr(last)).filter("(level = 0 AND block = 0) OR last IS NOT NULL")
    keys = [" ^ ".join([f"xor{s}", *[f"({_hash(s, f'{n}.id', a)})" for n, a in zip(names, at)]]) for s in (1, 2)]
    named = named.withColumns({"depth": F.expr(f"block * {BLOCK} + level").cast("long"), "key1": F.expr(keys[0]), "key2": F.expr(keys[1])})
    own = [_hash(s, "last.id", "depth") for s in (1, 2)]
    return named.withColumns({"up1": F.expr(f"key1 ^ ({own[0]})"), "up2": F.expr(f"key2 ^ ({own[1]})"), "bytes": F.coalesce("last.bytes", F.lit(0).cast("long"))}).drop(
        "block", "xor1", "xor2", "last", *names)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node, in order, to one SHA-256; holds the digest's state, not the ids."""
    now, state, done = None, None, []

    def rows() -> pa.RecordBatch:
        nodes, hexes = zip(*done)
        done.clear()
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c, pa.int64()) for c in zip(*nodes)], pa.array(hexes, pa.string())], names=[*_NODE, "ends_sha256"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in (*_NODE, "ids")]
        for *node, ids in zip(*columns):
            if node != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = node, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield rows()
    if now is not None:
        done.append((now, state.hexdigest()))
        yield rows()


def ended_members(blocks: DataFrame) -> DataFrame:
    """The node that each conversation ends in, and the digest of the ids that end there."""
    ends = blocks.filter(f"length <= (block + 1) * {BLOCK}").select(
        "conv_id", F.col("length").alias("depth"), *[F.col(f"xor{s}").bitwiseXOR(F.col(f"in{s}")).alias(f"key{s}") for s in (1, 2)])
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))
    chunks = ends.groupBy(*_NODE, F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(ids, ",").alias("ids"))
    return chunks.repartition(*_NODE).sortWithinPartitions(*_NODE, "chunk").mapInArrow(_digests, "depth long, key1 long, key2 long, ends_sha256 string")


def prefix_trie(turns: DataFrame, lengths: DataFrame, owner: str | None = None) -> DataFrame:
    """One row a node.

    ``conv_id`` (its smallest member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves`` (childless nodes of the subtree),
    ``saved_tokens`` (bytes that the subtree's nodes hold for more than one
    member), ``ends_sha256`` (of the ids of members that end here). Copies are
    written under ``owner``.
    """
    blocks = materialize(blocks_of(turns, lengths), owner)
    nodes = materialize(_rollup(blocks, f"count(*) AS n_convs, min(conv_id) AS conv_id, max(length - block * {BLOCK}) AS reach").select(
        *_NODE, "up1", "up2", "conv_id", "n_convs", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"), (F.col("reach") <= F.col("level")).cast("long").alias("leaf")), owner)
    sums = {"saved": F.sum("saved"), "leaf": F.sum("leaf")}
    owned = nodes.groupBy("conv_id").agg(*[s.alias(f"owned_{n}") for n, s in sums.items()])
    totals = _rollup(blocks.join(owned, "conv_id"), "sum(owned_saved) AS sum_saved, sum(owned_leaf) AS sum_leaf").select(*_NODE, "sum_saved", "sum_leaf")
    above = running(nodes, "conv_id", F.col("depth"), [F.col("depth")], {f"above_{n}": s for n, s in sums.items()})
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up1").alias("key1"), F.col("up2").alias("key2")).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("key1").alias("up1"), F.col("key2").alias("up2"), F.col("conv_id").alias("parent_conv_id"))
    whole = above.join(totals, _NODE).join(children, _NODE, "left").join(ended_members(blocks), _NODE, "left").join(parents, ["depth", "up1", "up2"], "left")
    return whole.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), (F.col("sum_leaf") - F.col("above_leaf")).alias("n_leaves"),
        (F.col("sum_saved") - F.col("above_saved")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
