"""Near-duplicate groups by SimHash, found through a Gray-order hierarchical index.

A fingerprint has a bit for each of 64 columns of the shingles' hashes: the
majority's value. Distinct fingerprints are sorted by Gray rank, in which
neighbours differ in few bits, and cut into blocks. A block's upper node keeps
the bits all its fingerprints share (a mask and a pattern); nodes of nodes do
the same, up to one root. Pairs of nodes are followed from the root down, and
a whole pair is pruned when the shared bits alone differ in more places than
allowed. Only pairs of blocks that survive meet, in one task each, where the
same pruning goes on over small leaves.

A task hands on a spanning forest of the links it finds, so dense groups of
copies give few rows and no link between groups is lost.

Defined cases: null and empty texts have fingerprint zero, linked like any
other. Null ids get a component but never name one, unless all its ids are
null. Repeated rows are a group of their own at least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occgraph.llm.common import free_name, marked, one_of_each, pieces
from occgraph.session import materialize

SHINGLE = 3
MAX_BITS = 3
SEED = 42
BLOCK = 16_384
FANOUT = 16
LEAF = 32
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the text's shingles, repeats included, as a signed 64-bit number."""
    words = text.lower().split()  # on bytes both concern ASCII only
    if not words:
        return 0
    if len(words) <= shingle:
        return fingerprint_of([xxhash.xxh64_intdigest(b" ".join(words), SEED)])
    shifted = zip(*[words[i:] for i in range(shingle)], strict=False)
    digest = xxhash.xxh64_intdigest
    return fingerprint_of([digest(s, SEED) for s in map(b" ".join, shifted)])


def fingerprint_of(hashes: list[int] | np.ndarray) -> int:
    """The majority's value of each bit of the hashes; 0 without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        some = np.array(hashes[i : i + _CHUNK], dtype="<u8")
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """All columns and the fingerprint (a long) under ``name``."""
    out = [c for c in docs.columns if c != name]
    schema = docs.select(*out, F.lit(0).cast("long").alias(name)).schema

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(out))
            prints = [fingerprint(t, shingle) for _, run in pieces(column) for t in run]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(out)], pa.array(prints, pa.int64())], [*out, name])

    return docs.select(*out, F.col(text).alias("text_to_print")).mapInArrow(mapped, schema)


def gray_rank(prints: Column) -> Column:
    """Place of a fingerprint in Gray order, shifted so that signed order is unsigned order."""
    rank = prints
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a task's sorted fingerprints into blocks: first rank, shared bits, members."""
    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        held.append(batch.column(0).to_numpy())
        n += len(held[-1])
        while n >= BLOCK:
            joined = np.concatenate(held)
            yield _block(joined[:BLOCK])
            held, n = [joined[BLOCK:]], n - BLOCK
    if n:
        yield _block(np.concatenate(held))


def _block(prints: np.ndarray) -> pa.RecordBatch:
    every, some = np.bitwise_and.reduce(prints), np.bitwise_or.reduce(prints)
    return pa.RecordBatch.from_arrays(
        [pa.array([int(prints[0])]), pa.array([int(~(every ^ some))]), pa.array([int(every)]), pa.array([prints.tobytes()], pa.binary())],
        ["first", "mask", "pattern", "members"])


def _differ(left: str, right: str) -> Column:
    """Bits in which the nodes' shared patterns are known to differ."""
    both = F.col(f"{left}.mask").bitwiseAND(F.col(f"{right}.mask"))
    return F.bit_count(F.col(f"{left}.pattern").bitwiseXOR(F.col(f"{right}.pattern")).bitwiseAND(both))


def block_pairs(blocks: DataFrame, max_bits: int = MAX_BITS, owner: str | None = None) -> DataFrame:
    """Pairs of block numbers (left <= right) that the tree of shared bits can't rule out.

    ``blocks``: ``node`` (0, 1, ... in Gray order), ``mask``, ``pattern``. The
    tree has ``FANOUT`` children a node; each level's pairs are the children
    of the level above, joined by parent and pruned.
    """
    levels = [blocks.select("node", "mask", "pattern")]
    count = levels[0].count()
    while count > 1:
        every, some = F.bit_and("pattern"), F.bit_or("pattern")
        parent = F.shiftright("node", FANOUT.bit_length() - 1)
        levels.append(materialize(levels[-1].groupBy(parent.alias("node")).agg(
            F.bit_and("mask").bitwiseAND(F.bitwise_not(every.bitwiseXOR(some))).alias("mask"), every.alias("pattern")), owner))
        count = -(-count // FANOUT)
    pairs = levels[-1].select(F.col("node").alias("l"), F.col("node").alias("r"))
    for level in reversed(levels[:-1]):
        children = level.withColumn("parent", F.shiftright("node", FANOUT.bit_length() - 1))
        a, b = children.alias("a"), children.alias("b")
        pairs = pairs.join(a, F.col("l") == F.col("a.parent")).join(b, F.col("r") == F.col("b.parent")).filter(
            (F.col("a.node") <= F.col("b.node")) & (_differ("a", "b") <= max_bits)).select(F.col("a.node").alias("l"), F.col("b.node").alias("r"))
    return pairs


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, by smallest member, of the graph with edges a-b."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], least)
        np.minimum.at(label, label[v], least)
        while not np.array_equal(label, up := label[label]):
            label = up
        if np.array_equal(before, label):
            break
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _leaves(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of ``LEAF`` neighbours (the last one filled up with its last member), their masks and patterns."""
    filled = np.concatenate([prints, np.repeat(prints[-1:], -len(prints) % LEAF)]).reshape(-1, LEAF)
    every, some = np.bitwise_and.reduce(filled, axis=1), np.bitwise_or.reduce(filled, axis=1)
    return filled, ~(every ^ some), every


def close_pairs(left: np.ndarray, right: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of pairs (one of each array) that differ in at most ``max_bits`` bits."""
    n, m = len(left), len(right)
    a, b = left.view(np.uint64), right.view(np.uint64)  # bits are counted of unsigned numbers only
    fa, ma, pa_ = _leaves(a)
    fb, mb, pb = _leaves(b)
    for i in range(0, len(fa), 64):
        known = np.bitwise_count((pa_[i : i + 64, None] ^ pb) & ma[i : i + 64, None] & mb)
        x, y = np.nonzero(known <= max_bits)
        for k in range(0, len(x), 2048):
            some, other = i + x[k : k + 2048], y[k : k + 2048]
            near = np.bitwise_count(fa[some][:, :, None] ^ fb[other][:, None, :]) <= max_bits
            g, p, q = np.nonzero(near)
            p, q = some[g] * LEAF + p, other[g] * LEAF + q
            own = (p < n) & (q < m)  # without what fills up the last leaves
            if own.any():
                yield left[p[own]], right[q[own]]


def _links(max_bits: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, two in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left, right = np.frombuffer(one, "<i8"), np.frombuffer(two, "<i8")
                a = b = np.zeros(0, np.int64)
                for c, d in close_pairs(left, right, max_bits):
                    new = c != d
                    a, b = np.concatenate([a, c[new]]), np.concatenate([b, d[new]])
                    if len(a) > 1 << 20:
                        a, b = spanning_forest(a, b)
                if len(a):
                    a, b = spanning_forest(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return linked


def components(edges: DataFrame, owner: str | None = None) -> DataFrame:
    """``node``, ``root``: the smallest node that each node of an edge list (``a``, ``b``) reaches.

    Alternates large and small stars: every round hangs the neighbours of a
    node below the smallest of them, on the larger side, then on the smaller.
    """
    edges = materialize(edges.select("a", "b").filter("a <> b").distinct(), owner)
    seen = None
    while True:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialize(small.filter("a <> b").distinct(), owner)
        sign = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sign == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = sign


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, owner: str = "simhash") -> DataFrame:
    """``a``, ``b``: a spanning forest, task by task, of the links between fingerprints.

    ``prints`` is a table with a ``fingerprint`` column that is cheap to read twice.
    """
    distinct = prints.select("fingerprint").distinct().withColumn("rank", gray_rank(F.col("fingerprint")))
    # two copies: ranges are drawn from a sample of what they cut, and block numbers need fixed blocks
    distinct = materialize(distinct, owner)
    cut = materialize(distinct.repartitionByRange("rank").sortWithinPartitions("rank").select("fingerprint").mapInArrow(
        _blocks, "first long, mask long, pattern long, members binary"), owner)
    order = cut.select("first", gray_rank(F.col("first")).alias("rank"))
    numbered = order.rdd.map(tuple).sortBy(lambda x: x[1]).zipWithIndex().map(lambda x: (x[0][0], x[1]))  # one small row a block
    numbers = cut.sparkSession.createDataFrame(numbered, "first long, node long")
    blocks = materialize(cut.join(numbers, "first"), owner)
    pairs = materialize(block_pairs(blocks, max_bits, owner), owner)
    side = blocks.select("node", "members")
    met = pairs.join(side.withColumnsRenamed({"node": "l", "members": "left"}), "l").join(
        side.withColumnsRenamed({"node": "r", "members": "right"}), "r").select("left", "right", "l", "r")
    spread = met.repartition(F.xxhash64("l", "r")).select("left", "right")
    return spread.mapInArrow(_links(max_bits), "a long, b long")


def near_groups(prints: DataFrame, max_bits: int = MAX_BITS, owner: str = "simhash") -> DataFrame:
    """``fingerprint``, ``root`` for every fingerprint that is linked to another."""
    return components(near_links(prints, max_bits, owner), owner).withColumnsRenamed({"node": "fingerprint"})


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS,
                    shingle: int = SHINGLE, owner: str = "simhash") -> DataFrame:
    """``doc_id``, ``fingerprint`` (long), ``component_id`` for every row."""
    prints = materialize(with_fingerprint(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", shingle=shingle).select(
        "doc_id", "fingerprint"), owner)
    return _named(prints, near_groups(prints, max_bits, owner), owner)


def _named(prints: DataFrame, groups: DataFrame, owner: str) -> DataFrame:
    """Rows of ``prints`` with the smallest id of their component."""
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    rooted = least.join(groups, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(names, "root").select("fingerprint", "component_id"), owner)
    return prints.join(named, "fingerprint").select(*prints.columns, "component_id")


def first_of_each(docs: DataFrame, keyed: DataFrame, key: list[str], rooted: DataFrame, owner: str) -> DataFrame:
    """The rows of ``docs`` whose key (``k1``, ``k2``) is the first of its ``root``."""
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    wins = (F.col("k1") == F.col("first.k1")) & (F.col("k2") == F.col("first.k2"))
    grouped = materialize(rooted.join(first, "root").groupBy("k1", "k2").agg(F.max(wins).alias("wins"), F.count("*").alias("times")), owner)
    own = lambda d: d.select(F.col("k1").alias(key[0]), F.col("k2").alias(key[1]))
    met = free_name(keyed, "in_group")
    split = marked(keyed, key, own(grouped), met)  # rows that are alone with their root need no join
    kept = split.filter(met).join(own(grouped.filter("NOT wins")), key, "left_anti")
    again = materialize(own(grouped.filter("wins AND times > 1")), owner)
    if not again.isEmpty():  # a kept row that is repeated stays once
        mark = free_name(kept, "is_repeated")
        doubled = kept.join(again.withColumn(mark, F.lit(True)), key, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))
        kept = one_of_each(doubled, key, F.col(mark))
    return kept.select(*docs.columns).unionByName(split.filter(~F.col(met)).select(*docs.columns))
