"""Fingerprints, links and components against brute force."""

from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from occgraph.llm import simhash
from occgraph.llm.common import table
from tests.llm.awkward import documents, own_columns_kept


def plain_fingerprint(text: str) -> int:
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: dict) -> dict:
    """id -> smallest id of its component, by all pairs."""
    ids = list(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_fingerprints(spark):
    texts = ["", " \n", "One", "one two", "ONE TWO three", "É é e\x1cf g", "a b c d e f g", "w " * 500, "x y\x0bz q"]
    assert [simhash.fingerprint(t.encode()) & (1 << 64) - 1 for t in texts] == [plain_fingerprint(t) for t in texts]
    want = spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t")).collect()
    assert [r[0] & (1 << 64) - 1 for r in want] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_table_equals_brute_force(spark, sf):
    rows = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    prints = {i: plain_fingerprint(t or "") for i, t in rows.items()}
    got = simhash.near_duplicates(table(spark, sf, "documents")).collect()
    assert {r["doc_id"]: r["fingerprint"] & (1 << 64) - 1 for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(prints)


def test_index_loses_no_link(spark):
    """Chains, dense balls and lone fingerprints, over many blocks."""
    r = random.Random(4)
    prints, at = {}, 0
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 30])):
            prints[at] = x
            at += 1
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(64)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, signed(v)) for i, v in prints.items()], "doc_id long, fingerprint long").repartition(40)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    groups = simhash.near_groups(df, owner="simhash_test")
    got = {x["doc_id"]: x["component_id"] for x in simhash._named(df, groups, "simhash_test").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute_components(prints)


def test_gray_rank_orders_neighbours_by_one_bit(spark):
    codes = [i ^ i >> 1 for i in range(200)]
    rows = spark.createDataFrame([(c,) for c in codes], "f long").select("f", simhash.gray_rank(F.col("f")).alias("r")).orderBy("r").collect()
    assert [r["f"] for r in rows] == codes


def test_close_pairs_are_all_found():
    r = np.random.default_rng(0)
    a = np.sort(r.integers(-(1 << 63), (1 << 63) - 1, 500))
    b = np.concatenate([a[:100] ^ (np.int64(1) << r.integers(0, 64, 100)), r.integers(-(1 << 62), 1 << 62, 300)])
    got = {(int(x), int(y)) for c, d in simhash.close_pairs(a, b, 3) for x, y in zip(c, d)}
    bits = lambda x, y: ((int(x) ^ int(y)) & (1 << 64) - 1).bit_count()
    assert got == {(int(x), int(y)) for x in a for y in b if bits(x, y) <= 3} and len(got) >= 100


def test_awkward_rows(spark):
    docs = documents(spark)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == docs.count() and {r["component_id"] for r in found if r["doc_id"] in (0, 1, 2)} == {0}
