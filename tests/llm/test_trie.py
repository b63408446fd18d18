"""Prefix trie: brute force over whole paths, long conversations, shared first turns, awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

from pyspark.sql import functions as F

from occgraph.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def turn_id(role, text):
    return hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()[:16]


def rebuilt(rows):
    """Conversations in order, then with the beginnings of their family's first one."""
    given = {}
    for c, turn, role, text in rows:
        if c is not None:
            given.setdefault(c, []).append(((turn is not None, turn or 0), turn_id(role, text), role or "", text or ""))
    given = {c: [x[2:] for x in sorted(turns, key=lambda x: x[:2])] for c, turns in given.items()}
    out = {}
    for c, turns in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = given.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]  # the remainder has the sign of c, as in SQL
    return out


def plain(paths):
    """Every node by its whole path."""
    members = {}
    for c, turns in paths.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        saved[path] = own + sum(saved[p] for p in children.get(path, []))
        leaves[path] = sum(leaves[p] for p in children.get(path, [])) or 1
    return {
        (min(m), len(path), min(members[path[:-1]]) if path else None, len(m), len(children.get(path, [])), leaves[path], saved[path],
         hashlib.sha256(",".join(str(c) for c in sorted(c for c in m if len(paths[c]) == len(path))).encode()).hexdigest())
        for path, m in members.items()}


def found(spark, rows, extra=False):
    turns = spark.createDataFrame(rows, SCHEMA)
    if extra:
        turns = turns.withColumns({c: F.lit("own") for c in ("n", "id", "bytes", "depth", "block", "key1", "t1", "run", "level")})
    result = trie.prefix_trie(*trie.shared_beginnings(trie.numbered_turns(turns)), owner="test_trie").collect()
    return [tuple(r) for r in result]


def check(spark, rows, extra=False):
    got, want = found(spark, rows, extra), plain(rebuilt(rows))
    assert len(got) == len(want) and set(got) == want


def test_random_conversations(spark):
    r = random.Random(1)
    rows = [(c, t, r.choice(["user", "assistant"]), r.choice("ab")) for c in range(-7, 90) if c % 11 for t in range(r.randint(1, 12))]
    check(spark, rows)


def test_long_conversations_share_long_beginnings(spark):
    """Beyond a row of turns and beyond a run of turns; copies; paths that part late."""
    rows = [(c, t, "user", f"{t}" if t < part else f"{t} {c}") for c, n, part in ((0, 700, 700), (5, 700, 300), (10, 650, 700), (15, 8, 9), (20, 16, 17), (25, 17, 18), (35, 700, 700), (40, 700, 511))
            for t in range(n)]
    check(spark, rows)


def test_awkward_rows(spark):
    rows = [
        (0, None, None, None), (0, 3, "user", "é😀"), (0, 3, "user", "é😀"), (0, 3, None, "x"), (0, -5, "", ""),
        (None, 0, "user", "no conversation"), (6, 0, "user", "lost"), (11, 0, "user", "lost"), (1, 0, "user", "a"), (2, 0, "user", "long " * 50_000), (-4, 0, "user", "a"),
        (5000, 1, "user", "a"), (9999, 1, "1:", "a"), (9998, 1, "1", ":a"),
    ]
    check(spark, rows, extra=True)


def test_many_ended_members_are_one_digest(spark):
    rows = [(5 * c, 0, "user", "hello") for c in range(12_000)]
    got = found(spark, rows)
    ids = ",".join(str(5 * c) for c in range(12_000))
    assert sorted(x[1:4] for x in got) == [(0, None, 12_000), (1, 0, 12_000)]
    assert {x[-1] for x in got} == {hashlib.sha256(b"").hexdigest(), hashlib.sha256(ids.encode()).hexdigest()}


def test_no_turns(spark):
    assert found(spark, []) == [] and found(spark, [(None, 0, "user", "x")]) == []
