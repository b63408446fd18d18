"""Phrases: every count and score against plain loops, exact arithmetic, paths, awkward rows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from occgraph.llm import phrases

SCHEMA = "lang string, text string"


def plain_counts(rows, longest):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts.setdefault(lang, Counter())[" ".join(w[i : i + k])] += 1
    return counts, totals


def plain(rows, longest, least, first):
    counts, totals = plain_counts(rows, longest)
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if " " in p and a >= least}
        ranked = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and f" {p} " in f" {q} " and b >= a for q, b in candidates.items()):
                continue
            w = p.split(" ")
            cuts = [(f[" ".join(w[:k])], f[" ".join(w[k:])]) for k in range(1, len(w))]
            score, _, l, r = min((1000 * a * totals[lang] // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
            ranked.append((-score, -a, p.encode(), p, a, l, r, totals[lang], score))
        out += [(lang, i, *x[3:]) for i, x in enumerate(sorted(ranked)[:first], 1)]
    return sorted(out)


def found(spark, rows, longest=5, least=3, first=50):
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in ("gram", "f", "words", "slice", "rank")}), longest, least, first, owner="test_phrases")
    return sorted(tuple(r) for r in got.collect())


def texts(seed, n=60):
    r = random.Random(seed)
    block = " ".join(r.choice("abcdefgh") * 2 for _ in range(40))
    made = [("en" if i % 3 else None, "".join(r.choice(["A", "b", "c", "dd", "é", "漢"]) + r.choice([" ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(r.randint(0, 120)))) for i in range(n)]
    return made + [("en", f"{r.choice('xyz')} {block} {r.choice('xyz')}") for _ in range(8)] + [("de", "z z z z z z z z")] * 3


@pytest.mark.parametrize("longest", [5, 3])
def test_every_row_equals_plain_loops(spark, longest):
    rows = texts(longest)
    got, want = found(spark, rows, longest), plain(rows, longest, 3, 50)
    assert got == want and {x[0] for x in got} == {"en", "und", "de"}


def test_counts_follow_from_the_flow(spark):
    rows = texts(9)
    counts, totals = phrases.phrase_counts(phrases.edges(spark.createDataFrame(rows, SCHEMA), 5, 3, "test_phrases"), 5, 3, "test_phrases")
    counts = {(r["lang"], r["gram"]): r["f"] for r in counts.collect()}
    want, n = plain_counts(rows, 5)
    assert counts == {(lang, p): f for lang, c in want.items() for p, f in c.items() if f >= 3}
    assert {r["lang"]: r["n"] for r in totals.collect()} == {lang: k for lang, k in n.items() if k}


def test_a_map_that_rules_out_nothing_changes_nothing(spark, monkeypatch):
    rows = texts(4)
    monkeypatch.setattr(phrases, "frequent_pairs", lambda texts, least: b"\xff" * (phrases.BITS // 8))
    assert found(spark, rows) == plain(rows, 5, 3, 50)


def test_paths_are_compacted(spark):
    rows = [("en", " ".join(f"w{i}" for i in range(30)))] * 4 + [("en", "v0 w10 w11 w12 w13 w14 v1")] * 3
    counts, _ = phrases.phrase_counts(phrases.edges(spark.createDataFrame(rows, SCHEMA), 5, 3, "test_phrases"), 5, 3, "test_phrases")
    paths = phrases.unary_paths(counts, 5, "test_phrases").collect()
    place = {r["gram"]: (r["head"], r["place"], r["f"]) for r in paths}
    assert place["w9 w10 w11 w12 w13"] == ("w0 w1 w2 w3 w4", 9, 4)
    # five words of the other text are the edge of both: it heads a path of its own, and so does what follows
    assert place["w10 w11 w12 w13 w14"] == ("w10 w11 w12 w13 w14", 0, 7)
    assert place["w25 w26 w27 w28 w29"] == ("w11 w12 w13 w14 w15", 14, 4)


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "a", 1, big), ("en", "b", 1, big + 7), ("en", "a b", 2, big - 1)], "lang string, gram string, words int, f long")
    totals = spark.createDataFrame([("en", 9_000_000_000_001)], "lang string, n long")
    row = phrases.scored(counts, totals).first()
    assert row["score"] == 1000 * (big - 1) * 9_000_000_000_001 // (big * (big + 7))


def test_awkward_rows(spark):
    rows = [(None, None), ("en", ""), ("en", " \t.,\n"), ("", "a b"), ("en", "x y " * 60_000), ("en", "\x00\x1f <s> é😀")] * 3
    assert found(spark, rows) == plain(rows, 5, 3, 50)
    assert found(spark, []) == []
