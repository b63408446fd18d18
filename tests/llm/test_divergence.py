"""Quality rules: counts against plain loops, distances, guards."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from occgraph.llm import divergence
from occgraph.llm.common import table
from tests.llm.awkward import documents, own_columns_kept

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else {w for w, c in __import__("collections").Counter(windows).items() if c > 1}
    covered = {i + j for i, w in enumerate(windows) if w in twice for j in range(5)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_counts_equal_plain_loops(spark, sf):
    for docs in (table(spark, sf, "documents"), documents(spark)):
        for r in divergence.quality_verdicts(docs).select("text", "verdict.*").collect():
            assert tuple(r[c] for c in BASE) == plain(r["text"]), r["text"][:200]
            assert not (r["base_failed"] and r["kept"])


def test_repeated_words_of_random_texts():
    r = random.Random(0)
    for _ in range(300):
        words = [r.choice("abc" if r.random() < 0.5 else "abcdefgh") for _ in range(r.randint(0, 40))]
        assert divergence.repeated_words([w.encode() for w in words]) == plain(" ".join(words))[4]
    many = [str(i).encode() for i in range(20_000)] * 2  # many different words: no product may overflow
    assert divergence.repeated_words(many) == 40_000


def test_distance():
    p, q = np.array([1.0, 0, 3]), np.array([0.0, 5, 0])
    assert divergence.js_distance(p, p * 7) == 0 and divergence.js_distance(p, q) == pytest.approx(1)
    a, b = np.array([0.5, 0.5]), np.array([0.9, 0.1])
    m = (a + b) / 2
    want = (sum(a * np.log2(a / m)) + sum(b * np.log2(b / m))) / 2
    assert divergence.js_distance(a, b) == pytest.approx(want**0.5)


def test_junk_goes_and_clean_texts_stay(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = divergence.quality_verdicts(docs).join(labels, "doc_id").select("quality", "verdict.*").collect()
    clean = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    junk = [r for r in rows if r["quality"] == 0]
    assert np.mean([r["kept"] for r in clean]) > 0.99 and np.mean([r["kept"] for r in junk]) < 0.5


def test_short_texts_are_not_judged_by_histograms(spark):
    rows = [(i, "the man of the sea and the hill is on the way to the old house " * 20 + str(i), "en", "s", 0) for i in range(20)]
    odd = [(100, " ".join(f"%{i}%" for i in range(12)), "en", "s", 0), (101, " ".join(f"%{i}%" for i in range(90)), "en", "s", 0)]
    got = {r["doc_id"]: r for r in divergence.quality_verdicts(documents(spark, rows + odd, clashes=False)).select("doc_id", "verdict.*").collect()}
    assert got[100]["kept"] and not got[101]["kept"] and got[101]["chars_distance"] > 0.3


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = divergence.quality_verdicts(docs.drop("verdict"))
    assert rows.count() == docs.count() and own_columns_kept(rows.withColumn("verdict", F.lit("own verdict")))
    assert {r["kept"] for r in rows.filter("doc_id IN (0, 1, 2)").select("verdict.kept").collect()} == {False}
    assert divergence.quality_verdicts(documents(spark, [])).count() == 0


def test_gibberish_of_usual_letters_goes(spark):
    """Long texts without common words, which differ from clean ones in nothing else; clean texts of all lengths stay."""
    r = random.Random(3)
    usual = divergence.COMMON_WORDS[:36]
    odd = lambda: "".join(r.choice("aeionrstl") for _ in range(r.randint(2, 7)))
    prose = lambda n, share: " ".join(r.choice(usual) if r.random() < share else odd() for _ in range(n))
    rows = [(i, prose(r.choice([60, 100, 200, 400, 2000]), 0.25), "en", "s", 0) for i in range(200)]
    rows += [(1000 + i, prose(r.choice([300, 1000]), 0), "en", "s", 0) for i in range(10)]
    got = divergence.quality_verdicts(documents(spark, rows, clashes=False)).select("doc_id", "verdict.*").collect()
    assert {x["doc_id"] for x in got if x["kept"]} == set(range(200))
    assert max(x["words_distance"] for x in got if x["doc_id"] >= 1000) < 0.45


def test_junk_of_many_words_goes(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = divergence.quality_verdicts(docs).join(labels, "doc_id").select("quality", "verdict.*").filter("n_words >= 200 AND NOT base_failed").collect()
    assert all(r["kept"] == (r["quality"] == 1) for r in rows) and {r["quality"] for r in rows} == {0, 1}


def test_every_language_has_its_own_reference(spark):
    """Small languages of another script, beyond those that go to every task."""
    latin = "the man of the sea and the hill is on the way to the old house "
    other = "дом стоит на горе и море шумит внизу "
    varied = lambda base, i: " ".join(f"{w}{'абвг'[(i + k) % 4] if base is other else 'abcd'[(i * k + k // 7) % 4] + 'xyz'[(k // 4 + i) % 3]}{k}" if k % 2 else w for k, w in enumerate((base * 8).split()))
    n = divergence.MAX_LANGS
    rows = [(i, varied(latin, i) + " " + varied(latin, i + 1), f"big{i}", "s", 0) for i in range(n)]
    rows += [(n + i, varied(other, i), f"small{i}", "s", 0) for i in range(5)] + [(n + 5, "", "none", "s", 0), (n + 6, None, None, "s", 0)]
    docs = documents(spark, rows, clashes=False)
    got = {x["doc_id"]: x for x in divergence.quality_verdicts(docs).select("doc_id", "lang", "verdict.*").collect()}
    assert len(got) == len(rows) and got[n]["lang"] == "small0"
    for i in range(n + 5):  # each document is its language
        assert got[i]["chars_distance"] == pytest.approx(0, abs=1e-6) and got[i]["words_distance"] == pytest.approx(0, abs=1e-6) and got[i]["kept"]
    assert not got[n + 5]["kept"] and not got[n + 6]["kept"]
