"""Repeated passages against counting every window; the merge against sorting."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from occgraph.llm import suffixes
from tests.llm.awkward import documents, own_columns_kept


def brute(texts: list[bytes], size: int = suffixes.MIN_BYTES) -> list[tuple]:
    seen = collections.Counter(hash(t[p : p + size]) for t in texts for p in range(len(t) - size + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for p in range(len(t) - size + 1):
            if seen[hash(t[p : p + size])] > 1:
                gone[p] += 1
                gone[p + size] -= 1
        gone = np.cumsum(gone)[: len(t)] > 0
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def awkward_texts(seed: int) -> list[str | None]:
    """Passages shared whole and in part, with like bytes before and after them, copies, near copies, periodic texts."""
    r = random.Random(seed)
    words = lambda n: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(n))
    passages = [words(r.choice([80, 100, 110, 120, 150, 300])) for _ in range(6)]
    texts: list[str | None] = []
    for _ in range(50):
        parts = [words(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            parts += [p[r.choice([0, 0, 1, 20, 40]) : len(p) - r.choice([0, 0, 1, 30])], r.choice(["", "x", " ", words(r.randint(0, 30))])]
        texts.append("".join(parts))
    texts += [texts[3], texts[3], texts[5] + "z", "q" * 900, "ab" * 500, "q" * 1200, None, "", "x" * 399, "y" * 400, "y" * 400]
    for _ in range(8):
        near = list(texts[2] + passages[0] + passages[1])
        for _ in range(3):
            near[r.randrange(len(near))] = "#"
        texts.append("".join(near))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [10, 11])
def test_removal_equals_counting_every_window(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 400)
    texts = awkward_texts(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffixes.removal_digest(suffixes.without_repeats(df)).collect()
    got = {r[0]: tuple(r[1:5]) for r in rows}
    assert [got[i] for i in range(len(texts))] == brute([(t or "").encode() for t in texts])
    assert all(abs(len(r["kept_text"].encode()) - (r["n_bytes"] - r["n_removed"])) <= 6 * (r["n_spans"] + 1) for r in rows)


def brute_words(texts: list[str | None], words: int = suffixes.MIN_WORDS) -> list[str]:
    """Texts without the words of every window of ``words`` words that is anywhere else."""
    cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = collections.Counter(tuple(w[p : p + words]) for w in cut for p in range(len(w) - words + 1))
    out = []
    for t, w in zip(texts, cut):
        gone = {p + i for p in range(len(w) - words + 1) if seen[tuple(w[p : p + words])] > 1 for i in range(words)}
        out.append(" ".join(x for i, x in enumerate(w) if i not in gone))
    return out


@pytest.mark.parametrize("seed", [20, 21])
def test_words_equal_counting_every_window_of_words(spark, seed, monkeypatch):
    monkeypatch.setattr(suffixes, "BUCKET", 400)
    r = random.Random(seed)
    some = lambda n: [r.choice(["a", "bé", "ccc", "d1", "漢"]) + str(r.randint(0, 40)) for _ in range(n)]
    passages = [some(n) for n in (49, 50, 51, 52, 64, 90, 200)]
    texts: list[str | None] = []
    for _ in range(40):
        w = some(r.randint(0, 30))
        for _ in range(r.randint(0, 3)):
            p = r.choice(passages)
            w += p[r.choice([0, 0, 1, 5]) : len(p) - r.choice([0, 0, 1])] + some(r.randint(0, 20))
        texts.append("".join(x + r.choice([" ", "  ", "\n", "\t"]) for x in w))
    texts += [None, "", " \n", "one", texts[0], " ".join(["x"] * 120), " ".join(["y"] * 50), " ".join(["z"] * 51)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"repeats": F.lit(1), "word_codes": F.lit("own"), "text_codes": F.lit("own")})
    out = suffixes.words_without_repeats(df, into="gone").withColumn("left", suffixes.cut_words(repeats="gone")).collect()
    got = {x["doc_id"]: x for x in out}
    want = brute_words(texts)
    assert [" ".join(re.findall(r"[^\x20\x09-\x0D]+", got[i]["left"] or "")) for i in range(len(texts))] == want
    assert got[texts.index(None)]["left"] is None and all(x["word_codes"] == "own" and x["text_codes"] == "own" and x["repeats"] == 1 for x in out)
    assert any(w != " ".join((t or "").split()) for w, t in zip(want, texts)) and any(w and w == " ".join((t or "").split()) for w, t in zip(want, texts))


def test_merge_gives_the_order_and_the_shared_lengths():
    r = random.Random(5)
    strings = sorted("".join(r.choice("ab") for _ in range(12)).encode() for _ in range(200))
    dealt = [sorted(x) for x in (strings[i::7] for i in range(7))]
    number = {i: s for i, s in enumerate(strings)}
    parts = []
    for own in dealt + [[]]:
        ids = [next(i for i, s in number.items() if s == x) for x in own]
        shared = suffixes.shared_lengths(np.frombuffer(b"".join(own), np.uint8).reshape(-1, 12)) if own else np.zeros(0, np.uint16)
        parts.append(suffixes.read_part(suffixes.front_code(own, shared, np.array(ids, np.int64), np.zeros(len(own))), 12))
    got = list(suffixes.merge(parts))
    assert [number[i] for _, i, _ in got] == strings
    same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    assert [h for h, _, _ in got[1:]] == [same(a, b) for a, b in zip(strings, strings[1:])]


def test_units_cover_every_window_and_depend_on_its_bytes_alone():
    r = random.Random(6)
    inner = bytes(r.choice(b"abcd ") for _ in range(700))
    seen = []
    for before, after in ((b"", b""), (b"x" * 333, b"y"), (bytes(r.choice(b"ab") for _ in range(200)), b"z" * 500)):
        text = before + inner + after
        anchors, first, last = suffixes.units(text)
        assert [first[0], last[-1]] == [0, len(text) - 400] and all(a == b + 1 for a, b in zip(first[1:], last))
        place = {p: a - len(before) for a, lo, hi in zip(anchors, first, last) for p in range(lo, hi + 1)}
        seen.append([place[p + len(before)] for p in range(301)])
    assert seen[0] == seen[1] == seen[2]


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = suffixes.without_repeats(docs.drop("repeats"))
    assert rows.columns == [*docs.drop("repeats").columns, "repeats"] and rows.count() == docs.count()
    cut = rows.withColumn("text", suffixes.cut_text())
    assert own_columns_kept(cut.withColumn("repeats", F.lit("own repeats")))
    kept = {(r["doc_id"], r["text"]) for r in cut.collect()}
    assert (0, None) in kept and (1, "") in kept
    assert suffixes.without_repeats(documents(spark, [], clashes=False)).count() == 0
