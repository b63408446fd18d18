"""The language model: recursions against sums over paths, scores against counts."""

from __future__ import annotations

import binascii
import collections
import itertools
import math

import numpy as np
import pytest

from occgraph.llm import hmm
from occgraph.llm.common import table
from tests.llm.awkward import documents


def random_model(states=3, seed=0):
    r = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    return hmm.Model(norm(r.random(states), 0), norm(r.random((states, states)), 1), norm(r.random((hmm.CLASSES, states)), 0))


def by_paths(model, codes):
    """Probability and expected counts by summing over all paths."""
    k, total = len(model.start), 0.0
    start, moves, emitted = np.zeros(k), np.zeros((k, k)), np.zeros((hmm.CLASSES, k))
    for path in itertools.product(range(k), repeat=len(codes)):
        p = model.start[path[0]] * model.emit[codes[0], path[0]]
        for a, b, c in zip(path[:-1], path[1:], codes[1:]):
            p *= model.move[a, b] * model.emit[c, b]
        total += p
        start[path[0]] += p
        for a, b in zip(path[:-1], path[1:]):
            moves[a, b] += p
        for s, c in zip(path, codes):
            emitted[c, s] += p
    return total, start / total, moves / total, emitted / total


def test_recursions_equal_sums_over_paths():
    model, r = random_model(), np.random.default_rng(1)
    texts = [r.integers(0, hmm.CLASSES, n).astype(np.uint16) for n in (1, 6, 3, 1, 5)]
    laid, offsets, order = hmm._time_major(texts)
    logs = np.empty(len(texts))
    logs[order] = hmm.forward(model, laid, offsets, len(texts))[2]
    want = [by_paths(model, t) for t in texts]
    assert logs == pytest.approx([math.log(w[0]) for w in want])
    for got, i in zip(hmm.expected_counts(model, laid, offsets, len(texts)), (1, 2, 3)):
        assert got == pytest.approx(sum(w[i] for w in want))


def test_training_raises_the_likelihood():
    r = np.random.default_rng(2)
    texts = [(r.integers(0, 50, 60) + 50 * (i % 3)).astype(np.uint16) for i in range(30)]
    laid, offsets, _ = hmm._time_major(texts)
    model, seen = random_model(seed=3), []
    for _ in range(6):
        seen.append(hmm.forward(model, laid, offsets, len(texts))[2].sum())
        model = hmm._maximized(*hmm.expected_counts(model, laid, offsets, len(texts)))
    assert all(b > a for a, b in zip(seen, seen[1:]))


def test_scores_of_a_corpus(spark, sf):
    docs = table(spark, sf, "documents")
    got = hmm.score_texts(docs).collect()
    rows = {r["doc_id"]: (r["text"] or "").encode().lower().split() + [None] for r in docs.collect()}
    out = {d: binascii.crc32(str(d).encode()) % 7 == 2 for d in rows}
    counts = collections.Counter(w for d, ws in rows.items() if not out[d] for w in ws)
    n, v = sum(counts.values()), len(counts)
    better = 0
    for r in got:
        words = rows[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[r["doc_id"]], len(words), sum(w in counts for w in words), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words))
        better += r["held_out"] and r["score"] > r["base_score"]
    assert better > 0.9 * sum(out.values())


def test_a_class_shares_out_all_its_probability(spark):
    """Over all words of the vocabulary and one unknown word a class, one-word texts' next-token probabilities add up to 1."""
    docs = spark.createDataFrame([(i, f"alpha beta gamma{i} delta{i % 5} beta", None, None, None) for i in range(60)], "doc_id long, text string, lang string, source string, n long")
    marked = docs.select("doc_id", "text", hmm.held_out(docs.doc_id).alias("held_out"))
    vocab, words = hmm.vocabulary(marked, "hmm_test")
    own = collections.defaultdict(float)
    for r in vocab.collect():
        code = words.head[r["word"].encode()][0]
        own[code] += 1.0 if code < hmm.OWN else r["n"] / words.class_total[code - hmm.OWN]
    for i in range(hmm.SPELLINGS):
        if words.class_total[i]:
            own[hmm.OWN + i] += words.class_kinds[i] / words.class_total[i]
    assert all(p == pytest.approx(1) for p in own.values())


def test_awkward_rows(spark):
    docs = documents(spark)
    got = hmm.score_texts(docs).collect()
    assert len(got) == docs.count() and all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert hmm.score_texts(documents(spark, [])).count() == 0
    one = hmm.score_texts(documents(spark, [(1, "a b", "en", "s", 1), (1, "a b", "en", "s", 1)])).collect()
    assert len(one) == 2 and one[0] == one[1]
