"""Ordinal regression: fit against known data, held-out accuracy, order of grades."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from occgraph.llm import toxicity
from tests.llm.awkward import documents, own_columns_kept

LABELS = "doc_id long, quality int, toxic int"


def test_one_weight_serves_all_thresholds():
    r = np.random.default_rng(0)
    x = r.integers(0, 6, (4000, 3)).astype(float)
    score = x @ np.array([1.0, -0.5, 0.0])
    noise = np.log(1 / r.random(4000) - 1)
    grades = (score + noise > 1.0).astype(int) + (score + noise > 3.5)
    rows = [([j for j in range(3) if v[j]], [v[j] for j in range(3) if v[j]]) for v in x]
    weights, thresholds = toxicity.fit_thresholds(rows, grades, 3)
    assert np.allclose(weights, [1.0, -0.5, 0.0], atol=0.12) and np.allclose(thresholds, [1.0, 3.5], atol=0.25)


def corpus(spark, n=1500):
    r = np.random.default_rng(1)
    clean = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = list(r.choice(clean, 60))
        toxic = i % 5 == 0
        if toxic:
            for w in r.choice(["vile", "nastiness", "nastier", "scummy"], r.choice([2, 12])):
                words.insert(r.integers(0, len(words)), w)
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return documents(spark, rows, clashes=False), spark.createDataFrame(labels, LABELS), {i: t for i, _, t in labels}


def test_held_out_texts(spark):
    docs, labels, truth = corpus(spark)
    model = toxicity.fit_severity(docs, labels.filter("doc_id % 3 <> 0"))
    rows = [r for r in toxicity.severity(docs, model).select("doc_id", "text", "severity.*").collect() if r["doc_id"] % 3 == 0]
    right = np.mean([(r["p_toxic"] >= 0.5) == truth[r["doc_id"]] for r in rows])
    assert right > 0.98 and model.thresholds[0] < model.thresholds[1]
    hits = {r["doc_id"]: sum(w.startswith(("vile", "nasti", "scum")) for w in r["text"].split()) for r in rows}
    few = [r["expected"] for r in rows if 0 < hits[r["doc_id"]] <= 3]
    many = [r["expected"] for r in rows if hits[r["doc_id"]] > 6]
    assert np.mean(few) + 0.3 < np.mean(many)
    assert all(abs(r["expected"] - (r["p_toxic"] + r["p_severe"])) < 1e-9 for r in rows)  # P(over 0) + P(over 1)


def test_awkward_rows(spark):
    docs = documents(spark)
    none = spark.createDataFrame([], LABELS)
    for labels in (none, spark.createDataFrame([(3, None, None), (4, 1, 0), (4, 1, 1), (99, 1, 1), (None, 1, 1)], LABELS), spark.createDataFrame([(3, 1, 0)], LABELS)):
        model = toxicity.fit_severity(docs, labels)
        rows = toxicity.severity(docs.drop("severity"), model)
        got = rows.select("doc_id", "severity.*").collect()
        assert len(got) == docs.count() and all(0 <= r["expected"] <= 2 for r in got)
        assert own_columns_kept(rows.withColumn("severity", F.lit("own severity")))
    assert toxicity.severity(docs.limit(0), model).count() == 0
