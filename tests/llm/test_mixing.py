"""Mixing: targets against a loop, samples near them, Pareto order."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from occgraph.llm import mixing
from tests.llm.awkward import CLASHES, SCHEMA, documents, own_columns_kept


def targets_by_rounds(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Share by weight, stop at the cap, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        if not left:
            return fixed
        share = (total - sum(fixed.values())) / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * share > most * sizes[s]]
        if not over:
            return fixed | {s: weight[s] * share for s in left}
        fixed |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_the_loop(spark, seed):
    r = random.Random(seed)
    sizes = {None if i == 3 else f"s{i}": r.choice([0, 1, 50, 1000, 100_000]) for i in range(r.randint(1, 12))}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {x["source"]: x["target"] for x in mixing.source_targets(df).collect()}
    want = targets_by_rounds(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def corpus(spark, n=3000, sources=5):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * int(r.paretovariate(1.2) * 20)), "en", f"s{0 if r.random() < 0.4 else r.randrange(sources)}", 0) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_words_taken_come_near_the_targets(spark):
    docs = corpus(spark)
    rows = mixing.mix_copies(docs).collect()
    assert len(rows) == 3000 and max(x["copies"] for x in rows) <= 3
    taken = collections.Counter()
    for x in rows:
        taken[x["source"]] += x["copies"] * x["size"]
        assert x["copies"] >= int(x["target"] / x["source_size"])  # certain whole copies
    for x in rows:
        assert taken[x["source"]] <= x["target"] + 1e-6 and taken[x["source"]] >= 0.99 * x["target"]
    again = mixing.mix_copies(docs.repartition(7)).collect()
    assert sorted((x["doc_id"], x["copies"]) for x in rows) == sorted((x["doc_id"], x["copies"]) for x in again)


def test_inclusion_follows_the_weights(spark):
    """With a rate per document, the extra copy is as frequent as its probability says."""
    docs = corpus(spark, sources=1).withColumn("rate", F.when(F.col("doc_id") % 3 == 0, 3.0).otherwise(1.0)).withColumn("text", F.lit("one two three"))
    rows = mixing.mix_copies(docs, weight="rate", weights=(1,)).collect()
    mean = {k: sum(x["copies"] for x in rows if (x["doc_id"] % 3 == 0) == k) / sum((x["doc_id"] % 3 == 0) == k for x in rows) for k in (True, False)}
    assert mean[True] / mean[False] == pytest.approx(3, rel=0.1)


def test_awkward_rows(spark):
    docs = documents(spark)
    rows = mixing.mix_copies(docs).collect()
    assert len(rows) == docs.count() and all(x["copies"] * x["size"] == 0 for x in rows if x["doc_id"] in (0, 1, 2))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and own_columns_kept(mixed) and len(CLASHES) + 5 == len(mixed.columns)
    want = collections.Counter({(x["doc_id"], x["size"]): 0 for x in rows})
    for x in rows:
        want[x["doc_id"], x["size"]] += x["copies"]
    got = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert got == collections.Counter({d: sum(c for (e, _), c in want.items() if e == d) for d, _ in want}) - collections.Counter()
    assert mixing.mix_copies(documents(spark, [])).count() == 0 and mixing.mix(documents(spark, [])).count() == 0
