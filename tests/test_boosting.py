"""Leaf-wise boosting: equal to a grower that splits one leaf at a time; stopping; folds."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from occgraph.operators import boosting as B

SCHEMA = "row_id long, label double, features array<double>, role string"


def made(n=600, seed=0, width=5):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, width)), 1)
    x[:, 3] = 1.0  # never split
    x[r.uniform(size=n) < 0.1, 1] = np.nan
    z = np.where(np.nan_to_num(x[:, 0]) > 0, 2.0, -1.0) * np.where(np.nan_to_num(x[:, 2]) > 0.3, 1.0, -0.6) + np.nan_to_num(x[:, 1])
    y = (r.uniform(size=n) < 1 / (1 + np.exp(-2 * z))).astype(float)
    return x, y


def frame(spark, x, y, roles=None):
    rows = [(i, float(y[i]), [float(v) for v in x[i]], roles[i] if roles else "train") for i in range(len(y))]
    return spark.createDataFrame(rows, SCHEMA)


def plain(x, y, edges, config):
    """One model, one split at a time, on all rows and features."""
    bins = np.column_stack([np.where(np.isnan(x[:, f]), len(e), np.searchsorted(e, x[:, f])) for f, e in enumerate(edges)])
    rate = y.mean()
    margin = np.full(len(y), np.log(rate / (1 - rate)))
    trees = []
    for _ in range(config.iterations):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node, splits = np.ones(len(y), dtype=int), {}

        def best(n):
            at = node == n
            found = None
            for f in range(x.shape[1]):
                for b in range(config.bins - 1):
                    left, right = at & (bins[:, f] <= b), at & (bins[:, f] > b)
                    if min(left.sum(), right.sum()) < config.min_rows:
                        continue
                    gain = round(sum(g[s].sum() ** 2 / (h[s].sum() + config.l2) * w for s, w in ((left, 1), (right, 1), (at, -1))), 9)
                    if gain > 1e-9 and (found is None or gain > found[0]):
                        found = gain, f, b
            return found

        open_nodes = {1: best(1)}
        while len(splits) < config.leaves - 1 and any(open_nodes.values()):
            n = max((k for k, s in open_nodes.items() if s), key=lambda k: (open_nodes[k][0], -k))
            _, f, b = open_nodes.pop(n)
            splits[n] = f, b
            node[node == n] = np.where(bins[node == n, f] <= b, 2 * n, 2 * n + 1)
            for c in (2 * n, 2 * n + 1):
                open_nodes[c] = best(c) if c < 1 << config.max_depth else None
        if not splits:
            break
        for n in open_nodes:
            at = node == n
            margin[at] -= config.learning_rate * g[at].sum() / (h[at].sum() + config.l2)
        trees.append(splits)
    return trees, 1 / (1 + np.exp(-margin))


@pytest.mark.parametrize("config", [
    B.BoostConfig(iterations=6, leaves=9, bins=16, min_rows=15, learning_rate=0.3, row_share=1.0, feature_share=1.0),
    B.BoostConfig(iterations=3, leaves=64, max_depth=3, bins=16, min_rows=15, learning_rate=0.3, row_share=1.0, feature_share=1.0)])
def test_equals_a_grower_of_single_splits(spark, monkeypatch, config):
    monkeypatch.setattr(B, "FEATURE_BLOCK", 2)
    monkeypatch.setattr(B, "SNAPSHOT", 2)
    x, y = made()
    data = frame(spark, x, y).repartition(4)
    fit = B.boosted_with_stop(data, config)
    trees, p = plain(x, y, fit.edges, config)
    assert [t.splits for t in fit.trees[0]] == trees and max(map(len, trees)) > 4
    scored = data.withColumn("p", fit.score(F.col("features"), F.lit(0))).collect()
    assert np.allclose([r["p"] for r in scored], [p[r["row_id"]] for r in scored])
    assert not any(f == 3 for t in trees for f, _ in t.values())
    gains = fit.importance(list("abcde"))
    assert abs(sum(gains.values()) - 1) < 1e-9 and gains["d"] == 0 and gains["a"] > gains["e"]


def test_stops_where_the_watched_loss_ends_falling(spark):
    x, y = made(900, 2)
    roles = ["val" if i % 3 == 0 else "train" for i in range(900)]
    config = B.BoostConfig(iterations=60, leaves=12, bins=32, learning_rate=0.4, patience=4)
    fit = B.boosted_with_stop(frame(spark, x, y, roles), config)
    losses = fit.losses[0]
    best = int(np.argmin(losses))
    assert len(fit.trees[0]) == best and losses[best] < 0.9 * losses[0] and len(losses) - 1 - best == 4 and len(losses) < 60
    noise = B.boosted_with_stop(frame(spark, x, np.random.default_rng(5).integers(0, 2, 900), roles), config)
    assert len(noise.losses[0]) < 20
    again = B.boosted_with_stop(frame(spark, x, y, roles).repartition(7), config)
    assert [t.splits for t in again.trees[0]] == [t.splits for t in fit.trees[0]]


def test_many_models_in_the_same_jobs_equal_single_ones(spark):
    x, y = made(700, 3)
    config = B.BoostConfig(iterations=3, leaves=6, bins=16, learning_rate=0.3, row_share=1.0, feature_share=1.0)
    data = frame(spark, x, y).withColumn("fold", (F.col("row_id") % 3).cast("int"))
    others = data.withColumns({"trains": F.filter(F.array(*[F.lit(i) for i in range(3)]), lambda m: m != F.col("fold")), "watches": F.array("fold")})
    fit = B.fit_boosted(others, 3, config)
    for m in range(3):
        use = np.arange(700) % 3 != m
        trees, _ = plain(x[use], y[use], fit.edges, config)
        assert [t.splits for t in fit.trees[m]] == trees
    scored = data.withColumn("p", fit.score(F.col("features"), F.col("fold")))
    assert scored.filter("p between 0 and 1").count() == 700


def test_swapped_features_change_the_score(spark):
    """Equal to scoring every variant of every row; a feature that no tree uses changes nothing."""
    x, y = made(300, 4)
    data = frame(spark, x, y)
    fit = B.boosted_with_stop(data, B.BoostConfig(iterations=5, leaves=6, bins=16, learning_rate=0.3))
    found = {r["feature"]: r["importance"] for r in B.swap_importance(fit, data, list("abcde")).collect()}
    order = sorted(range(300), key=lambda i: hashlib.md5(f"donor|42|{i}".encode()).hexdigest())
    donor = {i: order[(p + 1) % 300] for p, i in enumerate(order)}
    variants = [(i * 10 + f, 0.0, [float(x[donor[i], g]) if g == f else float(x[i, g]) for g in range(5)], "t") for i in range(300) for f in range(5)]
    base = {r["row_id"]: r["p"] for r in data.withColumn("p", fit.score(F.col("features"), F.lit(0))).collect()}
    scored = spark.createDataFrame(variants, SCHEMA).withColumn("p", fit.score(F.col("features"), F.lit(0))).collect()
    for f, name in enumerate("abcde"):
        assert np.isclose(found[name], np.mean([abs(r["p"] - base[r["row_id"] // 10]) for r in scored if r["row_id"] % 10 == f]))
    assert found["d"] == 0 and found["a"] > found["e"]


def test_awkward_rows(spark):
    config = B.BoostConfig(iterations=2, min_rows=1, bins=4)
    rows = [(1, 1.0, [1.0], "train"), (2, 0.0, [0.0], "train"), (3, None, [1.0], "train"), (4, 1.0, None, "train"), (5, 1.0, [None], "train"), (6, 1.0, [1.0], None), (6, 1.0, [1.0], "val")]
    fit = B.boosted_with_stop(spark.createDataFrame(rows, SCHEMA), config)
    out = spark.createDataFrame(rows, SCHEMA).withColumn("p", fit.score(F.col("features"), F.when(F.col("row_id") < 5, 0))).orderBy("row_id").collect()
    assert [r["p"] is None for r in out] == [False, False, False, True, True, True, True]
    one_class = B.boosted_with_stop(spark.createDataFrame(rows[:1], SCHEMA), config)
    assert one_class.trees == [[]] and one_class.bases[0] > 20
    nothing = B.boosted_with_stop(spark.createDataFrame([], SCHEMA), config)
    assert nothing.bases == [0.0] and nothing.trees == [[]]
