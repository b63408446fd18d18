"""Many logistic models at once: equal to separate fits, for groups and for all other folds."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from occgraph.operators import newton as L


def rows(n=900, groups=7, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3))
    g = np.where(np.arange(n) % 3 == 0, 0, np.arange(n) % groups)  # a third of all rows in one group
    y = (r.uniform(size=n) < 1 / (1 + np.exp(-(x @ [1.0, -0.5, 0.2] + 0.3 * g - 0.5)))).astype(float)
    return [(i, f"g{g[i]}", float(y[i]), x[i].tolist()) for i in range(n)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(rows(), "row_id long, grp string, label double, features array<double>").cache()


def coefficients(fits):
    return {r["model"]: [*r["coefficients"], r["intercept"]] for r in fits.collect()}


def separate(df, l2):
    model = LogisticRegression(regParam=l2, standardization=False, tol=1e-12, maxIter=500).fit(df.withColumn("features", array_to_vector("features")))
    return [*model.coefficients.toArray(), model.intercept]


@pytest.mark.parametrize("on", ["own", "others"])
def test_equals_separate_fits(data, on):
    fits = L.logistic_fits(data, "grp", on=on, l2=0.01)
    assert all(r["converged"] and r["rounds"] < 12 for r in fits.collect())
    found = coefficients(fits)
    assert set(found) == {f"g{i}" for i in range(7)}
    for g in ("g0", "g1", "g5"):
        mine = F.col("grp") == g
        assert np.allclose(found[g], separate(data.filter(mine if on == "own" else ~mine), 0.01), atol=1e-6)


def test_gradient_vanishes_in_every_model(spark):
    """Hundreds of groups take as many jobs as one; other folds come in several passes."""
    given = rows(6000, 300, 1)
    df = spark.createDataFrame(given, "row_id long, grp string, label double, features array<double>")
    x = np.column_stack([np.array([g[3] for g in given]), np.ones(len(given))])
    y, g = np.array([r[2] for r in given]), np.array([r[1] for r in given])
    for on, c in (("own", 1.0), ("others", None)):
        fits = L.logistic_fits(df, "grp", on=on, l2=0.05, c=c)
        assert fits.count() == len(set(g)) > 200
        for r in fits.collect()[:40]:
            use = (g == r["model"]) if on == "own" else (g != r["model"])
            beta = np.array([*r["coefficients"], r["intercept"]])
            assert r["converged"] and r["n"] == use.sum()
            penalty = 1 / (c * use.sum()) if c else 0.05
            gradient = x[use].T @ (1 / (1 + np.exp(-x[use] @ beta)) - y[use]) / use.sum() + penalty * np.append(beta[:-1], 0)
            assert np.abs(gradient).max() < 1e-8


def test_steps_that_overshoot_are_halved(spark):
    """Steep, nearly separated classes: a plain Newton step from zero would leave the range of exp."""
    given = [(i, "a", float(i > 500), [float((i - 500) ** 3) / 1e6]) for i in range(0, 1000, 7)] + [(-1, "a", 1.0, [-120.0])]
    df = spark.createDataFrame(given, "row_id long, grp string, label double, features array<double>")
    assert np.allclose(coefficients(L.logistic_fits(df, "grp", l2=1e-3))["a"], separate(df, 1e-3), rtol=1e-4)


def test_scores_and_left_out_rows(data):
    fits = L.logistic_fits(data, "grp", on="others", l2=0.01)
    beta = coefficients(fits)
    scored = L.leave_out_scores(data, "grp", l2=0.01).collect()
    assert len(scored) == data.count()
    for r in scored[:50]:
        z = sum(a * b for a, b in zip([*r["features"], 1.0], beta[r["grp"]]))
        assert math.isclose(r["y_prob"], 1 / (1 + math.exp(-z)), rel_tol=1e-9)


def test_pooled_and_grouped(spark, data):
    roles = data.withColumn("role", F.when(F.col("row_id") % 5 == 0, "test").otherwise("train"))
    small = spark.createDataFrame([(10_000 + i, "tiny", 1.0, [0.0, 0.0, 0.0], "train") for i in range(5)] + [(10_010, "tiny", 0.0, [0.0, 0.0, 0.0], "test")], roles.schema)
    preds, skipped = L.pooled_and_grouped(roles.unionByName(small), "grp", l2=0.01)
    assert [tuple(r) for r in skipped.collect()] == [("tiny", "too few train rows")]
    n = roles.filter("role = 'test'").count()
    assert {r["model"]: r["count"] for r in preds.groupBy("model").count().collect()} == {"pooled": n + 1, "by_group": n}


def test_awkward_rows(spark):
    schema = "row_id long, grp string, label double, features array<double>"
    given = [(1, "a", 1.0, [1.0]), (2, "a", 0.0, [0.0]), (3, "a", 0.0, [1.0]), (4, "a", 1.0, [0.0]), (5, None, 1.0, [1.0]), (6, "a", None, [1.0]), (7, "a", 1.0, None), (8, "one", 1.0, [1.0])]
    found = {r["model"]: r for r in L.logistic_fits(spark.createDataFrame(given, schema), "grp", max_rounds=30).collect()}
    assert found["a"]["n"] == 4 and found["a"]["converged"] and abs(found["a"]["intercept"]) < 1e-6
    assert found["one"]["n"] == 1 and not found["one"]["converged"]
    others = {r["model"]: r["n"] for r in L.logistic_fits(spark.createDataFrame(given, schema), "grp", on="others", max_rounds=5).collect()}
    assert others == {"a": 2, "one": 5}
    assert L.logistic_fits(spark.createDataFrame([], schema), "grp").count() == 0
    with pytest.raises(ValueError):
        L.logistic_fits(spark.createDataFrame(given, schema), "grp", on="all")
