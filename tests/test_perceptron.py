"""Perceptron: gradients against differences, a class boundary no line gives, stopping."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from occgraph.operators import perceptron as N

SCHEMA = "row_id long, label double, features array<double>, role string"


def test_gradient_equals_differences():
    r = np.random.default_rng(0)
    widths = [3, 5, 4, 1]
    flat, x, y = r.normal(size=3 * 5 + 5 + 5 * 4 + 4 + 4 + 1), r.normal(size=(20, 3)), r.integers(0, 2, 20).astype(float)

    def loss(w):
        z = N.margins(w, widths, x)[0]
        return (np.logaddexp(0, z) - y * z).mean() + 0.05 * sum((a**2).sum() for a, _ in N._layers(w, widths))

    g = N.gradient(flat, widths, x, y, 0.1)
    for i in range(len(flat)):
        step = np.zeros_like(flat)
        step[i] = 1e-6
        assert abs((loss(flat + step) - loss(flat - step)) / 2e-6 - g[i]) < 1e-5


def made(spark, n=1500, noise=0.05, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1, 50, 1] + [0, 7, 3]
    y = ((x[:, 0] > 0) != (x[:, 1] > 7)) != (r.uniform(size=n) < noise)
    rows = [(i, float(y[i]), [*x[i].tolist(), 4.0], ["train", "train", "train", "val", "test"][i % 5]) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_learns_what_no_line_separates_and_stops(spark):
    data = made(spark).repartition(4)
    model = N.Perceptron(hidden=(32, 16), rounds=80, batch=50, step=0.01, patience=6).fit(data)
    best = int(np.argmin(model.losses))
    assert model.losses[best] < 0.5 * model.losses[0] and (len(model.losses) == 80 or len(model.losses) - 1 - best == 6)
    scored = data.filter("role = 'test'").withColumn("p", model.score(F.col("features")))
    right = scored.agg(F.avg(((F.col("p") >= 0.5).cast("double") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.85
    noise = N.Perceptron(hidden=(8,), rounds=60, batch=50, step=0.02, patience=3).fit(made(spark, 400, 0.5))
    assert len(noise.losses) < 60


def test_awkward_rows(spark):
    rows = [(1, 1.0, [1.0], "train"), (2, 0.0, [0.0], "train"), (3, None, [1.0], "train"), (4, 1.0, None, "train"), (5, 1.0, [2.0], None)]
    model = N.Perceptron(hidden=(4,), rounds=3).fit(spark.createDataFrame(rows, SCHEMA))
    out = spark.createDataFrame(rows, SCHEMA).withColumn("p", model.score(F.col("features"))).orderBy("row_id").collect()
    assert [r["p"] is None for r in out] == [False, False, False, True, False] and model.losses == []
    assert N.Perceptron(rounds=2).fit(spark.createDataFrame([], SCHEMA)).losses == []
