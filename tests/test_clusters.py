"""Grouped K-means against plain Lloyd rounds from the same centres."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from occgraph.operators import clusters as C

SCHEMA = "row_id long, grp string, x array<double>"


def plain(x, centres):
    for _ in range(200):
        square = ((x[:, None] - centres) ** 2).sum(axis=2)
        cell = square.argmin(axis=1)
        new = centres.copy()
        taken = False
        for c in range(len(centres)):
            if (cell == c).any():
                new[c] = x[cell == c].mean(axis=0)
            elif not taken:
                new[c], taken = x[square.min(axis=1).argmax()], True
        if np.abs(new - centres).max() <= 1e-9:
            break
        centres = new
    return cell, ((x - centres[cell]) ** 2).sum(), centres


def made(seed=0):
    r = np.random.default_rng(seed)
    return {g: np.concatenate([r.normal(size=(n // 4, 2)) + r.uniform(-6, 6, 2) for _ in range(4)]) for g, n in (("a", 400), ("b", 120), ("c", 60))}


def frame(spark, given):
    rows = [(i, g, p.tolist()) for g, x in given.items() for i, p in enumerate(x)]
    return spark.createDataFrame([(n, g, p) for n, (_, g, p) in enumerate(rows)], SCHEMA).repartition(5)


def test_equals_plain_rounds_from_the_same_centres(spark):
    given = made()
    points = frame(spark, given)
    first = C.first_centres(points, 4, 7, 3)
    assert set(first) == {(g, s) for g in given for s in range(3)} and all(len(c) == 4 for c in first.values())
    labels, best = C.grouped_kmeans(points, 4, 7, 3)
    want = {key: plain(given[key[0]], c.copy())[1] for key, c in first.items()}
    for g in given:
        start, cost = best[g]
        assert np.isclose(cost, min(want[g, s] for s in range(3))) and np.isclose(cost, want[g, start])
    cells = {(r["grp"], r["row_id"]): r["cell"] for r in labels.collect()}
    at = 0
    for g, x in given.items():
        cell = plain(x, first[g, best[g][0]].copy())[0]
        assert [cells[g, at + i] for i in range(len(x))] == cell.tolist()
        at += len(x)


def test_a_cell_without_points_takes_the_farthest(spark):
    given = {"a": np.array([[0.0], [0.1], [0.2], [9.0], [9.1], [30.0]])}
    begin = {("a", 0): np.array([[0.0], [100.0], [9.0]])}
    labels, best = C.grouped_kmeans(frame(spark, given), 3, begin=begin)
    assert [r["cell"] for r in labels.orderBy("row_id").collect()] == [0, 0, 0, 2, 2, 1] and np.isclose(best["a"][1], 0.02 + 0.005)


def test_awkward_rows(spark):
    rows = [(1, "a", [1.0, 2.0]), (2, "a", [1.0, 2.0]), (2, "a", [1.0, 2.0]), (3, "b", [0.0, 0.0]), (4, "b", [1.0, 1.0]), (5, None, [1.0, 1.0]), (6, "a", None), (7, "b", [None, 1.0])]
    labels, best = C.grouped_kmeans(spark.createDataFrame(rows, SCHEMA), 5, starts=2)
    got = labels.collect()
    assert sorted((r["row_id"], r["grp"]) for r in got) == [(1, "a"), (2, "a"), (2, "a"), (3, "b"), (4, "b")]
    assert len({r["cell"] for r in got if r["grp"] == "a"}) == 1 and len({r["cell"] for r in got if r["grp"] == "b"}) == 2
    assert best["a"] == (0, 0.0) and best["b"] == (0, 0.0)
    labels, best = C.grouped_kmeans(spark.createDataFrame([], SCHEMA), 5)
    assert labels.count() == 0 and best == {}


def test_rows_of_one_partition_are_dealt_to_many_tasks(spark):
    given = made()
    one = frame(spark, given).coalesce(1)
    found, _ = C.grouped_kmeans(one, 4, 7, 2)
    rows = found.withColumn("task", F.spark_partition_id()).collect()
    assert len({r["task"] for r in rows}) > 1
    assert len(rows) == sum(map(len, given.values()))
