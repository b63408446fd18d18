"""Cases of a sweep side by side, and folds of many rows."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from occgraph import session as S
from occgraph.operators.knn import knn_graph_pairs
from occgraph.plans import region_sweep as RS
from occgraph.session import materialize

CASES = [(42, "a"), (42, "b"), (1, "c")]


@pytest.fixture
def given(spark):
    records = spark.createDataFrame([(i, i % 2) for i in range(30)], "row_id long, label int")
    rows = [(s, f, i, "test" if i % 3 == n else "train") for n, (s, f) in enumerate(CASES) for i in range(30)]
    return records, spark.createDataFrame(rows, "seed int, fold string, row_id long, role string")


def test_cases_run_side_by_side_with_copies_of_their_own(spark, given, monkeypatch):
    records, splits = given
    barrier, folders = threading.Barrier(len(CASES)), []

    def conditions_of(data, conditions):
        barrier.wait(timeout=60)  # no case ends before all have begun
        copy = materialize(data.filter("role = 'test'"))
        folders.append(copy.inputFiles()[0].rsplit("/", 3)[1])
        for name in conditions:
            yield name, copy.select("row_id", F.col("label").alias("y_true"), F.lit(0.5).alias("y_prob"), F.lit(1).alias("y_pred"))

    monkeypatch.setattr(RS, "run_conditions", conditions_of)
    out = RS.sweep_conditions(records, splits, CASES, {"x": None, "y": None})
    found = sorted(out.select("seed", "region", "condition", "row_id").collect())
    assert found == sorted((s, f, c, i) for n, (s, f) in enumerate(CASES) for c in "xy" for i in range(n, 30, 3))
    assert len(set(folders)) == len(CASES)


def test_a_case_that_fails_fails_the_sweep(spark, given, monkeypatch):
    def broken(data, conditions):
        raise ValueError("no train rows")
        yield

    monkeypatch.setattr(RS, "run_conditions", broken)
    with pytest.raises(ValueError, match="no train rows"):
        RS.sweep_conditions(*given, CASES, {"x": None})


def test_tables_of_many_rows_are_not_broadcast(spark):
    """Copies whose files are small but whose rows are many: the joins of a fold deal them out by key."""
    few = materialize(spark.range(50).select(F.col("id").alias("row_id")))
    many = materialize(spark.range(S.FEW_ROWS + 1).select(F.col("id").alias("row_id")))
    for side, broadcast in ((few, True), (many, False)):
        plan = S.row_sized(side).join(spark.range(60).select(F.col("id").alias("row_id")), "row_id")._jdf.queryExecution().executedPlan().toString()
        assert ("BroadcastHashJoin" in plan) == broadcast and ("SortMergeJoin" in plan) != broadcast


def test_a_fold_of_many_rows_is_dealt_out_and_the_same(spark, monkeypatch):
    rows = [(i, ("train", "train", "val")[i % 3], i % 2, (i * 37 % 100) / 10, (i * 53 % 100) / 10, float(i % 7), [float(i % 5), 1.0]) for i in range(90)]
    nodes = materialize(spark.createDataFrame(rows, "row_id long, role string, label int, lat double, lon double, x0 double, geo array<double>"))
    pairs = materialize(knn_graph_pairs(nodes, 3))
    cfg = RS.SweepConfig(k=3, use_score=False, propagation="weighted_mean", grid=[{"regParam": 0.1, "elasticNetParam": 0.0}])

    def fold(limit):
        plans = []

        def copied(df, *owner):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return materialize(df, *owner)

        monkeypatch.setattr(S, "FEW_ROWS", limit)
        monkeypatch.setattr(RS, "materialize", copied)
        linked = RS.fold_graph(RS.PreparedFold(None, ["x0"], [], RS.row_sized(nodes), pairs), cfg)
        fitted = RS.fit_graph(linked, cfg)
        stored = {r["row_id"]: [r["degree"], r["mean_weight"], r["max_weight"]] for r in linked.stored.collect()}
        return "".join(plans), stored, fitted.classifier.coefficients.toArray()

    (small, stored, weights), (large, stored_dealt, weights_dealt) = fold(10**6), fold(10)
    assert "BroadcastExchange" in small and "BroadcastExchange" not in large and "SortMergeJoin" in large
    assert len(stored) == 90 and stored_dealt == {k: pytest.approx(v, abs=1e-9) for k, v in stored.items()}
    assert weights == pytest.approx(weights_dealt, abs=1e-6)
