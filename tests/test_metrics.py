"""Metrics and inference against direct computations."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from occgraph.functions import hashing as H
from occgraph.functions.stats import t_two_sided
from occgraph.operators import infer as I
from occgraph.operators import replicates as R
from occgraph.operators import metrics as M
from occgraph.operators.ranking import average_ranks, grouped_quantiles


def auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))


def average_precision(y, p):
    total, before = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        kept = p >= t
        recall = y[kept].sum() / y.sum()
        total += (recall - before) * y[kept].mean()
        before = recall
    return total


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(1)
    n = 3000
    hot = rng.random(n) < 0.4  # one key and one score hold much of the data
    pdf = pd.DataFrame({"k": np.where(hot, "hot", rng.choice(list("abc"), n)), "y_true": rng.integers(0, 2, n), "row_id": np.arange(n)})
    pdf["y_prob"] = np.where(rng.random(n) < 0.3, 0.5, np.round(rng.random(n), 3))
    pdf["y_pred"] = (pdf.y_prob >= 0.5).astype(int)
    return pdf, spark.createDataFrame(pdf)


def test_rank_metrics(scored):
    pdf, df = scored
    found = M.rank_metrics(df, ["k"]).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        assert found.roc_auc[k] == pytest.approx(auc(g.y_true.to_numpy(), g.y_prob.to_numpy()), abs=1e-12)
        assert found.pr_auc[k] == pytest.approx(average_precision(g.y_true.to_numpy(), g.y_prob.to_numpy()), abs=1e-12)


def test_auc_properties(scored):
    _, df = scored
    whole = M.rank_metrics(df, []).first()["roc_auc"]
    flipped = M.rank_metrics(df.withColumn("y_prob", 1 - F.col("y_prob")), []).first()["roc_auc"]
    constant = M.rank_metrics(df.withColumn("y_prob", F.lit(0.3)), []).first()["roc_auc"]
    assert whole + flipped == pytest.approx(1) and constant == 0.5


def test_single_class_is_null_and_f1_zero(scored):
    _, df = scored
    none = df.withColumn("y_true", F.lit(0))
    assert M.rank_metrics(none, []).first()["roc_auc"] is None
    assert M.classification_metrics(none, []).first()["f1"] == 0


def test_bin_edges(spark):
    df = spark.createDataFrame([(0.0, 0), (0.1, 0), (0.3, 1), (1.0, 1)], "y_prob double, y_true int")
    bins = {r.bin: r.n for r in M.reliability_bins(df, []).collect()}
    assert bins == {0: 1, 1: 1, 2: 1, 9: 1}  # 0.3 lies below the third edge 3 * 0.1


def test_quantiles_and_ranks_with_a_hot_key(scored):
    pdf, df = scored
    found = grouped_quantiles(df, ["k"], "y_prob", {"q1": 0.25, "mid": 0.5, "top": 1.0}).toPandas().set_index("k")
    want = pdf.groupby("k").y_prob.quantile([0.25, 0.5, 1.0]).unstack()
    assert np.allclose(found.loc[want.index, ["q1", "mid", "top"]], want)
    ranks = average_ranks(df, ["k"], "y_prob", "r").toPandas().set_index("row_id").r
    assert np.allclose(ranks.sort_index(), pdf.groupby("k").y_prob.rank().to_numpy())


def plain_metric(metric, score, truth, called, w):
    """One replicate by loops over the distinct scores."""
    if metric == "brier":
        return (w * (score - truth) ** 2).sum() / w.sum() if w.sum() else None
    if metric == "f1":
        tp, wrong = w[(truth == 1) & (called == 1)].sum(), w[truth != called].sum()
        return 2 * tp / (2 * tp + wrong) if tp + wrong else 0.0
    pos, neg = w * truth, w * (1 - truth)
    if not pos.sum() or not neg.sum():
        return None
    if metric == "roc_auc":
        return sum(p * (neg[score < s].sum() + neg[score == s].sum() / 2) for p, s in zip(pos, score)) / pos.sum() / neg.sum()
    return sum(pos[score == s].sum() * pos[score >= s].sum() / w[score >= s].sum() for s in np.unique(score) if w[score >= s].sum()) / pos.sum()


@pytest.mark.parametrize("metric", I.METRIC_NAMES)
def test_replicates_equal_loops(spark, monkeypatch, metric):
    """A third of the scores are equal; clusters of unlike sizes, more of them than are held at a time; a key with one class."""
    monkeypatch.setattr(R, "CELLS", 100)
    r = np.random.default_rng(3)
    n = 400
    score = np.where(r.uniform(size=n) < 0.35, 0.5, np.round(r.uniform(size=n), 2))
    truth, region = (r.uniform(size=n) < score).astype(int), np.minimum(r.geometric(0.2, n), 19)
    model = np.array(["m", "n", "one"])[np.minimum(np.arange(n) // 180, 2)]
    truth[model == "one"] = 1
    rows = [(i, str(model[i]), f"r{region[i]}", float(score[i]), int(truth[i]), int(score[i] >= 0.5)) for i in range(n)]
    preds = spark.createDataFrame(rows, "row_id long, model string, region string, y_prob double, y_true int, y_pred int").repartition(6)
    draws = I.materialize(I.cluster_draws(preds, "region", 15))
    drawn = {(x["rep"], x["region"]): x["w"] for x in draws.collect()}
    got = {(x["model"], x["rep"]): x[metric] for x in I.cluster_replicates(preds, draws, metric, 15).collect()}
    assert len(got) == 45
    own = {k: model == k for k in ("m", "n", "one")}
    for (k, rep), value in got.items():
        w = np.array([drawn.get((rep, f"r{c}"), 0) for c in region], float)[own[k]]
        want = plain_metric(metric, score[own[k]], truth[own[k]], (score >= 0.5).astype(int)[own[k]], w)
        assert value is None if want is None else value == pytest.approx(want, abs=1e-12)
    named = I._replicate_rows(preds, ["model"], F.col("row_id").cast("string")).withColumn("n", F.lit(1))
    weights = R.row_draws([str(i) for i in range(n)], 42, 9)
    for x in R.replicate_values(named, ["model"], metric, 9, lambda ids: R.row_draws(ids, 42, 9)).collect():
        mine = own[x["model"]]
        want = plain_metric(metric, score[mine], truth[mine], (score >= 0.5).astype(int)[mine], weights[mine, x["rep"]].astype(float))
        assert x[metric] is None if want is None else x[metric] == pytest.approx(want, abs=1e-12)


def test_draws_are_those_of_md5():
    """Texts of unlike lengths, some longer than a block of the hash; numbers beside every step."""
    ids = [f"m{i % 3}|42|{i * i}" for i in range(300)] + ["", "é|ß", *["x" * n for n in range(40, 70)], "y" * 200]
    words = lambda k, i: np.frombuffer(hashlib.md5(f"boot|7|{k}|{i}".encode()).digest(), ">u4")
    want = np.array([np.concatenate([words(k, i) for k in range(103)]) for i in ids])[:, :410]
    assert (R.row_draws(ids, 7, 410) == np.searchsorted(H.POISSON_STEPS, want / 4294967296.0, side="right")).all()
    beside = np.array([int(x * 2**32) + d for x in H.POISSON_STEPS[:-1] for d in (-1, 0, 1)], np.uint32)
    assert (H.poisson_weights(beside) == np.searchsorted(H.POISSON_STEPS, beside / 4294967296.0, side="right")).all()


@pytest.mark.parametrize("metric", ["roc_auc", "pr_auc"])
def test_ties_are_drawn_once(spark, monkeypatch, metric):
    """Runs of equal scores become one row before the ranges are read, and the values stay."""
    monkeypatch.setattr(R, "TIES", 4)
    monkeypatch.setattr(R, "SALTS", 2)
    r = np.random.default_rng(5)
    score, truth = np.where(r.uniform(size=300) < 0.5, 0.5, np.round(r.uniform(size=300), 2)), r.integers(0, 2, 300)
    rows = spark.createDataFrame([(0, str(i), float(s), int(t), None, 1, 0) for i, (s, t) in enumerate(zip(score, truth))], "k int, id string, score double, truth int, called int, n int, value_range int")
    draws = lambda ids: R.row_draws(ids, 42, 9)
    added = R._ties_added(rows, ["k"], 9, draws, 3).toPandas()
    assert added["added"].notna().sum() >= 2 and len(added) < 200 and (added["id"].notna() == added["added"].isna()).all()
    weights = R.row_draws([str(i) for i in range(300)], 42, 9).astype(float)
    for x in R.replicate_values(rows.drop("value_range"), ["k"], metric, 9, draws).collect():
        assert x[metric] == pytest.approx(plain_metric(metric, score, truth, None, weights[:, x["rep"]]), abs=1e-12)


def test_few_files_are_many_tasks(spark, monkeypatch):
    """A table of one file is dealt to several tasks before its rows are drawn."""
    monkeypatch.setattr(R, "RANGE_ROWS", 50)
    rows = spark.range(400).coalesce(1).selectExpr("0 AS k", "cast(id AS string) AS id", "id / 400 AS score", "cast(id % 2 AS int) AS truth", "1 AS called", "1 AS n")
    plan = R.replicate_values(rows, ["k"], "brier", 4, lambda ids: R.row_draws(ids, 42, 4))._jdf.queryExecution().toString()
    assert "REPARTITION_BY_NUM" in plan and ", 8)" in plan


def test_interval_holds_the_point(scored):
    _, df = scored
    r = I.row_bootstrap(df, ["k"], "brier", 60, ["row_id"])
    assert all(x.ci_lower <= x.point <= x.ci_upper for x in r.collect())


def exact_wilcoxon(d):
    r = pd.Series(np.abs(d)).rank().to_numpy()
    w = min(r[d > 0].sum(), r[d < 0].sum())
    sums = [sum(x for x, s in zip(r, signs) if s) for signs in itertools.product([0, 1], repeat=len(d))]
    return w, min(1.0, 2 * np.mean([s <= w for s in sums]))


def test_paired_tests(spark):
    a = [0.90, 0.85, 0.7, 0.66, 0.91, 0.3]
    b = [0.80, 0.88, 0.51, 0.62, 0.76, 0.31]
    rows = [("x", i, u, v) for i, (u, v) in enumerate(zip(a, b))] + [("same", i, 0.5, 0.5) for i in range(3)] + [("one", 0, 0.5, 0.4)]
    rows += [("shift", i, u + 0.125, u) for i, u in enumerate((0.5, 0.25, 0.75))]
    r = {x.k: x for x in I.paired_tests(spark.createDataFrame(rows, "k string, s int, a double, b double"), ["k"]).collect()}
    d = np.array(a) - np.array(b)
    t = d.mean() / (d.std(ddof=1) / np.sqrt(6))
    w, p = exact_wilcoxon(d)
    assert r["x"].t_stat == pytest.approx(t) and r["x"].t_p == pytest.approx(t_two_sided(t, 5))
    assert r["x"].w_stat == w and r["x"].w_p == pytest.approx(p)
    assert r["same"].t_stat is None and r["same"].note == "no difference"
    assert r["one"].w_p is None and r["one"].note == "fewer than 2 pairs"
    assert r["shift"].t_p == 0 and r["shift"].wins == 3  # a constant shift is a valid difference


@pytest.mark.parametrize("t, df, p", [(2.7764451051977987, 4, 0.05), (12.706204736432095, 1, 0.05), (0.0, 7, 1.0), (3.169272667175838, 10, 0.01)])
def test_t_tail(t, df, p):
    assert t_two_sided(t, df) == pytest.approx(p, abs=1e-9)


def test_seed_guard(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "model string, seed int")
    with pytest.raises(ValueError):
        I.require_same_seeds(rows)


def test_null_keys_form_a_group(scored):
    from occgraph.operators.splits import hash_rank
    from occgraph.operators.table import groups_of_size

    pdf, df = scored
    nulls = df.withColumn("k", F.when(F.col("k") != "a", F.col("k")))
    want = M.rank_metrics(df, ["k"]).filter("k = 'a'").first()["roc_auc"]
    assert M.all_metrics(nulls, ["k"]).filter("k IS NULL").first()["roc_auc"] == pytest.approx(want)
    assert hash_rank(nulls, ["k"], F.md5(F.col("row_id").cast("string"))).count() == len(pdf)
    assert groups_of_size(nulls, ["k"], 1).count() == len(pdf)
