"""Tabular models, out-of-fold scoring, feature ranking and grid search on Spark ML."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from occgraph.functions.hashing import hash_order
from occgraph.operators.metrics import all_metrics
from occgraph.operators.splits import hash_rank, stratified_folds
from occgraph.session import materialize, small_values

Factory = Callable[[int], list[Estimator]]
SCORING = ("oof", "in_sample", "none")


# --- model configurations ---------------------------------------------------

def boosted(seed: int, iterations: int = 300, depth: int = 6) -> GBTClassifier:
    return GBTClassifier(labelCol="label", maxIter=iterations, maxDepth=depth, stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)


def forest(seed: int, trees: int = 300, depth: int = 20) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)


def perceptron(seed: int, inputs: int, hidden: tuple[int, ...] = (128, 64)) -> Pipeline:
    return Pipeline(stages=[
        StandardScaler(withMean=True, inputCol="features", outputCol="scaled"),
        MultilayerPerceptronClassifier(labelCol="label", featuresCol="scaled", layers=[inputs, *hidden, 2], seed=seed, maxIter=100),
    ])


def latent_logistic(latent: int = 32) -> Pipeline:
    """Linear encoder to a latent space, then logistic regression."""
    return Pipeline(stages=[
        StandardScaler(withMean=True, inputCol="features", outputCol="scaled"),
        PCA(k=latent, inputCol="scaled", outputCol="latent"),
        LogisticRegression(labelCol="label", featuresCol="latent"),
    ])


def ensemble(seed: int) -> list[Estimator]:
    """Two boosted configurations and a forest."""
    return [boosted(seed), boosted(seed + 1), forest(seed)]


def single_boosted(seed: int) -> list[Estimator]:
    return [boosted(seed)]


class KernelSVM:
    """RBF support-vector classifier on random Fourier features.

    The kernel is approximated by cosines of random projections, a linear SVM
    is fitted on them, and its margin is calibrated by a one-input logistic.
    """

    def __init__(self, seed: int = 42, components: int = 128, gamma: float | None = None, balanced: bool = True):
        self.seed, self.components, self.gamma, self.balanced = seed, components, gamma, balanced

    def fit(self, df: DataFrame) -> KernelSVM:
        self.scaler = StandardScaler(withMean=True, inputCol="features", outputCol="scaled").fit(df)
        width = len(df.first()["features"])
        rng = np.random.default_rng(self.seed)
        gamma = self.gamma or 1.0 / width  # scaled inputs have unit variance
        self.weights = rng.normal(0, np.sqrt(2 * gamma), (width, self.components))
        self.shift = rng.uniform(0, 2 * np.pi, self.components)
        mapped = materialize(self._map(df))
        if self.balanced:
            n, n_pos = mapped.agg(F.count("*"), F.sum("label")).first()
            w = F.when(F.col("label") == 1, n / (2.0 * max(n_pos, 1))).otherwise(n / (2.0 * max(n - n_pos, 1)))
        else:
            w = F.lit(1.0)
        mapped = mapped.withColumn("w", w)
        self.svm = LinearSVC(labelCol="label", featuresCol="mapped", weightCol="w", rawPredictionCol="margin").fit(mapped)
        margin = self._margin(self.svm.transform(mapped))
        self.calibration = LogisticRegression(labelCol="label", featuresCol="margin_v").fit(margin)
        return self

    def _map(self, df: DataFrame) -> DataFrame:
        weights, shift = self.weights, self.shift

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def fourier(x: pd.Series) -> pd.Series:
            z = np.cos(np.stack(x.to_numpy()) @ weights + shift) * np.sqrt(2.0 / len(shift)) if len(x) else np.empty((0, len(shift)))
            return pd.Series(list(z))

        return self.scaler.transform(df).withColumn("mapped", array_to_vector(fourier(vector_to_array("scaled")))).drop("scaled")

    @staticmethod
    def _margin(df: DataFrame) -> DataFrame:
        return df.withColumn("margin_v", array_to_vector(F.array(F.element_at(vector_to_array("margin"), 2)))).drop("prediction", "margin")

    def transform(self, df: DataFrame) -> DataFrame:
        return self.calibration.transform(self._margin(self.svm.transform(self._map(df)))).drop("mapped", "margin_v", "rawPrediction", "prediction")


def predict(model: Model | Transformer, df: DataFrame, name: str = "score") -> DataFrame:
    """Add the class-1 probability and drop the model's other columns."""
    scored = model.transform(df).withColumn(name, F.element_at(vector_to_array("probability"), 2))
    return scored.select(*df.columns, name)


def ensemble_score(models: list, df: DataFrame, name: str = "score") -> DataFrame:
    """Mean class-1 probability over the members."""
    for i, m in enumerate(models):
        df = predict(m, df, f"member_{i}")
    members = [f"member_{i}" for i in range(len(models))]
    return df.withColumn(name, reduce(lambda a, b: a + b, [F.col(c) for c in members]) / len(members)).drop(*members)


# --- leakage-free scores ----------------------------------------------------

def leakage_free_scores(data: DataFrame, *, factory: Factory = ensemble, n_folds: int = 5, seed: int = 42, scoring: str = "oof") -> tuple[DataFrame, list]:
    """``(row_id, role, score)`` and the models refitted on all train rows.

    ``data`` has ``row_id, role, label, features``. Train rows are scored out
    of fold, other rows by the refit. Folds are capped to the minority count;
    with fewer than two minority rows train rows are scored in sample.
    """
    if scoring not in SCORING:
        raise ValueError(f"scoring must be one of {SCORING}, got {scoring!r}")
    data = data.select("row_id", "role", F.col("label").cast("double").alias("label"), "features")
    train, other = data.filter("role = 'train'"), data.filter("role <> 'train'")
    refit = [e.fit(train) for e in factory(seed)]
    parts = [ensemble_score(refit, other).select("row_id", "role", "score")]
    if scoring == "oof":
        folds = materialize(stratified_folds(train, [], "label", n_folds, seed))
        n = folds.agg(F.max("fold_no")).first()[0]
        if n is None:
            scoring = "in_sample"
        for i in range(0 if n is None else n + 1):
            models = [e.fit(folds.filter(F.col("fold_no") != i)) for e in factory(seed)]
            parts.append(ensemble_score(models, folds.filter(F.col("fold_no") == i).drop("fold_no")).select("row_id", "role", "score"))
    if scoring == "in_sample":
        parts.append(ensemble_score(refit, train).select("row_id", "role", "score"))
    return reduce(lambda a, b: a.unionByName(b), parts), refit


def grid_search(data: DataFrame, grid: list[dict], build: Callable[[dict], Estimator]) -> tuple[dict, object, DataFrame]:
    """Best setting by F1 on the fixed val rows, the first one on ties.

    Returns the setting, its model and the trial table: one typed column a
    parameter and every metric on the val rows.
    """
    train, val = data.filter("role = 'train'"), data.filter("role = 'val'")
    rows, best = [], None
    for i, setting in enumerate(grid):
        model = build(setting).fit(train)
        scored = predict(model, val, "y_prob").select(
            F.col("label").cast("int").alias("y_true"), "y_prob", (F.col("y_prob") >= 0.5).cast("int").alias("y_pred"))
        table = all_metrics(scored.withColumn("trial", F.lit(i)), ["trial"]).withColumns({c: F.lit(v) for c, v in setting.items()})
        measured = table.first()
        rows.append(measured)
        schema = table.schema
        if best is None or measured["f1"] > best[0]:
            best = (measured["f1"], setting, model)
    trials = data.sparkSession.createDataFrame([tuple(r) for r in rows], schema)
    names = [c for c in trials.columns if c != "trial" and c not in grid[0]]
    return best[1], best[2], trials.withColumnsRenamed({c: f"val_{c}" for c in names})


# --- feature ranking --------------------------------------------------------

def tree_importance(model, names: list[str], top: int = 10) -> list[str]:
    """The most important features of a fitted tree model, ascending."""
    weights = model.featureImportances.toArray()
    order = sorted(range(len(names)), key=lambda i: (-weights[i], names[i]))[:top]
    return [names[i] for i in reversed(order)]


def permutation_importance(model, data: DataFrame, names: list[str], seed: int = 42) -> DataFrame:
    """Mean absolute change of the score when one feature is shuffled.

    All features are shuffled and scored in one job: each row meets the value
    of the row at its hash rank, per feature.
    """
    spark = data.sparkSession
    base = materialize(predict(model, data.select("row_id", "features"), "base").withColumn("x", vector_to_array("features")))
    cells = base.select("row_id", F.posexplode("x").alias("j", "v"))
    own = hash_rank(cells.select("row_id", "j"), ["j"], hash_order(F.lit("own"), F.lit(seed), F.col("row_id"), F.col("j"))).select("row_id", "j", "place")
    donor = hash_rank(cells, ["j"], hash_order(F.lit("donor"), F.lit(seed), F.col("row_id"), F.col("j"))).select("j", "v", "place")
    swapped = own.join(donor, ["j", "place"]).join(base, "row_id").withColumn(
        "features", array_to_vector(F.transform("x", lambda x, i: F.when(i == F.col("j"), F.col("v")).otherwise(x))))
    change = predict(model, swapped.select("j", "base", "features"), "moved").groupBy("j").agg(F.avg(F.abs(F.col("moved") - F.col("base"))).alias("importance"))
    labels = spark.createDataFrame(list(enumerate(names)), "j int, feature string")
    return change.join(F.broadcast(labels), "j").select("feature", "importance")  # one row per feature


def linear_contributions(data: DataFrame, coefficients: dict[str, float], groups: list[str], top: int = 10) -> DataFrame:
    """Mean absolute contribution |coef * (x - mean)| per feature within each
    0/1 flag group, the ``top`` features of each."""
    names = list(coefficients)
    means = data.agg(*[F.avg(c).alias(c) for c in names]).first()  # one row
    parts = F.array(*[
        F.struct(F.lit(c), F.abs(F.lit(float(coefficients[c])) * (F.col(c) - F.lit(means[c])))).cast("struct<feature:string,c:double>")
        for c in names
    ])
    member = F.array_compact(F.array(*[F.when(F.col(g) == 1, F.lit(g)) for g in groups]))
    long = data.select(F.explode(member).alias("grp"), parts.alias("parts")).select("grp", F.explode("parts").alias("p")).select("grp", "p.*")
    mean = long.groupBy("grp", "feature").agg(F.avg("c").alias("contribution"))
    order = W.partitionBy("grp").orderBy(F.desc(F.round("contribution", 9)), "feature")  # one row per feature
    return mean.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= top)


def selection_stability(selections: DataFrame) -> DataFrame:
    """Folds per selected feature, union size and always-selected count."""
    n = selections.agg(F.count_distinct("fold").alias("n_folds"))
    counts = selections.groupBy("feature").agg(F.count_distinct("fold").alias("n_selected")).join(F.broadcast(n))
    whole = counts.agg(F.count("*").alias("n_union"), F.count_if(F.col("n_selected") == F.col("n_folds")).alias("n_always"))
    return counts.join(F.broadcast(whole))  # one row


# --- probes and comparisons -------------------------------------------------

def eligible_folds(rows: DataFrame, keys: list[str], min_train: int = 30) -> DataFrame:
    """Per key whether a fit is possible, and the reason when it is not."""
    train = F.col("role") != "test"
    c = rows.groupBy(*keys).agg(
        F.count_if(train).alias("n_train"), F.count_if(~train).alias("n_test"),
        F.count_distinct(F.when(train, F.col("label"))).alias("train_classes"), F.count_distinct(F.when(~train, F.col("label"))).alias("test_classes"))
    reason = (
        F.when(F.col("n_test") == 0, "no test rows").when(F.col("n_train") < min_train, "too few train rows")
        .when(F.col("train_classes") < 2, "single class in train").when(F.col("test_classes") < 2, "single class in test")
    )
    return c.withColumn("reason", reason)


def assemble(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="features").transform(df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])).select(*keep, "features")


def cross_validated_probe(data: DataFrame, build: Callable[[int], Estimator], n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Metrics per fold of a stratified cross-validation on ``label, features``."""
    folds = materialize(stratified_folds(data, [], "label", n_folds, seed))
    parts = []
    for i in range((folds.agg(F.max("fold_no")).first()[0] or -1) + 1):
        model = build(seed).fit(folds.filter(F.col("fold_no") != i))
        parts.append(predict(model, folds.filter(F.col("fold_no") == i), "y_prob"))
    scored = reduce(lambda a, b: a.unionByName(b), parts).select("fold_no", F.col("label").cast("int").alias("y_true"), "y_prob", (F.col("y_prob") >= 0.5).cast("int").alias("y_pred"))
    return all_metrics(scored, ["fold_no"])


def leave_out_probe(data: DataFrame, fold: str, build: Callable[[int], Estimator], seed: int = 42) -> DataFrame:
    """Each fold value's rows predicted by a model fitted on all other rows.

    One fit per fold value, however many runs reuse the fold.
    """
    parts = [predict(build(seed).fit(data.filter(~F.col(fold).eqNullSafe(v))), data.filter(F.col(fold) == v), "y_prob") for v in small_values(data, fold)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def probe_targets(flags: DataFrame, names: list[str], label_like: list[str], top: int = 5, at_least: int = 20) -> list[str]:
    """The ``top`` most frequent flags that aren't close to the label, as far as ``at_least`` rows have them."""
    others = [c for c in names if c not in label_like]
    counts = flags.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in others]).first()
    ranked = sorted(others, key=lambda c: (-(counts[c] or 0), others.index(c)))[:top]
    return [c for c in ranked if (counts[c] or 0) >= at_least]


def specificity_probe(data: DataFrame, targets: list[str], build: Callable[[int], Estimator], n_folds: int = 5, seed: int = 42) -> DataFrame:
    """The cross-validated probe of ``features`` for other targets: is what it finds particular to the label?"""
    parts = [cross_validated_probe(data.select("row_id", F.col(t).cast("double").alias("label"), "features"), build, n_folds, seed).withColumn("target", F.lit(t)) for t in targets]
    return reduce(lambda a, b: a.unionByName(b), parts)


def pooled_or_by_group(data: DataFrame, group: str, build: Callable[[int], Estimator], seed: int = 42, min_train: int = 30) -> tuple[DataFrame, DataFrame]:
    """Test predictions of one pooled model and of one model per eligible group,
    and the groups skipped with their reason."""
    data = materialize(data)
    small_values(data, group)  # raises on too many groups
    status = eligible_folds(data, [group], min_train).collect()  # one row per group
    skipped = data.sparkSession.createDataFrame([(r[group], r["reason"]) for r in status if r["reason"]], f"`{group}` string, reason string")
    train, test = data.filter("role <> 'test'"), data.filter("role = 'test'")
    parts = [predict(build(seed).fit(train), test, "y_prob").withColumn("model", F.lit("pooled"))]
    for r in status:
        if r["reason"] is None:
            mine = F.col(group) == r[group]
            parts.append(predict(build(seed).fit(train.filter(mine)), test.filter(mine), "y_prob").withColumn("model", F.lit("by_group")))
    return reduce(lambda a, b: a.unionByName(b), parts), skipped


