"""Tabular baselines beside the graph sweep: selected columns, a single model's score, and a classifier on both."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occgraph.operators.boosting import LEAF_WISE, BoostConfig, boosted_out_of_fold
from occgraph.operators.models import predict
from occgraph.operators.prep import FeaturePrep
from occgraph.session import materialize, owned_copies


def baseline_vectors(vectors: DataFrame, names: list[str], config: BoostConfig = LEAF_WISE, top: int = 10, n_folds: int = 5, seed: int = 42) -> tuple[DataFrame, list[str]]:
    """``(row_id, role, label, features)`` and the selected columns.

    ``features`` are the ``top`` columns by gain, least first, and the score of one
    boosted model: out of fold for train rows, by the model of all train rows
    for the others. That model ranks the columns too, so scores and ranking take
    one fit, and no val or test row has a part in either.
    """
    data = vectors.select("row_id", "role", "label", "features")
    scores, fit = boosted_out_of_fold(data, config, n_folds, seed)
    gains = fit.importance(names, model=len(fit.trees) - 1)
    best = sorted(range(len(names)), key=lambda i: (-gains[names[i]], names[i]))[:top]
    selected = [names[i] for i in reversed(best)]
    x = vector_to_array("features")
    picked = [F.element_at(x, names.index(c) + 1) for c in selected]
    joined = data.join(scores.select("row_id", "score"), "row_id")
    return joined.select("row_id", "role", "label", array_to_vector(F.array(*picked, F.col("score"))).alias("features")), selected


def baseline_sweep(
    records: DataFrame, splits: DataFrame, cases: list[tuple[int, str]], builders: dict[str, Callable[[int], Estimator]], config: BoostConfig = LEAF_WISE,
    top: int = 10, n_folds: int = 5, exp: str = "loro",
) -> DataFrame:
    """Test predictions of each classifier over ``(seed, fold)`` cases, in the long prediction layout.

    A case's vectors are made once for all classifiers; its copies are deleted when its predictions are written.
    """
    parts = []
    for seed, fold in cases:
        roles = splits.filter((F.col("seed") == seed) & (F.col("fold") == fold)).select("row_id", "role")
        with owned_copies(records.sparkSession, "baseline"):
            data = materialize(records.join(roles, "row_id"))
            prep = FeaturePrep().fit(data.filter("role = 'train'"))
            made, _ = baseline_vectors(materialize(prep.transform(data, keep=["role", "label"])), prep.names(), config, top, n_folds, seed)
            made = materialize(made.withColumn("label", F.col("label").cast("double")))
            for name, build in builders.items():
                scored = predict(build(seed).fit(made.filter("role = 'train'")), made.filter("role = 'test'"), "y_prob")
                parts.append(materialize(scored.select(
                    F.lit(exp).alias("exp"), F.lit(name).alias("model"), F.lit(seed).alias("seed"), F.lit(fold).alias("region"), "row_id",
                    F.col("label").cast("int").alias("y_true"), "y_prob", (F.col("y_prob") >= 0.5).cast("int").alias("y_pred")), "predictions"))
    return reduce(lambda a, b: a.unionByName(b), parts)
