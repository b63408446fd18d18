"""Evaluation metrics as grouped aggregates over a long prediction table.

``preds`` has ``y_true`` (0/1), ``y_prob``, ``y_pred`` and any key columns; an
optional weight column turns every metric into its weighted form. Undefined
values are NULL and are skipped by averages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occgraph.operators.ranking import join_on_keys, running_totals

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_metrics(preds: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1, zero where a denominator is zero."""
    w = F.col(weight) if weight else F.lit(1)
    cell = lambda y, p: F.sum(F.when((F.col("y_true") == y) & (F.col("y_pred") == p), w).otherwise(0))
    c = preds.groupBy(*keys).agg(
        cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn")
    )
    tp, tn, fp, fn = (F.col(x) for x in ("tp", "tn", "fp", "fn"))
    return c.select(
        *keys, (tp + tn + fp + fn).alias("n"), _share(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _share(tp, tp + fp).alias("precision"), _share(tp, tp + fn).alias("recall"), _share(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def score_counts(preds: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score: the input of rank metrics."""
    w = F.col(weight) if weight else F.lit(1)
    return preds.groupBy(*keys, "y_prob").agg(
        F.sum(w * F.col("y_true")).alias("pos"), F.sum(w * (1 - F.col("y_true"))).alias("neg")
    )


def rank_metrics_from_counts(counts: DataFrame, keys: list[str], edges_from: DataFrame | None = None) -> DataFrame:
    """ROC-AUC with ties and average precision, NULL when one class is absent.

    AUC is the rank statistic; average precision is the step sum over distinct
    thresholds, not a trapezoid.
    """
    if not keys:
        return rank_metrics_from_counts(counts.withColumn("all_rows", F.lit(0)), ["all_rows"]).drop("all_rows")
    r = running_totals(counts, keys, "y_prob", ["pos", "neg"], edges_from)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    pos_above = F.col("pos_total") - F.col("pos_below")  # at or above this score
    all_above = pos_above + F.col("neg_total") - F.col("neg_below")
    s = r.groupBy(*keys).agg(
        F.max("pos_total").alias("n_pos"), F.max("neg_total").alias("n_neg"),
        F.sum(pos * (F.col("neg_below") + neg / 2)).alias("wins"),
        F.sum(pos * F.try_divide(pos_above.cast("double"), all_above.cast("double"))).alias("steps"),
    )
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    return s.select(
        *keys, "n_pos", "n_neg",
        F.when(both, F.col("wins") / (F.col("n_pos").cast("double") * F.col("n_neg"))).alias("roc_auc"),
        F.when(both, F.col("steps") / F.col("n_pos")).alias("pr_auc"),
    )


def rank_metrics(preds: DataFrame, keys: list[str], weight: str | None = None) -> DataFrame:
    return rank_metrics_from_counts(score_counts(preds, keys, weight), keys)


def all_metrics(preds: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with every metric."""
    ranks = rank_metrics(preds, keys).select(*keys, "n_pos", "n_neg", "roc_auc", "pr_auc")
    return join_on_keys(classification_metrics(preds, keys), ranks, keys)


def metric_rows(metrics: DataFrame, keys: list[str], names: tuple[str, ...] = METRICS) -> DataFrame:
    """Long form: ``(*keys, metric, value)``."""
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])
    return metrics.select(*keys, F.explode(pairs).alias("m")).select(*keys, "m.*")


def repair_single_class(metrics: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Stored results with AUCs cleared on one-class folds, and the folds affected."""
    single = (F.col("n_pos") == 0) | (F.col("n_neg") == 0)
    fixed = metrics.withColumns({m: F.when(~single, F.col(m)) for m in ("roc_auc", "pr_auc")})
    return fixed, metrics.filter(single).select(*keys, "n_pos", "n_neg")


def average_over(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of ``value`` per key; NULLs are skipped, all-NULL stays NULL."""
    return rows.groupBy(*keys).agg(F.avg("value").alias("value"))


def mean_and_std(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation per key, 0 deviation for a single value."""
    return rows.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_pop("value"), F.lit(0.0)).alias("std"), F.count("value").alias("n")
    )


def brier(preds: DataFrame, keys: list[str]) -> DataFrame:
    d = F.col("y_prob") - F.col("y_true")
    return preds.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(d * d).alias("brier"))


def reliability_bins(preds: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Equal bins, closed below, the last closed above; empty bins are absent."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    number = sum(((F.col("y_prob") >= F.lit(e)).cast("int") for e in edges), F.lit(0))
    return preds.groupBy(*keys, number.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("y_prob").alias("mean_predicted"), F.avg(F.col("y_true").cast("double")).alias("observed_rate")
    )


def proportions(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Estimated and true positive share per group, and the absolute error."""
    p = preds.groupBy(*keys).agg(
        F.avg("y_prob").alias("predicted"), F.avg(F.col("y_true").cast("double")).alias("actual"), F.count("*").alias("n")
    )
    return p.withColumn("abs_error", F.abs(F.col("predicted") - F.col("actual")))


def proportion_errors(props: DataFrame, keys: list[str]) -> DataFrame:
    return props.groupBy(*keys).agg(
        F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("abs_error") * F.col("abs_error"))).alias("rmse"), F.count("abs_error").alias("n_regions")
    )


def best_per_key(rows: DataFrame, keys: list[str], name: str, value: str, higher: bool, skip: list[str] = ()) -> DataFrame:
    """The winning name per key by metric direction, ties by name."""
    v = F.col(value) if higher else -F.col(value)
    kept = rows.filter(F.col(value).isNotNull() & ~F.col(name).isin(list(skip)))
    return kept.groupBy(*keys).agg(
        F.min_by(F.struct(name, value), F.struct((-v).alias("v"), F.col(name).alias("t"))).alias("best")
    ).select(*keys, F.col(f"best.{name}").alias(f"best_{name}"), F.col(f"best.{value}").alias(f"best_{value}"))


def compare_results(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer comparison of ``value``; the difference only where both exist."""
    a = old.select(*keys, F.col("value").alias("old_value"))
    b = new.select(*keys, F.col("value").alias("new_value"))
    return a.join(b, keys, "full_outer").withColumn("delta", F.col("new_value") - F.col("old_value"))


def worst_region(rows: DataFrame, keys: list[str], region: str = "region") -> DataFrame:
    """Mean per region over runs, then mean, deviation and worst region per key."""
    means = rows.groupBy(*keys, region).agg(F.avg("value").alias("value")).filter(F.col("value").isNotNull())
    return means.groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std_between"),
        F.min_by(region, F.struct("value", region)).alias("worst"), F.min("value").alias("worst_value"),
    )


def paired_regions(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Mean value of two models per key and their difference where both exist."""
    mean = lambda m: rows.filter(F.col("model") == m).groupBy(*keys).agg(
        F.avg("value").alias(f"value_{m}"), F.count("value").alias(f"n_{m}"))
    return mean(a).join(mean(b), keys, "left").withColumn("difference", F.col(f"value_{a}") - F.col(f"value_{b}"))


def best_trials(trials: DataFrame, keys: list[str], value: str, tolerance: float = 1e-8) -> DataFrame:
    """Every trial at the maximum of its key, ties within tolerance."""
    top = trials.groupBy(*keys).agg(F.max(value).alias("top")) if keys else trials.agg(F.max(value).alias("top"))
    joined = trials.join(top, keys) if keys else trials.join(F.broadcast(top))
    return joined.filter(F.abs(F.col(value) - F.col("top")) <= tolerance + 1e-5 * F.abs("top")).drop("top")


def trial_surface(trials: DataFrame, rows: str, columns: str, value: str, levels: list) -> DataFrame:
    """Best value per (rows, columns) cell as a pivot table."""
    return trials.groupBy(rows).pivot(columns, levels).agg(F.max(value))


def with_fallback(main: DataFrame, backup: DataFrame, keys: list[str]) -> DataFrame:
    """``value`` from ``main``, or from ``backup`` where main has none."""
    b = backup.select(*keys, F.col("value").alias("backup_value"))
    return main.join(b, keys, "left").withColumn("value", F.coalesce("value", "backup_value")).drop("backup_value")
