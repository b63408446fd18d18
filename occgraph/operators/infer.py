"""Resampling intervals, paired tests and correlations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from occgraph.functions.hashing import hash_uniform
from occgraph.functions.stats import normal_tail, t_tail
from occgraph.operators.metrics import brier, classification_metrics, rank_metrics_from_counts, score_counts
from occgraph.operators.ranking import average_ranks
from occgraph.operators.replicates import cluster_blocks, replicate_values, row_draws
from occgraph.session import materialize

METRIC_NAMES = ("roc_auc", "pr_auc", "brier", "f1")
MIN_VALID = 100
EXACT_PAIRS = 50


def _interval(replicates: DataFrame, keys: list[str], metric: str, min_valid: int = 1) -> DataFrame:
    """2.5 and 97.5 percentiles over the replicates of each key (one row each)."""
    enough = F.count(metric) >= min_valid
    edge = lambda p: F.when(enough, F.percentile(metric, p))
    return replicates.groupBy(*keys).agg(edge(0.025).alias("ci_lower"), edge(0.975).alias("ci_upper"), F.count(metric).alias("n_valid"))


def _weighted_metric(rows: DataFrame, keys: list[str], metric: str, edges_from: DataFrame | None) -> DataFrame:
    """``metric`` per key of rows carrying an integer weight ``w``."""
    if metric in ("roc_auc", "pr_auc"):
        return rank_metrics_from_counts(score_counts(rows, keys, "w"), keys, edges_from).select(*keys, metric)
    if metric == "f1":
        return classification_metrics(rows, keys, "w").select(*keys, "f1")
    d = F.col("y_prob") - F.col("y_true")
    return rows.groupBy(*keys).agg((F.sum(F.col("w") * d * d) / F.sum("w")).alias("brier"))


def point_metric(preds: DataFrame, keys: list[str], metric: str) -> DataFrame:
    if metric not in METRIC_NAMES:
        raise ValueError(f"metric must be one of {METRIC_NAMES}, got {metric!r}")
    if metric == "brier":
        return brier(preds, keys).select(*keys, "brier")
    return _weighted_metric(preds.withColumn("w", F.lit(1)), keys, metric, None)


def row_bootstrap(preds: DataFrame, keys: list[str], metric: str, replicates: int, id_cols: list[str], seed: int = 42) -> DataFrame:
    """Interval from Poisson(1) row weights, one independent draw per replicate and row.

    A row's draws are made where the row is, as one array; arrays are added up
    (``replicates``), and no row is written out per replicate.
    """
    point = point_metric(preds, keys, metric).withColumnRenamed(metric, "point")
    rows = _replicate_rows(preds, keys, F.concat_ws("|", *id_cols)).withColumn("n", F.lit(1))
    values = replicate_values(rows, keys, metric, replicates, lambda ids: row_draws(ids, seed, replicates))
    return point.join(_interval(values, keys, metric), keys, "left")


def _replicate_rows(preds: DataFrame, keys: list[str], name: Column) -> DataFrame:
    called = F.col("y_pred").cast("int") if "y_pred" in preds.columns else F.lit(None).cast("int")
    return preds.select(*keys, F.col("y_prob").cast("double").alias("score"), F.col("y_true").cast("int").alias("truth"), called.alias("called"), name.alias("id"))


def cluster_draws(clusters: DataFrame, cluster: str, replicates: int, seed: int = 42) -> DataFrame:
    """``(rep, <cluster>, w)``: how often each cluster is drawn in a replicate.

    As many draws as clusters, with replacement; every model uses the same draws.
    """
    numbered = clusters.select(cluster).distinct().withColumn("no", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(cluster)) - 1)
    size = F.broadcast(numbered.agg(F.count("*").alias("size")))  # one row
    slots = numbered.join(size).select(
        F.col("no").alias("slot"), "size", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    pick = F.floor(hash_uniform(F.lit("draw"), F.lit(seed), F.col("rep"), F.col("slot")) * F.col("size"))
    counts = slots.groupBy("rep", pick.alias("no")).agg(F.count("*").alias("w"))
    return counts.join(numbered, "no").select("rep", cluster, "w")


def cluster_replicates(preds: DataFrame, draws: DataFrame, metric: str, replicates: int, model: str = "model", cluster: str = "region") -> DataFrame:
    """``(model, rep, <metric>)`` with whole clusters resampled, for any number of clusters."""
    rows = _replicate_rows(preds, [model], F.col(cluster))
    equal = materialize(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")).filter("id IS NOT NULL"))
    parts = [replicate_values(equal, [model], metric, n, weights, first) for first, n, weights in cluster_blocks(draws, cluster, replicates)]
    return reduce(lambda a, b: a.unionByName(b), parts)


def cluster_bootstrap(preds: DataFrame, metric: str, replicates: int, *, model: str = "model", cluster: str = "region", seed: int = 42, min_valid: int = MIN_VALID) -> DataFrame:
    """Point and interval per model; no interval with too few valid replicates."""
    draws = materialize(cluster_draws(preds, cluster, replicates, seed))
    values = cluster_replicates(preds, draws, metric, replicates, model, cluster)
    point = point_metric(preds, [model], metric).withColumnRenamed(metric, "point")
    sizes = preds.groupBy(model).agg(F.count("*").alias("n_pred"), F.count_distinct(cluster).alias("n_clusters"))
    return point.join(_interval(values, [model], metric, min_valid), model).join(sizes, model)


def paired_cluster_difference(preds: DataFrame, a: str, b: str, metric: str, replicates: int, *, model: str = "model", cluster: str = "region", seed: int = 42, min_valid: int = MIN_VALID) -> DataFrame:
    """Interval of metric(a) - metric(b) on the same draws."""
    pair = preds.filter(F.col(model).isin(a, b))
    draws = materialize(cluster_draws(preds, cluster, replicates, seed))
    values = materialize(cluster_replicates(pair, draws, metric, replicates, model, cluster))
    side = lambda df, m, n, *k: df.filter(F.col(model) == m).select(*k, F.col(metric).alias(n))
    diffs = side(values, a, "va", "rep").join(side(values, b, "vb", "rep"), "rep").withColumn("diff", F.col("va") - F.col("vb"))
    points = point_metric(pair, [model], metric)
    both = side(points, a, "point_a").join(F.broadcast(side(points, b, "point_b")))  # one row each
    ends = diffs.agg(F.percentile("diff", 0.025).alias("ci_lower"), F.percentile("diff", 0.975).alias("ci_upper"), F.count("diff").alias("n_valid"))
    return both.join(F.broadcast(ends)).filter(F.col("n_valid") >= min_valid).select(
        F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), "point_a", "point_b", (F.col("point_a") - F.col("point_b")).alias("diff"),
        "ci_lower", "ci_upper", ((F.col("ci_lower") > 0) | (F.col("ci_upper") < 0)).alias("excludes_zero"), "n_valid")


def require_same_seeds(rows: DataFrame, source: str = "model", seed: str = "seed") -> None:
    """Raise when the sources were not run on the same seeds."""
    sets = rows.groupBy(source).agg(F.array_sort(F.collect_set(seed)).alias("seeds"))
    if sets.select("seeds").distinct().count() > 1:
        raise ValueError("the sources cover different seeds")


def pair_results(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, a, b)`` where both sides hold a value."""
    return a.select(*keys, F.col("value").alias("a")).join(b.select(*keys, F.col("value").alias("b")), keys).dropna(subset=["a", "b"])


# --- paired tests -----------------------------------------------------------

def _exact_tail(n: Column, w: Column) -> Column:
    """Chance that the smaller signed-rank sum is at most ``w``, both sides.

    Counts rank subsets by their sum, one rank at a time.
    """
    top = n * (n + 1) / 2
    sums = F.sequence(F.lit(0).cast("long"), top.cast("long"))
    start = F.transform(sums, lambda j: F.when(j == 0, 1.0).otherwise(0.0))

    def add_rank(ways: Column, r: Column) -> Column:
        return F.transform(sums, lambda j: F.get(ways, j.cast("int")) + F.coalesce(F.when(j >= r, F.get(ways, (j - r).cast("int"))), F.lit(0.0)))

    ways = F.aggregate(F.sequence(F.lit(1).cast("long"), n.cast("long")), start, add_rank)
    below = F.aggregate(F.slice(ways, 1, (w + 1).cast("int")), F.lit(0.0), lambda s, x: s + x)
    return F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n))


def paired_tests(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Paired t and Wilcoxon signed-rank tests of ``a`` against ``b`` per key.

    NULL with a note for fewer than two pairs or no difference at all. The
    signed-rank p-value is exact without ties or zeros, else normal.
    """
    by = keys or ["all_rows"]
    d = (pairs if keys else pairs.withColumn("all_rows", F.lit(0))).withColumn("d", F.col("a") - F.col("b"))
    same = F.max(F.abs("d")) <= 1e-8
    basic = d.groupBy(*by).agg(
        F.count("*").alias("n_pairs"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("mean_diff"),
        F.count_if(F.col("d") > 0).alias("wins"), F.stddev_samp("d").alias("sd"), same.alias("identical"),
        F.count_if(F.col("d") == 0).alias("zeros"),
    )
    moved = d.filter("d <> 0").withColumn("size", F.abs("d"))
    ranks = average_ranks(moved, by, "size", "place")
    ties = moved.groupBy(*by, "size").agg(F.count("*").alias("t")).groupBy(*by).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("tie_sum"))
    signed = ranks.groupBy(*by).agg(
        F.count("*").alias("nr"), F.sum(F.when(F.col("d") > 0, F.col("place")).otherwise(0.0)).alias("w_plus"),
        F.sum(F.when(F.col("d") < 0, F.col("place")).otherwise(0.0)).alias("w_minus"),
    ).join(ties, by)
    j = basic.join(signed, by, "left")
    usable = (F.col("n_pairs") >= 2) & ~F.col("identical")
    n, w = F.col("nr"), F.least("w_plus", "w_minus")
    t_stat = F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("n_pairs"))).otherwise(F.signum("mean_diff") * F.lit(float("inf")))
    exact = (n <= EXACT_PAIRS) & (F.col("tie_sum") == 0) & (F.col("zeros") == 0)
    z = (w - n * (n + 1) / 4) / F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("tie_sum") / 2) / 24)
    out = j.select(
        *by, "n_pairs", "mean_a", "mean_b", "mean_diff", "wins", F.when(usable, t_stat).alias("t_stat"), F.when(usable, w).alias("w_stat"),
        F.when(usable & exact, _exact_tail(n, w)).alias("w_exact"), F.when(usable & ~exact, z).alias("z"),
        F.when(F.col("n_pairs") < 2, "fewer than 2 pairs").when(F.col("identical"), "no difference").alias("note"),
    )
    done = out.withColumn("t_p", t_tail(F.col("t_stat"), F.col("n_pairs") - 1)).withColumn(
        "w_p", F.coalesce(F.col("w_exact"), normal_tail(F.col("z")))).drop("w_exact", "z")
    return done if keys else done.drop("all_rows")


def adoption(tests: DataFrame, level: float = 0.05, p: str = "w_p") -> DataFrame:
    """Adopt a change with a significant test and more than half of the pairs won."""
    return tests.withColumn("adopt", F.coalesce((F.col(p) < level) & (F.col("wins") > F.col("n_pairs") / 2), F.lit(False)))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman coefficients with two-sided p-values, one row."""
    full = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    ranked = average_ranks(average_ranks(full, [], "x", "rx"), [], "y", "ry")
    c = ranked.agg(F.count("*").alias("n"), F.corr("x", "y").alias("pearson_r"), F.corr("rx", "ry").alias("spearman_r"))
    t = lambda r: F.col(r) * F.sqrt((F.col("n") - 2) / (1 - F.col(r) * F.col(r)))
    return c.withColumn("pearson_p", t_tail(t("pearson_r"), F.col("n") - 2)).withColumn("spearman_p", t_tail(t("spearman_r"), F.col("n") - 2))
