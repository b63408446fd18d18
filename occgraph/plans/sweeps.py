"""One-parameter sweeps that share one neighbour table between conditions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occgraph.operators.infer import adoption
from occgraph.operators.knn import knn_graph_pairs
from occgraph.operators.metrics import all_metrics, metric_rows
from occgraph.operators.resultsets import condition_differences
from occgraph.plans.region_sweep import SweepConfig, sweep_conditions


def k_sweep(nodes: DataFrame, ks: list[int], max_km: float | None = 2000.0) -> DataFrame:
    """Edge counts and mean edge length per ``k``; neighbours are found once, at max(ks)."""
    pairs = knn_graph_pairs(nodes, max(ks)).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    kept = pairs.filter(F.col("rn") <= F.col("k"))
    if max_km is not None:
        kept = kept.filter((F.col("dist_km") <= max_km) | (F.col("rn") == 1))
    return kept.groupBy("k").agg((2 * F.count("*")).alias("n_edges"), F.avg("dist_km").alias("mean_km"))


def max_distance_sweep(nodes: DataFrame, limits_km: list[float], k: int = 15) -> DataFrame:
    """Edge counts and mean edge length per distance limit."""
    pairs = knn_graph_pairs(nodes, k).withColumn("max_km", F.explode(F.array(*[F.lit(x) for x in limits_km])))
    kept = pairs.filter((F.col("dist_km") <= F.col("max_km")) | (F.col("rn") == 1))
    return kept.groupBy("max_km").agg((2 * F.count("*")).alias("n_edges"), F.avg("dist_km").alias("mean_km"))


def ablations(cfg: SweepConfig) -> dict[str, SweepConfig]:
    """``cfg`` and its variants, each without one family of features or with the edge rule of the fit rows."""
    return {
        "all": cfg, "no_coordinates": replace(cfg, drop_coordinates=True), "no_minerals": replace(cfg, without=("minerals",)),
        "no_lithology": replace(cfg, without=("lithology",)), "no_places": replace(cfg, without=("places",)),
        "asymmetric_edges": replace(cfg, unify_edge_rule=False),
    }


def condition_sweep(records: DataFrame, splits: DataFrame, cases: list[tuple[int, str]], conditions: dict[str, SweepConfig]) -> DataFrame:
    """The same folds under several configurations, with a ``condition`` column; what they share is made once a fold."""
    return sweep_conditions(records, splits, cases, conditions)


def condition_metrics(preds: DataFrame) -> DataFrame:
    """``(condition, seed, region, metric, value)`` of a condition sweep."""
    keys = ["condition", "seed", "region"]
    return metric_rows(all_metrics(preds, keys), keys)


def compare_conditions(metrics: DataFrame, a: str, b: str) -> DataFrame:
    """Paired per fold and metric, with the adoption rule."""
    return adoption(condition_differences(metrics, a, b, ["seed", "region"]))
