"""Inductive sweep: fit on some records, score the held-out ones one by one.

A fold is prepared, scored out of fold, linked into a graph, propagated and
tuned on train and val rows only; the held-out rows are then attached all at
once, each as if it were alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Estimator
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occgraph.operators import graph as G
from occgraph.operators import models as M
from occgraph.operators.knn import knn_graph_pairs
from occgraph.operators.prep import GROUP_FLAGS, FeaturePrep, similarity_columns
from occgraph.session import materialize, owned_copies, row_sized

AT_ONCE = 5  # cases of a sweep that run side by side; their copies stand beside each other


@dataclass
class SweepConfig:
    k: int = 15
    k_predict: int = 10
    alpha: float = 0.5
    max_km: float = 2000.0
    strategy: str = "mixed"
    top_features: int = 10
    n_folds: int = 5
    propagation: str = "mean"
    use_score: bool = True
    use_edge_stats: bool = True
    drop_coordinates: bool = False
    without: tuple[str, ...] = ()  # families of features left out: minerals, lithology, places
    unify_edge_rule: bool = True
    seed: int = 42
    factory: M.Factory = M.ensemble
    selector: object = field(default_factory=lambda: M.boosted)
    grid: list = field(default_factory=lambda: [{"regParam": r, "elasticNetParam": e} for r in (0.001, 0.01, 0.1) for e in (0.0, 0.5)])


def _classifier(setting: dict) -> Estimator:
    return LogisticRegression(labelCol="label", maxIter=50, **setting)


@dataclass
class FittedFold:
    """Everything needed to score a new record against the stored graph."""

    prep: FeaturePrep
    selected: list[str]
    scorers: list
    graph: G.Graph
    stored: DataFrame
    inputs: list[str]
    classifier: object
    config: SweepConfig
    trials: DataFrame | None = None


def _own_columns(cfg: SweepConfig, selected: list[str]) -> list[str]:
    names = [f"x{i}" for i in range(len(selected))]
    if cfg.use_score:
        names.append("score")
    if cfg.use_edge_stats:
        names += ["mean_weight", "max_weight"]
    return names


@dataclass
class PreparedFold:
    """What a fold's conditions share as long as they differ in the graph or the classifier only."""

    prep: FeaturePrep
    selected: list[str]
    scorers: list
    nodes: DataFrame
    pairs: DataFrame


@dataclass
class FoldGraph:
    """A prepared fold's weighted graph, and its nodes with the statistics of their edges."""

    prepared: PreparedFold
    graph: G.Graph
    stored: DataFrame


def preparation_of(cfg: SweepConfig) -> tuple:
    """Conditions with equal values share a fold's preparation."""
    return cfg.k, cfg.top_features, cfg.n_folds, cfg.use_score, cfg.drop_coordinates, cfg.without, cfg.seed, cfg.factory, cfg.selector


def graph_of(cfg: SweepConfig) -> tuple:
    """Conditions with equal values share a fold's graph, and what is attached to it."""
    return *preparation_of(cfg), cfg.strategy, cfg.alpha, cfg.max_km, cfg.unify_edge_rule, cfg.k_predict


def prepare_fold(data: DataFrame, cfg: SweepConfig) -> PreparedFold:
    """``data``: records with ``role`` train or val (test rows are ignored)."""
    data = materialize(data.filter("role <> 'test'"))
    prep = FeaturePrep(drop_coordinates=cfg.drop_coordinates, without=cfg.without).fit(data.filter("role = 'train'"))
    names = prep.names()
    vectors = materialize(prep.transform(data, keep=["role", "label"]))
    ranked = cfg.selector(cfg.seed).fit(vectors.filter("role = 'train'").withColumn("label", F.col("label").cast("double")))
    selected = M.tree_importance(ranked, names, cfg.top_features)
    if "minerals" in cfg.without:  # the deposit groups make up for them
        selected += [c for c in GROUP_FLAGS if c in names and c not in selected]
    scores, scorers = M.leakage_free_scores(vectors, factory=cfg.factory, n_folds=cfg.n_folds, seed=cfg.seed) if cfg.use_score else (None, [])
    nodes = _selected(prep, data, selected, names, ["role", "label", "lat", "lon"])
    if scores is not None:
        nodes = row_sized(nodes).join(scores.select("row_id", "score"), "row_id")
    nodes = row_sized(materialize(nodes))
    return PreparedFold(prep, selected, scorers, nodes, materialize(knn_graph_pairs(nodes, cfg.k)))


def fold_graph(prepared: PreparedFold, cfg: SweepConfig) -> FoldGraph:
    graph = G.build_weighted_graph(
        prepared.nodes, cfg.k, strategy=cfg.strategy, alpha=cfg.alpha, max_km=cfg.max_km, fit_role="train", unify_edge_rule=cfg.unify_edge_rule, pairs=prepared.pairs)
    graph = G.Graph(prepared.nodes, row_sized(materialize(graph.edges)), graph.sigma)
    return FoldGraph(prepared, graph, row_sized(materialize(G.edge_stats(prepared.nodes, graph.edges))))


def fit_fold(data: DataFrame, cfg: SweepConfig) -> FittedFold:
    """Prepare, link, propagate and tune on the train and val rows of ``data``."""
    return fit_graph(fold_graph(prepare_fold(data, cfg), cfg), cfg)


def fit_graph(linked: FoldGraph, cfg: SweepConfig) -> FittedFold:
    """The fold's classifier over its propagated features, tuned on its val rows."""
    prepared, graph, stored = linked.prepared, linked.graph, linked.stored
    own = _own_columns(cfg, prepared.selected)
    inputs = list(own)
    table = stored
    if cfg.propagation != "none":
        one = row_sized(materialize(G.propagate(stored, graph.edges, own, cfg.propagation, "h1_")))
        two = G.propagate(one, graph.edges, [f"h1_{c}" for c in own], cfg.propagation, "h2_").toDF("row_id", *[f"h2_{c}" for c in own])
        table = stored.join(one, "row_id").join(two, "row_id")
        inputs += [f"h1_{c}" for c in own] + [f"h2_{c}" for c in own]
    assembled = materialize(M.assemble(table.withColumn("label", F.col("label").cast("double")), inputs, ["row_id", "role", "label"]))
    _, classifier, trials = M.grid_search(assembled, cfg.grid, _classifier)
    return FittedFold(prepared.prep, prepared.selected, prepared.scorers, graph, stored, inputs, classifier, cfg, trials)


def _selected(prep: FeaturePrep, data: DataFrame, selected: list[str], names: list[str], keep: list[str]) -> DataFrame:
    """Selected features as ``x0..`` and the similarity vector ``geo``."""
    place = {n: i for i, n in enumerate(names)}
    wide = prep.transform(data, keep=keep).withColumn("v", vector_to_array("features"))
    picked = [F.element_at("v", place[c] + 1).alias(f"x{i}") for i, c in enumerate(selected)]
    similar = similarity_columns(selected) or selected
    return wide.select("row_id", *keep, *picked, F.array(*[F.element_at("v", place[c] + 1) for c in similar]).alias("geo"))


@dataclass
class Arrivals:
    """Held-out records attached to a fold's graph, with their edges' statistics."""

    attached: DataFrame
    table: DataFrame


def attach_arrivals(linked: FoldGraph, records: DataFrame, cfg: SweepConfig) -> Arrivals:
    prepared = linked.prepared
    arrivals = _selected(prepared.prep, records, prepared.selected, prepared.prep.names(), ["lat", "lon"])
    if cfg.use_score:
        scored = M.ensemble_score(prepared.scorers, prepared.prep.transform(records))
        arrivals = row_sized(arrivals).join(scored.select("row_id", "score"), "row_id")
    arrivals = row_sized(materialize(arrivals))
    attached = materialize(G.attach_held_out(arrivals, linked.stored, linked.graph.sigma, k=cfg.k_predict, max_km=cfg.max_km, strategy=cfg.strategy, alpha=cfg.alpha))
    return Arrivals(row_sized(attached), row_sized(materialize(G.attached_stats(arrivals, attached))))


def score_arrivals(fold: FittedFold, arrivals: Arrivals) -> DataFrame:
    """``(row_id, y_prob, y_pred)`` of attached records."""
    cfg, table = fold.config, arrivals.table
    if cfg.propagation != "none":
        own = _own_columns(cfg, fold.selected)
        table = table.join(G.propagate_held_out(table, fold.stored, fold.graph.edges, arrivals.attached, own, cfg.propagation), "row_id")
    assembled = M.assemble(table, fold.inputs, ["row_id"])
    return M.predict(fold.classifier, assembled, "y_prob").select("row_id", "y_prob", (F.col("y_prob") >= 0.5).cast("int").alias("y_pred"))


def score_held_out(fold: FittedFold, records: DataFrame) -> DataFrame:
    """``(row_id, y_prob, y_pred)`` of records attached to the stored graph."""
    linked = FoldGraph(PreparedFold(fold.prep, fold.selected, fold.scorers, fold.graph.nodes, None), fold.graph, fold.stored)
    return score_arrivals(fold, attach_arrivals(linked, records, fold.config))


def run_conditions(data: DataFrame, conditions: dict[str, SweepConfig]) -> Iterator[tuple[str, DataFrame]]:
    """Held-out predictions of one fold by condition: ``(row_id, y_true, y_prob, y_pred)``.

    What conditions have in common is made once: the preparation with its
    scores and neighbours, the graph, and what is attached to it.
    """
    test = data.filter("role = 'test'")
    truth = row_sized(test.select("row_id", F.col("label").cast("int").alias("y_true")))
    prepared: dict[tuple, PreparedFold] = {}
    linked: dict[tuple, tuple[FoldGraph, Arrivals]] = {}
    for name, cfg in conditions.items():
        if preparation_of(cfg) not in prepared:
            prepared[preparation_of(cfg)] = prepare_fold(data, cfg)
        if graph_of(cfg) not in linked:
            graph = fold_graph(prepared[preparation_of(cfg)], cfg)
            linked[graph_of(cfg)] = graph, attach_arrivals(graph, test, cfg)
        graph, arrivals = linked[graph_of(cfg)]
        yield name, score_arrivals(fit_graph(graph, cfg), arrivals).join(truth, "row_id")


def run_fold(data: DataFrame, cfg: SweepConfig) -> DataFrame:
    """Held-out predictions of one fold: ``(row_id, y_true, y_prob, y_pred)``."""
    return next(run_conditions(data, {"": cfg}))[1]


def run_sweep(records: DataFrame, splits: DataFrame, cases: list[tuple[int, str]], cfg: SweepConfig, model: str = "graph", exp: str = "loro") -> DataFrame:
    """Predictions over ``(seed, fold)`` cases in the long prediction layout."""
    return sweep_conditions(records, splits, cases, {"": cfg}, model, exp).drop("condition")


def sweep_conditions(records: DataFrame, splits: DataFrame, cases: list[tuple[int, str]], conditions: dict[str, SweepConfig], model: str = "graph", exp: str = "loro") -> DataFrame:
    """The same cases under several configurations, with a ``condition`` column.

    The list of cases is small; the work of each case is distributed. Cases know
    nothing of each other: ``AT_ONCE`` of them hand in their jobs side by side, as
    one case's are many and short. A case's copies are deleted when its
    predictions are written.
    """
    spark = records.sparkSession

    def run(case: tuple[int, str]) -> list[DataFrame]:
        seed, fold = case
        roles = splits.filter((F.col("seed") == seed) & (F.col("fold") == fold)).select("row_id", "role")
        parts = []
        with owned_copies(spark, "fold"):
            for name, predicted in run_conditions(materialize(records.join(roles, "row_id")), conditions):
                parts.append(materialize(predicted, "predictions").select(
                    F.lit(exp).alias("exp"), F.lit(model).alias("model"), F.lit(seed).alias("seed"), F.lit(fold).alias("region"), "row_id", "y_true", "y_prob", "y_pred",
                    F.lit(name).alias("condition")))
        return parts

    with ThreadPoolExecutor(AT_ONCE) as pool:
        parts = [part for case in pool.map(run, cases) for part in case]
    return reduce(lambda a, b: a.unionByName(b), parts)
