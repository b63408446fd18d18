"""Gradient boosting by leaf-wise growth, with early stopping, for many models at once.

Values are cut into at most ``bins`` quantile bins, a byte each. A round is one
job: every task adds up gradients and Hessians by (model, leaf, feature, bin)
over its rows, the sums meet by leaf, and one row a leaf comes back, its best
split. A tree grows best gain first up to ``leaves`` leaves. Leaves that may be
split are asked for together, all models' in one job, and the order of the
splits is settled from the answers; a tree takes as many rounds as it is deep
instead of one a split, and equals the one grown split by split.

Each row names the models that it trains and those that it watches: folds,
groups and a pooled model grow in the same jobs without a copy of the rows for
each. The watching rows' loss comes with a tree's first round; a model stops
after ``patience`` trees without a lower one and keeps the trees up to the best.

Rows hold their margins, brought up to date every ``SNAPSHOT`` trees, so a round
replays few trees. What the driver holds are trees, edges and a split a leaf.

Defined cases: a null label or null features take no part; a missing value (NaN,
or null inside the features) goes right at every split; constant features are
never split; a model without rows or with one class has no trees and predicts its
rate (0.5 without rows); equal gains go to the lesser feature, then the lesser
bin; without watching rows all ``iterations`` trees are grown.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occgraph.functions.hashing import hash_order
from occgraph.operators.models import eligible_folds
from occgraph.operators.splits import hash_rank, stratified_folds
from occgraph.session import materialize

SNAPSHOT = 25
FEATURE_BLOCK = 64
LOSS = -1
_SPLIT = "model int, node long, block int, gain double, feature int, bin int, n_left double, g_left double, h_left double, n_right double, g_right double, h_right double"
_SUMS = "model int, node long, block int, sums array<double>"


@dataclass(frozen=True)
class BoostConfig:
    """The published configuration by default; ``max_depth`` limits leaf-wise growth as well."""

    iterations: int = 300
    leaves: int = 31
    max_depth: int = 30
    learning_rate: float = 0.05
    bins: int = 64
    min_rows: int = 20
    l2: float = 1.0
    row_share: float = 0.8
    feature_share: float = 0.8
    patience: int = 20
    seed: int = 42


LEAF_WISE = BoostConfig()
DEPTH_LIMITED = BoostConfig(leaves=64, max_depth=6)


@dataclass
class Tree:
    """Splits by node (1 is the root, 2n and 2n + 1 are n's children) and the leaves' values."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)
    gains: dict[int, float] = field(default_factory=dict)

    def arrays(self) -> tuple[np.ndarray, ...]:
        """Feature (-1 at a leaf), bin, left and right child, value and node number by position."""
        nodes = sorted({1, *self.splits, *(c for n in self.splits for c in (2 * n, 2 * n + 1))})
        at = {n: i for i, n in enumerate(nodes)}
        inner = [self.splits.get(n) for n in nodes]
        return (
            np.array([s[0] if s else -1 for s in inner]), np.array([s[1] if s else 0 for s in inner]),
            np.array([at[2 * n] if s else 0 for n, s in zip(nodes, inner)]), np.array([at[2 * n + 1] if s else 0 for n, s in zip(nodes, inner)]),
            np.array([self.values.get(n, 0.0) for n in nodes]), np.array(nodes, dtype=np.int64))


def _leaves(tree: tuple[np.ndarray, ...], left: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], n: int) -> np.ndarray:
    """Each row's leaf position; ``left(rows, features, bins)`` says who goes left."""
    feature, bins, lower, upper = tree[:4]
    at = np.zeros(n, dtype=np.int64)
    while True:
        rows = np.flatnonzero(feature[at] >= 0)
        if not len(rows):
            return at
        now = at[rows]
        at[rows] = np.where(left(rows, feature[now], bins[now]), lower[now], upper[now])


def _mixed(*parts) -> np.ndarray:
    """Uniform numbers in [0, 1) from integers: the same for a row in every round and on every cluster."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for part in parts:
            h = (h ^ np.asarray(part).astype(np.int64).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def best_split(sums: np.ndarray, features: np.ndarray, config: BoostConfig) -> tuple | None:
    """Best split of a leaf from its sums, an array (rows, gradient, Hessian) x feature x bin, of the named features."""
    left = np.cumsum(sums, axis=2)[:, :, :-1]
    right = sums.sum(axis=2)[:, :, None] - left
    score = lambda s: s[1] ** 2 / (s[2] + config.l2)
    whole = sums.sum(axis=2)[:, :, None]
    with np.errstate(divide="ignore", invalid="ignore"):  # a side without rows; ruled out below
        gain = score(left) + score(right) - score(whole)
    gain[(left[0] < config.min_rows) | (right[0] < config.min_rows)] = -np.inf
    gain = np.round(gain, 9)  # sums in another order differ in the last digits; ties must not
    f, b = np.unravel_index(np.argmax(gain), gain.shape)
    if not gain[f, b] > 1e-9:
        return None
    return float(gain[f, b]), int(features[f]), int(b), *left[:, f, b].tolist(), *right[:, f, b].tolist()


def _features_of(model: int, number: int, width: int, config: BoostConfig) -> np.ndarray:
    """The features that a tree may use."""
    drawn = _mixed(config.seed, model, number, np.arange(width))
    keep = max(1, round(width * config.feature_share))
    return np.sort(np.argsort(drawn, kind="stable")[:keep])


class _Growing:
    """A model between rounds: its finished trees and the splits known of the next one."""

    def __init__(self, model: int, base: float, config: BoostConfig):
        self.model, self.base, self.config = model, base, config
        self.trees: list[Tree] = []
        self.known: dict[int, tuple | None] = {}
        self.losses: list[float] = []
        self.done = False

    def plan(self) -> tuple[Tree, list[int], bool]:
        """The tree by what is known, the nodes to ask for, and whether none is missing."""
        tree, open_nodes, wanted = Tree(), [1], []
        if 1 not in self.known:
            return tree, [1], False
        while len(tree.splits) < self.config.leaves - 1:
            for n in open_nodes:
                if n not in self.known and n not in wanted:
                    wanted.append(n)
            ready = [n for n in open_nodes if self.known.get(n)]
            if not ready:
                break
            node = max(ready, key=lambda n: (self.known[n][0], -n))
            gain, feature, b, *sides = self.known[node]
            tree.splits[node], tree.gains[node] = (feature, b), gain
            for child, (_, g, h) in ((2 * node, sides[:3]), (2 * node + 1, sides[3:])):
                tree.values[child] = -self.config.learning_rate * g / (h + self.config.l2)
                if child >= 1 << self.config.max_depth:
                    self.known[child] = None
                open_nodes.append(child)
            open_nodes.remove(node)
        return tree, wanted, not wanted

    def watched(self, loss: float | None) -> None:
        """The loss before the next tree; stops where it hasn't fallen for long."""
        if loss is not None:
            self.losses.append(loss)
            best = int(np.argmin(self.losses))
            if len(self.losses) - 1 - best >= self.config.patience:
                del self.trees[best:]
                self.done = True

    def finished(self, tree: Tree) -> None:
        self.known = {}
        if tree.splits:
            self.trees.append(tree)
        self.done = self.done or not tree.splits or len(self.trees) >= self.config.iterations


def _members(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, model, is training) for each model that a row of the batch belongs to, training ones first in a row."""
    trains, watches = batch.column("trains"), batch.column("watches")
    n_train, n_watch = (c.value_lengths().to_numpy(zero_copy_only=False) for c in (trains, watches))
    rows = np.concatenate([np.repeat(np.arange(len(batch)), n_train), np.repeat(np.arange(len(batch)), n_watch)])
    models = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in (trains, watches)]).astype(np.int64)
    is_train = np.concatenate([np.ones(n_train.sum(), bool), np.zeros(n_watch.sum(), bool)])
    order = np.argsort(rows, kind="stable")
    return rows[order], models[order], is_train[order]


def _bins(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(len(batch), -1)


def _margins(batch: pa.RecordBatch, bins: np.ndarray, rows: np.ndarray, models: np.ndarray, recent: dict[int, list[tuple]]) -> np.ndarray:
    """Margins of each (row, model): the stored ones and what the trees since then add."""
    margin = batch.column("margins").flatten().to_numpy(zero_copy_only=False).copy()
    for model, trees in recent.items():
        mine = np.flatnonzero(models == model)
        for tree in trees:
            if len(mine):
                margin[mine] += tree[4][_leaves(tree, lambda r, f, b: bins[rows[mine[r]], f] <= b, len(mine))]
    return margin


def _round(recent: dict[int, list[tuple]], asked: dict[int, tuple], config: BoostConfig):
    """A task's sums: ``asked`` is model -> (number of its tree, the tree so far, wanted nodes, whether to watch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            bins = _bins(batch)
            width = bins.shape[1]
            rows, models, is_train = _members(batch)
            margin = _margins(batch, bins, rows, models, recent)
            label = batch.column("label").to_numpy(zero_copy_only=False)[rows]
            ids = batch.column("key").to_numpy(zero_copy_only=False)[rows]
            places = np.arange(width) * config.bins
            for model, (number, tree, wanted, watch) in asked.items():
                own = models == model
                if watch:
                    seen = np.flatnonzero(own & ~is_train)
                    if len(seen):
                        loss = np.logaddexp(0, margin[seen]) - label[seen] * margin[seen]
                        held.setdefault((model, LOSS), np.zeros(2))[:] += [len(seen), loss.sum()]
                mine = np.flatnonzero(own & is_train & (_mixed(config.seed, model, number, ids) < config.row_share))
                if not len(mine):
                    continue
                p = 1 / (1 + np.exp(-margin[mine]))
                g, h = p - label[mine], p * (1 - p)
                node = tree[5][_leaves(tree, lambda r, f, b: bins[rows[mine[r]], f] <= b, len(mine))]
                for n in wanted:
                    at = np.flatnonzero(node == n)
                    if len(at):
                        cells = (bins[rows[mine[at]]] + places).ravel()
                        sums = held.setdefault((model, n), np.zeros((3, width * config.bins)))
                        for i, w in enumerate((None, g[at], h[at])):
                            sums[i] += np.bincount(cells, None if w is None else np.repeat(w, width), width * config.bins)
        out = []
        for (model, n), sums in held.items():
            if n == LOSS:
                out.append((model, n, 0, sums))
            else:
                parts = sums.reshape(3, -1, config.bins)
                out += [(model, n, b, parts[:, b * FEATURE_BLOCK : (b + 1) * FEATURE_BLOCK].ravel()) for b in range(-(-parts.shape[1] // FEATURE_BLOCK))]
        if out:
            models, nodes, blocks, sums = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(models, pa.int32()), pa.array(nodes, pa.int64()), pa.array(blocks, pa.int32()), pa.array(list(sums), pa.list_(pa.float64()))], names=["model", "node", "block", "sums"])

    return run


def _splits(numbers: dict[int, int], width: int, config: BoostConfig):
    """Adds up the tasks' sums of each leaf, one at a time, and finds its best split; a loss comes back as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("model", "node", "block")])
            sums = batch.column("sums")
            for i, key in enumerate(keys):
                part = sums[i].values.to_numpy(zero_copy_only=False)
                held[key] = held[key] + part if key in held else part
        found = []
        for (model, node, block), sums in held.items():
            if node == LOSS:
                found.append((model, node, block, sums[1] / sums[0], 0, 0, *[0.0] * 6))
                continue
            first = block * FEATURE_BLOCK
            allowed = _features_of(model, numbers[model], width, config)
            allowed = allowed[(allowed >= first) & (allowed < first + FEATURE_BLOCK)]
            best = best_split(sums.reshape(3, -1, config.bins)[:, allowed - first], allowed, config) if len(allowed) else None
            if best:
                found.append((model, node, block, *best))
        if found:
            yield pa.RecordBatch.from_pandas(pd.DataFrame(found, columns=[c.split()[0] for c in _SPLIT.split(", ")]).astype({"model": "int32", "block": "int32", "feature": "int32", "bin": "int32"}), preserve_index=False)

    return run


@dataclass
class Boosted:
    """Fitted models: ``trees[m]`` with their bins' ``edges`` and the margin that each starts from."""

    edges: list[np.ndarray]
    bases: list[float]
    trees: list[list[Tree]]
    losses: list[list[float]]

    def score(self, features: Column, model: Column) -> Column:
        """Probability of class 1 by the model that the row names; null without one."""
        edges, bases = self.edges, self.bases
        trees = [[t.arrays() for t in own] for own in self.trees]

        @F.pandas_udf("double")
        def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for x, m in batches:
                out = np.full(len(x), np.nan)
                known = np.flatnonzero(m.notna() & x.notna())
                which = m.iloc[known].to_numpy(dtype=np.int64)
                binned = _binned(x.iloc[known], edges)
                for one in np.unique(which):
                    at = np.flatnonzero(which == one)
                    margin = np.full(len(at), bases[one])
                    for tree in trees[one]:
                        margin += tree[4][_leaves(tree, lambda r, f, b: binned[at[r], f] <= b, len(at))]
                    out[known[at]] = 1 / (1 + np.exp(-margin))
                yield pd.Series(out).replace({np.nan: None}).astype("float64")

        return F.nanvl(scores(features, model), F.lit(None).cast("double"))

    def importance(self, names: list[str], model: int = 0) -> dict[str, float]:
        """Gain of each feature's splits, as a share of all."""
        gains = np.zeros(len(names))
        for tree in self.trees[model]:
            for node, (feature, _) in tree.splits.items():
                gains[feature] += tree.gains[node]
        return dict(zip(names, (gains / (gains.sum() or 1.0)).tolist()))


def _binned(values: pd.Series, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of each value: how many edges are below it; missing values are above all."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in values]).reshape(len(values), len(edges))
    out = np.empty(x.shape, dtype=np.uint8)
    for f, e in enumerate(edges):
        out[:, f] = np.where(np.isnan(x[:, f]), len(e), np.searchsorted(e, x[:, f]))
    return out


def bin_edges(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """At most ``bins`` - 1 edges a feature, from quantiles over all rows."""
    shares = [i / bins for i in range(1, bins)]
    at = [F.percentile_approx(F.nanvl(F.element_at("x", i + 1), F.lit(None).cast("double")), shares, 10_000).alias(f"q{i}") for i in range(width)]
    found = rows.agg(*at).first()
    return [np.unique(np.array(q or [], dtype=np.float64)) for q in found]


def fit_boosted(
    data: DataFrame, n_models: int, config: BoostConfig = LEAF_WISE, *, key: str = "row_id", features: str = "features", label: str = "label",
    trains: str = "trains", watches: str = "watches", owner: str | None = None,
) -> Boosted:
    """Models 0 to ``n_models`` - 1; a row's ``trains`` and ``watches`` are arrays of their numbers.

    ``key`` is an integer that names the row; it decides which trees sample it.
    Copies are written under ``owner``.
    """
    x = vector_to_array(features) if dict(data.dtypes)[features] == "vector" else F.col(features).cast("array<double>")
    none = F.array().cast("array<int>")
    rows = data.filter(F.col(label).isNotNull() & F.col(features).isNotNull()).select(
        F.col(key).cast("long").alias("key"), F.col(label).cast("double").alias("label"), x.alias("x"),
        F.coalesce(F.col(trains).cast("array<int>"), none).alias("trains"), F.coalesce(F.col(watches).cast("array<int>"), none).alias("watches"))
    rows = materialize(rows.filter((F.size("trains") > 0) | (F.size("watches") > 0)), owner)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    counts = {r["model"]: (r["n"], r["s"]) for r in rows.select(F.explode("trains").alias("model"), "label").groupBy("model").agg(F.count("*").alias("n"), F.sum("label").alias("s")).collect()}
    growing, bases = {}, []
    for m in range(n_models):
        n, s = counts.get(m, (0, 0.0))
        rate = min(max(s / n, 1e-12), 1 - 1e-12) if n else 0.5
        bases.append(float(np.log(rate / (1 - rate))))
        growing[m] = _Growing(m, bases[-1], config)
        growing[m].done = not 0 < s < n
    if width is None:
        return Boosted([], bases, [[] for _ in bases], [[] for _ in bases])
    edges = bin_edges(rows.filter(F.size("trains") > 0), width, config.bins)

    @F.pandas_udf("binary")
    def as_bins(values: pd.Series) -> pd.Series:
        return pd.Series([b.tobytes() for b in _binned(values, edges)], dtype=object)

    start = F.transform(F.concat("trains", "watches"), lambda m: F.element_at(F.array(*[F.lit(b) for b in bases]), m + 1))
    table = materialize(rows.select("key", "label", "trains", "watches", as_bins("x").alias("bins"), start.alias("margins")), owner)
    recent: dict[int, list[tuple]] = {}
    while active := {m: g for m, g in growing.items() if not g.done}:
        asked = {}
        for m, g in active.items():
            tree, wanted, _ = g.plan()
            asked[m] = len(g.trees), tree.arrays(), wanted, 1 not in g.known
        numbers = {m: a[0] for m, a in asked.items()}
        sums = table.mapInArrow(_round(recent, asked, config), _SUMS).repartition("model", "node", "block")
        answers: dict[tuple[int, int], tuple | None] = {}
        for r in sums.mapInArrow(_splits(numbers, width, config), _SPLIT).collect():  # a row a leaf and block of features
            found, at = tuple(r)[3:], (r["model"], r["node"])
            if answers.get(at) is None or (found[0], -found[1]) > (answers[at][0], -answers[at][1]):
                answers[at] = found
        for m, g in active.items():
            if asked[m][3]:
                loss = answers.get((m, LOSS))
                g.watched(loss[0] if loss else None)
                if g.done:
                    continue
            g.known |= {n: answers.get((m, n)) for n in asked[m][2]}
            tree, _, whole = g.plan()
            if whole:
                g.finished(tree)
                if tree.splits:
                    recent.setdefault(m, []).append(tree.arrays())
        if max(map(len, recent.values()), default=0) >= SNAPSHOT:
            table = materialize(table.mapInArrow(_brought_up(recent), table.schema), owner)
            recent = {}
    return Boosted(edges, bases, [growing[m].trees for m in range(n_models)], [growing[m].losses for m in range(n_models)])


def _brought_up(recent: dict[int, list[tuple]]):
    """The table with the recent trees added to its margins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                bins = _bins(batch)
                rows, models, _ = _members(batch)
                margins = _margins(batch, bins, rows, models, recent)
                stored = batch.column("margins")
                whole = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(stored.value_lengths().to_numpy(zero_copy_only=False))]), pa.int32()), pa.array(margins))
                yield batch.set_column(batch.schema.get_field_index("margins"), "margins", whole)

    return run


# --- uses ------------------------------------------------------------------------

def boosted_with_stop(data: DataFrame, config: BoostConfig = LEAF_WISE, owner: str | None = None) -> Boosted:
    """One model on the rows with role train, stopped by those with role val."""
    none = F.array().cast("array<int>")
    one = lambda role: F.when(F.col("role") == role, F.array(F.lit(0))).otherwise(none)
    return fit_boosted(data.withColumns({"trains": one("train"), "watches": one("val")}), 1, config, owner=owner)


def boosted_out_of_fold(data: DataFrame, config: BoostConfig = LEAF_WISE, n_folds: int = 5, seed: int = 42, owner: str | None = None) -> tuple[DataFrame, Boosted]:
    """``(row_id, role, score)``: train rows by the model of the other folds, all others by the model of all train rows.

    The folds' models and the last one grow together. No row stops a model that
    scores it, so all ``iterations`` trees are grown. With fewer than two rows
    of a class train rows are scored in sample.
    """
    train = data.filter("role = 'train'").select("row_id", "label", "features")
    folded = materialize(stratified_folds(train, [], "label", n_folds, seed), owner)
    n = folded.agg(F.max("fold_no")).first()[0]
    n = 0 if n is None else n + 1
    every = F.array(*[F.lit(i) for i in range(n + 1)])
    trains = F.filter(every, lambda m: (m == n) | (m != F.col("fold_no"))) if n else every
    fit = fit_boosted(folded.withColumns({"trains": trains, "watches": F.array().cast("array<int>")}), n + 1, config, owner=owner)
    scored = data.join(folded.select("row_id", "fold_no"), "row_id", "left").withColumn(
        "score", fit.score(vector_to_array("features") if dict(data.dtypes)["features"] == "vector" else F.col("features"), F.coalesce(F.col("fold_no"), F.lit(n))))
    return scored.select("row_id", "role", "score"), fit


def boosted_pooled_and_grouped(data: DataFrame, group: str, config: BoostConfig = LEAF_WISE, min_train: int = 30, owner: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Test predictions of one model on all train rows and of one model an eligible group, and the skipped groups with their reason.

    All models grow in the same jobs; a row trains the pooled model and its group's.
    """
    status = materialize(eligible_folds(data, [group], min_train), owner)
    eligible = sorted(r[0] for r in status.filter("reason IS NULL").select(group).collect())  # a row a model: the driver holds their trees
    number = F.element_at(F.create_map(*[F.lit(x) for i, g in enumerate(eligible) for x in (g, i + 1)]), F.col(group)) if eligible else F.lit(None).cast("int")
    numbered = data.withColumn("model_no", number)
    train = numbered.filter("role <> 'test'").withColumns({"trains": F.array_compact(F.array(F.lit(0), "model_no")), "watches": F.array().cast("array<int>")})
    fit = fit_boosted(train, len(eligible) + 1, config, owner=owner)
    x = vector_to_array("features") if dict(data.dtypes)["features"] == "vector" else F.col("features")
    test = numbered.filter("role = 'test'")
    pooled = test.withColumn("y_prob", fit.score(x, F.lit(0))).withColumn("model", F.lit("pooled"))
    grouped = test.filter("model_no IS NOT NULL").withColumn("y_prob", fit.score(x, F.col("model_no"))).withColumn("model", F.lit("by_group"))
    return pooled.unionByName(grouped).drop("model_no"), status.filter("reason IS NOT NULL").select(group, "reason")


def swap_importance(fit: Boosted, data: DataFrame, names: list[str], model: int = 0, seed: int = 42) -> DataFrame:
    """``(feature, importance)``: mean absolute change of the score when a row takes one feature from another row.

    Each row meets one donor, the row after it in a hash order (the last one
    meets the first). The row's variants, one a feature, are scored and summed
    where the pair is, so rows are neither copied nor sent once a feature.
    """
    x = vector_to_array("features") if dict(data.dtypes)["features"] == "vector" else F.col("features")
    rows = data.filter(F.col("features").isNotNull()).select("row_id", x.alias("x"))
    placed = materialize(hash_rank(rows, [], hash_order(F.lit("donor"), F.lit(seed), F.col("row_id"))))
    donors = placed.select("place", F.col("x").alias("donor"))
    pairs = placed.withColumn("place", F.col("place") % F.col("place_n") + 1).join(donors, "place").select("x", "donor")
    edges, base, trees, width = fit.edges, fit.bases[model], [t.arrays() for t in fit.trees[model]], len(names)

    def changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width), 0

        def score(bins: np.ndarray) -> np.ndarray:
            margin = np.full(len(bins), base)
            for tree in trees:
                margin += tree[4][_leaves(tree, lambda r, f, b: bins[r, f] <= b, len(bins))]
            return 1 / (1 + np.exp(-margin))

        for batch in batches:
            if not len(batch):
                continue
            own, other = (_binned(batch.column(c).to_pandas(), edges) for c in ("x", "donor"))
            before = score(own)
            for f in range(width):
                variant = own.copy()
                variant[:, f] = other[:, f]
                total[f] += np.abs(score(variant) - before).sum()
            n += len(batch)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total), pa.array([n] * width)], names=["feature", "total", "n"])

    return pairs.mapInArrow(changed, "feature string, total double, n long").groupBy("feature").agg((F.sum("total") / F.sum("n")).alias("importance"))
