"""Logistic models of many groups or folds at once.

Every Newton round is one job: tasks add up the gradient and Hessian of each
model over their rows, the sums meet by model, and all small systems are solved
in one batch. Nothing is fitted group by group, so a thousand groups take as
many jobs as one. A model that has converged leaves the work.

The objective of a model with n rows is

    mean log loss + l2 / 2 * |weights|^2        (the intercept is free),

with ``l2`` given, or 1 / (c * n) for the penalty that weighs the whole loss by c.

A row counts for its group's model (``own``), or for the models of all other
folds (``others``), without being copied for them: a task holds the models of
``MODELS`` folds at a time and masks each fold's own rows. Sums of a model meet
in ``SALTS`` parts first, so a group that holds a third of all rows is summed
where its rows are.

Defined cases: rows with a null label or features take no part; with ``own``
those without a group have no model, with ``others`` they train every fold's and
are never scored. A model whose rows have one class has no finite fit: it is
returned unconverged. Nothing to fit gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occgraph.operators.models import eligible_folds
from occgraph.session import materialize

SALTS = 32
MODELS = 64
HELD = 4_000_000  # numbers that a task holds before it passes its sums on
STATE = "model string, beta array<double>, before array<double>, best double, n long, rounds int, converged boolean"
_SUMS = "model string, salt int, sums array<double>"


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as rows of numbers, with the intercept's one at the end."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return np.hstack([values, np.ones((len(column), 1))])


def _sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Rows, loss, gradient and Hessian at ``beta``."""
    z = x @ beta
    p = np.exp(-np.logaddexp(0, -z))
    return np.concatenate([[len(y), (np.logaddexp(0, z) - y * z).sum()], x.T @ (p - y), (x.T @ (x * (p * (1 - p))[:, None])).ravel()])


class _Held:
    """Sums by model, passed on when they grow large."""

    def __init__(self):
        self.sums: dict[str, np.ndarray] = {}
        self.numbers = 0

    def add(self, model: str, sums: np.ndarray) -> None:
        if model in self.sums:
            self.sums[model] += sums
        else:
            self.sums[model] = sums
            self.numbers += len(sums)

    def rows(self) -> pa.RecordBatch:
        models, sums = list(self.sums), list(self.sums.values())
        salt = TaskContext.get().partitionId() % SALTS
        self.__init__()
        return pa.RecordBatch.from_arrays(
            [pa.array(models, pa.string()), pa.array([salt] * len(models), pa.int32()), pa.array(sums, pa.list_(pa.float64()))], names=["model", "salt", "sums"])


def _own_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that carry their model's coefficients."""
    held = _Held()
    for batch in batches:
        if not len(batch):
            continue
        x, y = _matrix(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False)
        codes, models = pd.factorize(batch.column("model").to_pandas())
        order = np.argsort(codes, kind="stable")
        starts = np.searchsorted(codes[order], np.arange(len(models)))
        for model, rows in zip(models, np.split(order, starts[1:])):
            held.add(model, _sums(x[rows], y[rows], np.array(batch.column("beta")[int(rows[0])].as_py())))
        if held.numbers > HELD:
            yield held.rows()
    if held.sums:
        yield held.rows()


def _other_rows(betas: dict[str, list[float]]):
    """Rows of all folds; each counts for the models of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            if not len(batch):
                continue
            x, y = _matrix(batch.column("x")), batch.column("y").to_numpy(zero_copy_only=False)
            home = batch.column("model").to_pandas()
            for model, beta in betas.items():
                others = (home != model).to_numpy()
                if others.any():
                    held.add(model, _sums(x[others], y[others], np.array(beta)))
        if held.sums:
            yield held.rows()

    return run


def _added(key, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"model": [rows["model"].iloc[0]], "salt": [0], "sums": [np.sum(np.stack(rows["sums"].to_list()), axis=0)]})


def _step(l2: float, c: float | None, tol: float):
    """A Newton step for every model; half the way back where the last one made the objective worse."""

    def moved(r) -> tuple:
        beta, width = np.array(r.beta), len(r.beta)
        n, loss = r.sums[:2]
        free = np.append(np.ones(width - 1), 0.0) * (l2 if c is None else 1 / (c * n))
        value = loss / n + (free * beta * beta).sum() / 2
        if r.best is not None and value > r.best + 1e-12 * max(1.0, abs(r.best)):
            return (beta + np.array(r.before)) / 2, r.before, r.best, False
        gradient = r.sums[2 : 2 + width] / n + free * beta
        hessian = r.sums[2 + width :].reshape(width, width) / n + np.diag(free)
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        return beta - step, beta, value, bool(np.abs(step).max() <= tol)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                best = None if pd.isna(r.best) else r.best
                rows.append((r.model, *moved(r._replace(best=best, sums=np.array(r.sums))), int(r.sums[0]), r.rounds + 1))
            out = pd.DataFrame(rows, columns=["model", "beta", "before", "best", "converged", "n", "rounds"])
            yield out[["model", "beta", "before", "best", "n", "rounds", "converged"]]

    return run


def _rows(data: DataFrame, group: str, features: str, label: str) -> DataFrame:
    vector = dict(data.dtypes)[features] == "vector"
    x = vector_to_array(features) if vector else F.col(features).cast("array<double>")
    kept = data.filter(F.col(label).isNotNull() & F.col(features).isNotNull())
    return kept.select(F.col(group).cast("string").alias("model"), F.col(label).cast("double").alias("y"), x.alias("x"))


def logistic_fits(
    data: DataFrame, group: str, *, on: str = "own", l2: float = 1e-4, c: float | None = None, features: str = "features", label: str = "label",
    max_rounds: int = 50, tol: float = 1e-9, owner: str | None = None,
) -> DataFrame:
    """One logistic model a value of ``group``.

    ``model``, ``n``, ``coefficients``, ``intercept``, ``objective``,
    ``rounds``, ``converged``. Copies are written under ``owner``.
    """
    if on not in ("own", "others"):
        raise ValueError(f"on must be 'own' or 'others', got {on!r}")
    rows = materialize(_rows(data, group, features, label), owner)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    spark = data.sparkSession
    if width is None:
        state = spark.createDataFrame([], STATE)
    else:
        start = F.array_repeat(F.lit(0.0), width + 1)
        state = rows.filter("model IS NOT NULL").select("model").distinct().select(
            "model", start.alias("beta"), start.alias("before"), F.lit(None).cast("double").alias("best"),
            F.lit(0).cast("long").alias("n"), F.lit(0).alias("rounds"), F.lit(False).alias("converged"))
    state = materialize(state, owner)
    for _ in range(max_rounds):
        active = state.filter("NOT converged")
        if active.isEmpty():
            break
        if on == "own":
            parts = rows.join(active.select("model", "beta"), "model").select("model", "y", "x", "beta").mapInArrow(_own_rows, _SUMS)
        else:
            parts = _summed_for_others(rows, active)
        whole = parts.groupBy("model", "salt").applyInPandas(_added, _SUMS).groupBy("model").applyInPandas(_added, _SUMS)
        moved = active.join(whole.select("model", "sums"), "model").mapInPandas(_step(l2, c, tol), STATE)
        state = materialize(state.join(moved.select("model"), "model", "left_anti").unionByName(moved), owner) if on == "others" else materialize(
            state.filter("converged").unionByName(moved), owner)
    last = F.size("beta")
    return state.select(
        "model", "n", F.slice("beta", 1, last - 1).alias("coefficients"), F.element_at("beta", -1).alias("intercept"), F.col("best").alias("objective"), "rounds", "converged")


def _summed_for_others(rows: DataFrame, active: DataFrame) -> DataFrame:
    """The sums of all active models, ``MODELS`` of them in a pass over the rows."""
    spark = rows.sparkSession
    numbered = active.select("model", "beta").orderBy("model")
    parts, after = [], None
    while True:
        block = (numbered if after is None else numbered.filter(F.col("model") > after)).limit(MODELS).collect()
        if not block:
            break
        parts.append(rows.mapInArrow(_other_rows({r["model"]: r["beta"] for r in block}), _SUMS))
        after = block[-1]["model"]
    return reduce(lambda a, b: a.unionByName(b), parts) if parts else spark.createDataFrame([], _SUMS)


def linear_score(x: Column, coefficients: Column, intercept: Column) -> Column:
    """The probability of class 1, in JVM code."""
    z = F.aggregate(F.zip_with(x, coefficients, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b) + intercept
    return 1 / (1 + F.exp(-z))


def logistic_scores(data: DataFrame, fits: DataFrame, group: str, features: str = "features", name: str = "y_prob") -> DataFrame:
    """``data`` with the probability by the model of each row's group; rows without a model are left out."""
    x = vector_to_array(features) if dict(data.dtypes)[features] == "vector" else F.col(features)
    models = fits.select(F.col("model").alias("fitted_model"), "coefficients", "intercept")
    joined = data.join(models, F.col(group).cast("string") == F.col("fitted_model"))
    return joined.withColumn(name, linear_score(x, F.col("coefficients"), F.col("intercept"))).select(*data.columns, name)


def leave_out_scores(data: DataFrame, fold: str, owner: str | None = None, **fit) -> DataFrame:
    """Every row's probability by the model fitted on all rows of other folds."""
    return logistic_scores(data, logistic_fits(data, fold, on="others", owner=owner, **fit), fold)


def pooled_and_grouped(data: DataFrame, group: str, min_train: int = 30, owner: str | None = None, **fit) -> tuple[DataFrame, DataFrame]:
    """Test predictions of one model on all train rows and of one model an eligible group, and the skipped groups with their reason."""
    status = materialize(eligible_folds(data, [group], min_train), owner)
    eligible = status.filter("reason IS NULL").select(F.col(group).alias("eligible"))
    train, test = data.filter("role <> 'test'"), data.filter("role = 'test'")
    fits = logistic_fits(train.join(eligible, F.col(group) == F.col("eligible"), "left_semi"), group, owner=owner, **fit)
    everyone = lambda df: df.withColumn("everyone", F.lit("all"))
    whole = logistic_fits(everyone(train), "everyone", owner=owner, **fit)
    pooled = logistic_scores(everyone(test), whole, "everyone").drop("everyone").withColumn("model", F.lit("pooled"))
    grouped = logistic_scores(test, fits, group).withColumn("model", F.lit("by_group"))
    return pooled.unionByName(grouped), status.filter("reason IS NOT NULL").select(group, "reason")
