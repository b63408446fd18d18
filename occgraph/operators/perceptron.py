"""Multi-layer perceptron by averaged local steps, stopped by held-out rows.

A round is one job. Every task starts from the same weights, takes Adam steps
over its train rows in mini-batches, and hands on its weights with the number
of rows behind them; their weighted mean is the next round's start. The val rows'
loss at the start of a round comes with the same job; after ``patience`` rounds
without a lower one training ends and the best round's weights stay.

What travels is the weights, a few times ten thousand numbers; rows stay where
they are, in batches. Tasks shuffle nothing: rows are dealt by a hash once, so
that each task has a fair share of both classes.

Defined cases: a null label or null features take no part; constant features
count as zero; without val rows all ``rounds`` are taken; without train rows the
first weights stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from occgraph.functions.hashing import hash_order
from occgraph.session import materialize

_PART = "n long, weights array<double>, n_val long, val_loss double"


def _layers(flat: np.ndarray, widths: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weight matrices and biases as views of one array."""
    out, at = [], 0
    for a, b in zip(widths[:-1], widths[1:]):
        out.append((flat[at : at + a * b].reshape(a, b), flat[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def margins(flat: np.ndarray, widths: list[int], x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Log odds of each row and the layers' activations."""
    held = [x]
    layers = _layers(flat, widths)
    for i, (w, b) in enumerate(layers):
        z = held[-1] @ w + b
        held.append(z if i == len(layers) - 1 else np.maximum(z, 0))
    return held[-1][:, 0], held


def gradient(flat: np.ndarray, widths: list[int], x: np.ndarray, y: np.ndarray, l2: float) -> np.ndarray:
    """Of the mean log loss plus l2 / 2 times the squared weights (biases are free)."""
    z, held = margins(flat, widths, x)
    layers, out = _layers(flat, widths), np.zeros_like(flat)
    grads = _layers(out, widths)
    delta = ((1 / (1 + np.exp(-z)) - y) / len(y))[:, None]
    for i in range(len(layers) - 1, -1, -1):
        grads[i][0][:] = held[i].T @ delta + l2 * layers[i][0]
        grads[i][1][:] = delta.sum(axis=0)
        if i:
            delta = (delta @ layers[i][0].T) * (held[i] > 0)
    return out


@dataclass
class Perceptron:
    hidden: tuple[int, ...] = (128, 64)
    rounds: int = 200
    patience: int = 10
    batch: int = 200
    step: float = 1e-3
    l2: float = 1e-4
    seed: int = 42
    losses: list[float] = field(default_factory=list)

    def fit(self, data: DataFrame, key: str = "row_id", features: str = "features", label: str = "label", owner: str | None = None) -> Perceptron:
        """``data`` has ``role``: train rows are learned from, val rows stop it."""
        x = vector_to_array(features) if dict(data.dtypes)[features] == "vector" else F.col(features).cast("array<double>")
        rows = data.filter(F.col(label).isNotNull() & F.col(features).isNotNull() & F.col("role").isin("train", "val")).select(
            F.col(key).alias("key"), (F.col("role") == "train").alias("learns"), F.col(label).cast("double").alias("y"), x.alias("x"))
        dealt = hash_order(F.lit(self.seed), F.col("key"))
        rows = materialize(rows.repartition(dealt).sortWithinPartitions(dealt, "key"), owner)
        each = rows.filter("learns").select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("dev")).orderBy("at").collect()
        self.mean = np.array([r["mean"] for r in each])
        self.dev = np.array([r["dev"] or 1.0 for r in each])
        self.widths = [len(each), *self.hidden, 1]
        r = np.random.default_rng(self.seed)
        flat = np.concatenate([np.concatenate([r.uniform(-1, 1, a * b) * np.sqrt(6 / (a + b)), np.zeros(b)]) for a, b in zip(self.widths[:-1], self.widths[1:])])
        self.weights, self.losses = flat, []
        best = None
        for number in range(self.rounds if len(each) else 0):
            parts = rows.mapInArrow(self._round(flat, number), _PART).collect()  # a row a task
            n, n_val = sum(p["n"] for p in parts), sum(p["n_val"] for p in parts)
            if n_val:
                self.losses.append(sum(p["val_loss"] for p in parts) / n_val)
                if best is None or self.losses[-1] < best:
                    best, self.weights = self.losses[-1], flat
                elif len(self.losses) - 1 - int(np.argmin(self.losses)) >= self.patience:
                    break
            if not n:
                break
            flat = sum(np.array(p["weights"]) * p["n"] for p in parts if p["n"]) / n
            if not n_val:
                self.weights = flat
        return self

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.dev

    def _round(self, flat: np.ndarray, number: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            w, m, v, steps = flat.copy(), np.zeros_like(flat), np.zeros_like(flat), 0
            n = n_val = 0
            loss = 0.0
            for batch in batches:
                if not len(batch):
                    continue
                x = self._scaled(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))
                y, learns = batch.column("y").to_numpy(zero_copy_only=False), batch.column("learns").to_numpy(zero_copy_only=False)
                if not learns.all():
                    z = margins(flat, self.widths, x[~learns])[0]
                    loss += float((np.logaddexp(0, z) - y[~learns] * z).sum())
                    n_val += int((~learns).sum())
                x, y = x[learns], y[learns]
                n += len(y)
                order = np.random.default_rng([self.seed, number, n]).permutation(len(y))
                for at in range(0, len(y), self.batch):
                    some, steps = order[at : at + self.batch], steps + 1
                    g = gradient(w, self.widths, x[some], y[some], self.l2)
                    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                    w = w - self.step * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([n_val]), pa.array([loss])], names=["n", "weights", "n_val", "val_loss"])

        return run

    def score(self, features: Column) -> Column:
        """Probability of class 1; null for null features."""
        weights, widths, scaled = self.weights, self.widths, self._scaled

        @F.pandas_udf("double")
        def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for x in batches:
                out = np.full(len(x), np.nan)
                known = np.flatnonzero(x.notna())
                if len(known):
                    out[known] = 1 / (1 + np.exp(-margins(weights, widths, scaled(np.stack(x.iloc[known].to_numpy())))[0]))
                yield pd.Series(out)

        return F.nanvl(probability(features), F.lit(None).cast("double"))
