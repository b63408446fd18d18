"""K-means of many groups and many starts at once, by Lloyd rounds.

A round is one job: every task assigns its points to the nearest centre of
their group, for all starts together, and adds up the points of each cell;
the sums meet by (group, start, cell). A start that has settled leaves the work.
A cell that loses all its points takes the point that is farthest from its own
centre, one cell a round, so every start ends with as many cells as it was given.

The centres of all groups and starts travel with the tasks: ``k`` points each.
The rows are dealt to all cores once and stay where they are, whatever a group's size.

Defined cases: rows with null coordinates or a null group take no part; a group
with fewer than ``k`` distinct points has a cell for each; ties go to the lesser
cell, then to the lesser start; copies of a point are in one cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from occgraph.functions.hashing import hash_order
from occgraph.session import materialize

Centres = dict[tuple[str, int], np.ndarray]
_SUMS = "grp string, start int, cell int, n long, total array<double>, cost double, far double, far_point array<double>"
_SETTLED = 1e-9


def first_centres(points: DataFrame, k: int, seed: int, starts: int) -> Centres:
    """What each start begins with: its group's distinct points that come first in a hash order of the start."""
    named = F.concat_ws(",", F.transform("x", lambda v: v.cast("string")))
    cases = points.select("grp", "x").distinct().withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(starts)])))
    ordered = cases.withColumn("h", hash_order(F.lit(seed), F.col("start"), named)).withColumn("slice", F.substring("h", -2, 2))
    # the first of each slice, then the first of these: no group is sorted in one task
    place = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy("h"))
    ahead = ordered.withColumn("place", place("grp", "start", "slice")).filter(F.col("place") <= k)
    first = ahead.withColumn("place", place("grp", "start")).filter(F.col("place") <= k)
    found: dict[tuple[str, int], list] = {}
    for r in first.select("grp", "start", "x").orderBy("grp", "start", "place").collect():  # k rows a group and start
        found.setdefault((r["grp"], r["start"]), []).append(r["x"])
    return {key: np.array(x) for key, x in found.items()}


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each point and its squared distance."""
    square = np.zeros((len(x), len(centres)))
    for axis in range(x.shape[1]):  # no array of rows by centres by coordinates
        square += (x[:, axis, None] - centres[:, axis]) ** 2
    cell = square.argmin(axis=1)
    return cell, square[np.arange(len(x)), cell]


def _by_group(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Rows and points of each group of a batch."""
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
    codes, groups = pd.factorize(batch.column("grp").to_pandas())
    for i, group in enumerate(groups):
        rows = np.flatnonzero(codes == i)
        yield group, rows, x[rows]


def _round(centres: Centres):
    starts: dict[str, list[int]] = {}
    for group, start in centres:
        starts.setdefault(group, []).append(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int, int], list] = {}
        for batch in batches:
            for group, _, x in _by_group(batch) if len(batch) else ():
                for start in starts.get(group, ()):
                    cell, square = nearest(x, centres[group, start])
                    for c in np.unique(cell):
                        at = np.flatnonzero(cell == c)
                        far = at[square[at].argmax()]
                        new = [len(at), x[at].sum(axis=0), square[at].sum(), square[far], x[far]]
                        old = held.get((group, start, int(c)))
                        if old:
                            new = [a + b for a, b in zip(old[:3], new[:3])] + (old if old[3] >= new[3] else new)[3:]
                        held[group, start, int(c)] = new
        if held:
            columns = [*zip(*held), *zip(*held.values())]
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=[c.split()[0] for c in _SUMS.split(", ")])

    return run


def _moved(points: DataFrame, centres: Centres) -> tuple[Centres, dict[tuple[str, int], float]]:
    """The centres after a round, and what the old ones cost."""
    parts = points.mapInArrow(_round(centres), _SUMS)
    width = len(next(iter(centres.values()))[0])
    whole = parts.groupBy("grp", "start", "cell").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.element_at("total", i + 1)) for i in range(width)]).alias("total"), F.sum("cost").alias("cost"), F.max(F.struct("far", "far_point")).alias("far"))
    new, cost, far = {key: [None] * len(c) for key, c in centres.items()}, dict.fromkeys(centres, 0.0), {}
    for r in whole.collect():  # a row a cell
        key = r["grp"], r["start"]
        new[key][r["cell"]] = np.array(r["total"]) / r["n"]
        cost[key] += r["cost"]
        far[key] = max(far.get(key, (-1.0, [])), (r["far"]["far"], r["far"]["far_point"]))
    for key, cells in new.items():
        taken = False
        for i, c in enumerate(cells):
            if c is None:
                cells[i] = np.array(far[key][1]) if far[key][0] > 0 and not taken else centres[key][i]
                taken = True
    return {key: np.array(cells) for key, cells in new.items()}, cost


def grouped_kmeans(
    points: DataFrame, k: int, seed: int = 42, starts: int = 10, max_rounds: int = 100, owner: str | None = None, begin: Centres | None = None,
) -> tuple[DataFrame, dict[str, tuple[int, float]]]:
    """``(row_id, grp, cell)`` of every point by its group's cheapest start, and each group's (start, cost).

    ``points`` has ``row_id``, ``grp`` (string) and ``x`` (coordinates). ``begin`` gives other first centres.
    """
    usable = points.filter(F.col("grp").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull()))
    # a row is a few dozen bytes but meets every start's centres each round: by size all would land in a task or two
    rows = materialize(usable.repartition(points.sparkSession.sparkContext.defaultParallelism, "row_id").sortWithinPartitions("grp"), owner)
    centres = first_centres(rows, k, seed, starts) if begin is None else begin
    cost: dict[tuple[str, int], float] = {}
    active = dict(centres)
    for _ in range(max_rounds):
        if not active:
            break
        moved, spent = _moved(rows, active)
        cost |= spent
        settled = {key for key in active if np.abs(moved[key] - active[key]).max() <= _SETTLED}
        centres |= moved
        active = {key: c for key, c in moved.items() if key not in settled}
    if active:
        cost |= _moved(rows, active)[1]
    best: dict[str, tuple[int, float]] = {}
    for (group, start), spent in sorted(cost.items()):
        if group not in best or spent < best[group][1] * (1 - 1e-12):
            best[group] = start, spent
    final = {group: centres[group, start] for group, (start, _) in best.items()}

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.zeros(len(batch), np.int32)
            for group, at, x in _by_group(batch) if len(batch) else ():
                cells[at] = nearest(x, final[group])[0]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("grp"), pa.array(cells)], names=["row_id", "grp", "cell"])

    kind = rows.schema["row_id"].dataType.simpleString()
    return rows.select("row_id", "grp", "x").mapInArrow(assigned, f"row_id {kind}, grp string, cell int"), best
