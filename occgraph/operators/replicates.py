"""Bootstrap replicates of a metric as arrays of weights, carried along sorted scores.

A row's weights in all replicates are one array, made where the row is from
its id or its cluster. Arrays add up: by key for Brier and F1, by score range
and key for the rank metrics. No row is written out once a replicate, however
many replicates or clusters there are.

ROC AUC needs one pass: a range's wins over its own negatives, and its positives
times the negatives of the ranges below. Average precision takes a second one,
since the precision at a score depends on all that is above: the ranges' sums are
added from the top, and each range starts from what is above it.

Rows are dealt anew before their draws are made, ``RANGE_ROWS`` to a task as far
as ``RANGES`` tasks go, since the draws cost far more than reading does. Runs of
at least ``TIES`` rows with one score and truth are added up first, in ``SALTS``
parts: however many rows share a score, they are drawn once, by several tasks. A
task holds a few arrays, never a range's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occgraph.functions.hashing import md5_words, poisson_weights
from occgraph.operators.ranking import RANGES, with_range
from occgraph.session import materialize

SALTS = 32
RANGE_ROWS = 5000
TIES = 256  # rows whose ids and keys are about as long as an array of weights
CELLS = 8_000_000  # weights of all clusters that travel with a task
HASHES = 16384  # made together: their words stay in a core's cache
#: ids -> one row of weights an id
Weights = Callable[[list], np.ndarray]


def row_draws(ids: list[str], seed: int, replicates: int) -> np.ndarray:
    """Poisson(1) weights, a row an id: four draws from each MD5 of ``boot|seed|block|id``, by inversion.

    Hashes of equally long texts are made together, about ``HASHES`` at a time.
    """
    prefixes = [f"boot|{seed}|{k}|".encode() for k in range(-(-replicates // 4))]
    texts: dict[int, list[tuple[int, bytes]]] = {}
    for i, name in enumerate(ids):
        text = name.encode()
        texts.setdefault(len(text), []).append((i, text))
    weights = np.empty((len(ids), len(prefixes), 4), np.uint8)
    for same in texts.values():
        for at in range(0, len(same), HASHES):
            rows, names = zip(*same[at : at + HASHES])
            step = max(1, HASHES // len(rows))
            for _, heads in groupby(range(len(prefixes)), lambda k: len(prefixes[k])):
                heads = list(heads)
                for first in range(0, len(heads), step):
                    part = heads[first : first + step]
                    drawn = poisson_weights(md5_words([prefixes[k] for k in part], list(names)))
                    weights[np.array(rows), part[0] : part[-1] + 1] = drawn.transpose(1, 0, 2)
    return weights.reshape(len(ids), -1)[:, :replicates]


def cluster_blocks(draws: DataFrame, cluster: str, replicates: int) -> Iterator[tuple[int, int, Weights]]:
    """(first replicate, replicates, weights by cluster): as many at a time as ``CELLS`` weights allow, for any number of clusters.

    ``draws``: ``rep``, the cluster and ``w``, a row a cluster drawn.
    """
    clusters = draws.select(cluster).distinct().count()
    step = max(1, CELLS // max(clusters, 1))
    for first in range(0, replicates, step):
        n = min(step, replicates - first)
        found: dict = {}
        for r in draws.filter(F.col("rep").between(first, first + n - 1)).select("rep", cluster, "w").toLocalIterator():
            found.setdefault(r[1], np.zeros(n))[r[0] - first] = r[2]
        none = np.zeros(n)
        yield first, n, lambda ids, found=found, none=none: np.stack([found.get(i, none) for i in ids])


def _kinds(rows: DataFrame, names: list[str]) -> list[str]:
    return [f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names]


def _keyed(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (rows, keys) if keys else (rows.withColumn("all_rows", F.lit(0)), ["all_rows"])


def _tasks(n_rows: int) -> int:
    return max(1, min(RANGES, n_rows // RANGE_ROWS))


def _added(by: list[str], sums: list[str], first: list[str]):
    """Arrays of a group added up."""
    def add(rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[[*by, *first]].head(1).copy()
        for c in sums:
            out[c] = [np.sum(np.stack(rows[c].to_list()), axis=0)]
        return out[[*by, *first, *sums]]

    return add


def _plain_sums(rows: DataFrame, by: list[str], metric: str, n: int, weights: Weights) -> DataFrame:
    """``(*by, value)`` for Brier and F1: arrays of the metric's sums by key."""
    sums = ["a", "b", "c"]

    def terms(part: pd.DataFrame) -> np.ndarray:
        y = part["truth"].to_numpy()
        if metric == "brier":
            return np.stack([(part["score"].to_numpy() - y) ** 2, np.ones(len(y)), np.zeros(len(y))])
        called = part["called"].to_numpy()
        return np.stack([(y == 1) & (called == 1), (y == 0) & (called == 1), (y == 1) & (called == 0)]).astype(float)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def written() -> pd.DataFrame:
            salt = TaskContext.get().partitionId() % SALTS
            out = pd.DataFrame([(*k, salt, *[x.tolist() for x in v]) for k, v in held.items()], columns=[*by, "salt", *sums])
            held.clear()
            return out

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                w = weights(part["id"].tolist()) * part["n"].to_numpy()[:, None]
                t = terms(part)
                numbers, keys = pd.factorize(pd.MultiIndex.from_frame(part[by]) if len(by) > 1 else part[by[0]], use_na_sentinel=False)
                for i, key in enumerate(keys):
                    mine = numbers == i
                    key = key if isinstance(key, tuple) else (key,)
                    held[key] = held.get(key, 0) + np.einsum("tr,rn->tn", t[:, mine], w[mine].astype(float))  # no threads beside the other tasks'
            if len(held) * 3 * n > CELLS:
                yield written()
        if held:
            yield written()

    kinds = _kinds(rows, by)
    arrays = [f"{c} array<double>" for c in sums]
    dealt = rows.repartition(_tasks(rows.count()), *by, "id", "score", "truth", "called")
    parts = dealt.mapInPandas(summed, ", ".join([*kinds, "salt int", *arrays]))
    salted = parts.groupBy(*by, "salt").applyInPandas(_added(by, sums, ["salt"]), ", ".join([*kinds, "salt int", *arrays]))
    whole = salted.groupBy(*by).applyInPandas(_added(by, sums, []), ", ".join([*kinds, *arrays]))
    at = lambda c, i: F.element_at(c, i + 1)
    if metric == "brier":
        value = F.transform("a", lambda x, i: F.try_divide(x, at("b", i)))
    else:  # 0 where nothing is true or called, as in the point metric
        value = F.transform("a", lambda x, i: F.coalesce(F.try_divide(2 * x, 2 * x + at("b", i) + at("c", i)), F.lit(0.0)))
    return whole.select(*by, value.alias("value"))


def _ties_added(ranged: DataFrame, by: list[str], n: int, weights: Weights, tasks: int) -> DataFrame:
    """``ranged`` with ``added``: runs of rows that share a score and a truth become one row without an id, holding their weights' sums."""
    schema = ranged.withColumn("added", F.lit(None).cast("array<double>")).schema
    salted = ranged.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    order = [*by, "value_range", "salt"]
    sorted_rows = salted.repartition(tasks, *order).sortWithinPartitions(*order, "score", "truth").drop("salt")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = batch.select([*by, "value_range", "score", "truth"]).to_pandas()
            starts = np.flatnonzero((same != same.shift()).any(axis=1).to_numpy())
            sizes = np.diff([*starts, len(same)])
            long = sizes >= TIES
            ids, times = batch.column("id"), batch.column("n").to_numpy(zero_copy_only=False).astype(float)
            sums = np.zeros((int(long.sum()), n))
            for total, start, size in zip(sums, starts[long], sizes[long]):
                for at in range(start, start + size, TIES):
                    part = slice(at, min(at + TIES, start + size))
                    total += (times[part][:, None] * weights(ids[part].to_pylist())).sum(axis=0)
            kept = batch.filter(pa.array(np.repeat(~long, sizes)))
            yield kept.append_column("added", pa.nulls(len(kept), pa.list_(pa.float64())))
            if len(sums):
                one = batch.take(pa.array(starts[long]))
                one = one.set_column(one.schema.get_field_index("id"), one.schema.field("id").with_nullable(True), pa.nulls(len(one), ids.type))
                values = pa.ListArray.from_arrays(np.arange(0, sums.size + 1, n, dtype=np.int32), pa.array(sums.ravel()))
                yield one.append_column("added", values)

    for field in schema:
        field.nullable = True
    return sorted_rows.mapInArrow(add, schema)


def _steps(batches: Iterator[pd.DataFrame], by: list[str], n: int, weights: Weights) -> Iterator[tuple]:
    """(key, score, weights of its positives, of its negatives) for each distinct score in order; before a key's first, its ``above`` if there is one."""
    now = p = q = None
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            rows = part["id"].notna().to_numpy()
            w = np.zeros((len(part), n))
            tied = part["added"].notna().to_numpy()
            if tied.any():
                w[tied] = np.stack(part["added"][tied].to_list())
            if rows.any():
                w[rows] = weights(part["id"][rows].tolist()) * part["n"].to_numpy()[rows][:, None]
            above = part["above"].tolist() if "above" in part else [None] * len(part)
            for own, score, truth, is_row, start, x in zip(part[[*by, "value_range"]].itertuples(index=False, name=None), part["score"], part["truth"], rows | tied, above, w):
                if not is_row:
                    if now is not None:
                        yield *now, p, q
                        now = None
                    yield own, None, np.array(start[:n]), np.array(start[n:])
                    continue
                if (own, score) != now:
                    if now is not None:
                        yield *now, p, q
                    now, p, q = (own, score), np.zeros(n), np.zeros(n)
                if truth:
                    p += x
                else:
                    q += x
    if now is not None:
        yield *now, p, q


def _ranks(rows: DataFrame, by: list[str], metric: str, n: int, weights: Weights) -> DataFrame:
    """``(*by, value)`` for ROC AUC and average precision."""
    # a range is a task's stretch of work: as many as the rows need, at most those of ``ranking``
    rows = materialize(rows)
    n_rows = rows.count()
    wide, tasks = max(1, RANGES // max(8, n_rows // RANGE_ROWS)), _tasks(n_rows)
    ranged = with_range(rows, "score").withColumn("value_range", F.expr(f"value_range div {wide}").cast("int"))
    ranged = _ties_added(ranged, by, n, weights, tasks)
    if metric != "roc_auc":  # read twice
        ranged = materialize(ranged)
    kinds = _kinds(ranged, by)
    ordered = ranged.repartition(tasks, *by, "value_range").sortWithinPartitions(*by, "value_range", "score")
    sums = ["tp", "tn", "wins"]

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = tp = tn = wins = None
        for own, _, p, q in _steps(batches, by, n, weights):
            if own != key:
                if key is not None:
                    yield pd.DataFrame([(*key, tp, tn, wins)], columns=[*by, "value_range", *sums])
                key, tp, tn, wins = own, np.zeros(n), np.zeros(n), np.zeros(n)
            wins = wins + p * (tn + q / 2)
            tp, tn = tp + p, tn + q
        if key is not None:
            yield pd.DataFrame([(*key, tp, tn, wins)], columns=[*by, "value_range", *sums])

    ranges = ordered.mapInPandas(inside, ", ".join([*kinds, "value_range int", *[f"{c} array<double>" for c in sums]]))

    def auc(group: pd.DataFrame) -> pd.DataFrame:  # at most as many rows as there are ranges
        group = group.sort_values("value_range")
        tp, tn, wins = (np.stack(group[c].to_list()) for c in sums)
        pairs = tp.sum(axis=0) * tn.sum(axis=0)
        below = np.cumsum(tn, axis=0) - tn
        out = group[by].head(1).copy()
        out["value"] = [np.where(pairs > 0, (wins + tp * below).sum(axis=0) / np.where(pairs > 0, pairs, 1), np.nan)]
        return out

    if metric == "roc_auc":
        return ranges.groupBy(*by).applyInPandas(auc, ", ".join([*kinds, "value array<double>"]))

    def from_top(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("value_range")
        out = group[[*by, "value_range"]].copy()
        over = [np.cumsum(x[::-1], axis=0)[::-1] - x for x in (np.stack(group["tp"].to_list()), np.stack(group["tn"].to_list()))]
        out["above"] = list(np.hstack(over))
        return out

    above = ranges.groupBy(*by).applyInPandas(from_top, ", ".join([*kinds, "value_range int", "above array<double>"]))
    both = ranged.withColumn("above", F.lit(None).cast("array<double>")).unionByName(above, allowMissingColumns=True)
    falling = both.repartition(tasks, *by, "value_range").sortWithinPartitions(*by, "value_range", F.col("above").isNull(), F.desc("score"))

    def precise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = tp = fp = own = value = None
        for now, score, p, q in _steps(batches, by, n, weights):
            if score is None:
                if key is not None:
                    yield pd.DataFrame([(*key, *own, value)], columns=[*by, "value_range", "a", "b", "c"])
                key, tp, fp, own, value = now, p, q, np.zeros((2, n)), np.zeros(n)
                continue
            tp, fp, own = tp + p, fp + q, own + [p, q]
            value = value + p * np.divide(tp, tp + fp, out=np.zeros(n), where=tp + fp > 0)
        if key is not None:
            yield pd.DataFrame([(*key, *own, value)], columns=[*by, "value_range", "a", "b", "c"])

    arrays = [f"{c} array<double>" for c in "abc"]
    parts = falling.mapInPandas(precise, ", ".join([*kinds, "value_range int", *arrays]))
    whole = parts.groupBy(*by).applyInPandas(_added(by, ["a", "b", "c"], []), ", ".join([*kinds, *arrays]))
    both_classes = lambda i: (F.element_at("a", i + 1) > 0) & (F.element_at("b", i + 1) > 0)
    return whole.select(*by, F.transform("c", lambda x, i: F.when(both_classes(i), F.try_divide(x, F.element_at("a", i + 1)))).alias("value"))


def replicate_values(rows: DataFrame, keys: list[str], metric: str, n: int, weights: Weights, first: int = 0) -> DataFrame:
    """``(*keys, rep, <metric>)`` of ``n`` replicates, numbered from ``first``; null where a replicate has no value.

    ``rows``: keys, ``score``, ``truth``, ``called`` (for F1), ``id`` (what
    ``weights`` is asked for) and ``n`` (rows that it stands for).
    """
    given, by = _keyed(rows, keys)
    found = (_ranks if metric in ("roc_auc", "pr_auc") else _plain_sums)(given, by, metric, n, weights)
    value = F.nanvl(F.col("col"), F.lit(None).cast("double"))
    return found.select(*by, F.posexplode("value").alias("pos", "col")).select(*keys, (F.col("pos") + first).alias("rep"), value.alias(metric))
