"""Nearest neighbours by a hash-prefix forest.

A vector has one long bit string a tree: the signs of random projections
around the sample's mean. A tree is the sorted array of its strings, so the
vectors that share a prefix are a range of it, found by binary search. A query
descends to its longest matching prefixes, and then ascends in all trees at
the same time, one bit a step, taking in the ranges' new vectors, which are
compared exactly. It stops when a vector as near as its k-th nearest so far
would have been found at this depth with probability ``SURE``: at once where
neighbours are close, later where they are far.

Vectors are dealt to blocks by hash, each with a forest of its own; the query
set meets the blocks in cells of bounded size. Equal vectors are one point
with their ``k + 1`` smallest ids, which is all that an answer can need.

Defined cases: vectors that are null, zero or empty, or hold null or
non-finite components, take no part; only vectors of equal length are
compared; a repeated (id, vector) row is one candidate. Ties go to the smaller
id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from occgraph.session import materialize

TREES = 48
BITS = 32
SURE = 0.97
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 8192, 1 << 17, 512
QUERIES = 2048
SAMPLE = 4096


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Forest:
    """The sorted arrays of one block's strings."""

    def __init__(self, points: np.ndarray, mean: np.ndarray, trees: int = TREES, bits: int = BITS):
        self.points, self.mean, self.trees, self.bits = points, mean, trees, bits
        self.planes = np.random.default_rng(points.shape[1]).standard_normal((trees, points.shape[1], bits))
        self.order = np.empty((trees, len(points)), np.int32)
        self.strings = np.empty((trees, len(points)), np.uint64)
        for t in range(trees):
            own = self.strings_of(points, t)
            self.order[t] = np.argsort(own, kind="stable")
            self.strings[t] = own[self.order[t]]

    def strings_of(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        weights = np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64)
        out = np.empty(len(vectors), np.uint64)
        for i in range(0, len(vectors), 8192):
            out[i : i + 8192] = ((vectors[i : i + 8192] - self.mean) @ self.planes[tree] > 0) @ weights
        return out

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree, prefix length 0..bits and query, the range of points that share the prefix."""
        low = np.empty((self.trees, self.bits + 1, len(queries)), np.int32)
        high = np.empty_like(low)
        for t in range(self.trees):
            own = self.strings_of(queries, t)
            for x in range(self.bits + 1):
                rest = np.uint64((1 << (self.bits - x)) - 1)
                low[t, x] = np.searchsorted(self.strings[t], own & ~rest, "left")
                high[t, x] = np.searchsorted(self.strings[t], own | rest, "right")
        return low, high

    def nearest(self, queries: np.ndarray, k: int, sure: float = SURE) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query, points in order of distance: at least the ``k + 1`` nearest found (or all there are), with ties."""
        low, high = self.ranges(queries)
        centred = self.points - self.mean
        norms = np.linalg.norm(centred, axis=1)
        found = []
        for q, query in enumerate(queries):
            seen = np.zeros(len(self.points), bool)
            ids, distances = np.zeros(0, np.int64), np.zeros(0)
            own = query - self.mean
            own_norm = np.linalg.norm(own)
            before_low = before_high = None
            for x in range(self.bits, -1, -1):
                lo, hi = low[:, x, q], high[:, x, q]
                parts = []
                for t in np.flatnonzero(hi - lo > (0 if before_low is None else before_high - before_low)):
                    if before_low is None:
                        parts.append(self.order[t, lo[t] : hi[t]])
                    else:
                        parts += [self.order[t, lo[t] : before_low[t]], self.order[t, before_high[t] : hi[t]]]
                before_low, before_high = lo, hi
                if parts:
                    some = np.unique(np.concatenate(parts))
                    some = some[~seen[some]]
                    seen[some] = True
                    away = self.points[some] - query
                    ids = np.concatenate([ids, some])
                    distances = np.concatenate([distances, np.sqrt((away * away).sum(axis=1))])
                    if len(ids) > 4 * k + 64:
                        limit = np.partition(distances, k)[k]
                        ids, distances = ids[distances <= limit], distances[distances <= limit]
                if len(ids) > k:
                    kth = np.argpartition(distances, k)[k]
                    far = ids[kth]
                    cosine = centred[far] @ own / max(norms[far] * own_norm, 1e-300)
                    agree = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
                    if 1 - (1 - agree**x) ** self.trees >= sure:
                        break
            order = np.argsort(distances, kind="stable")
            found.append((ids[order], distances[order]))
        return found


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", owner: str = "forest") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean): the ``k`` nearest found of each query row, itself left out.

    ``is_query`` is a condition on ``vec_id``.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")).filter(
        "vec_id IS NOT NULL").filter(usable(F.col("vector"))).withColumn("size", F.size("vector"))
    rows = materialize(rows.withColumn("h", F.xxhash64("vector")).distinct(), owner)
    by_id = W.partitionBy("size", "h", "vector").orderBy("vec_id")
    points = rows.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k + 1).groupBy("size", "h", "vector").agg(
        F.sort_array(F.collect_list("vec_id")).alias("ids"))
    points = materialize(points, owner)
    queries = rows.filter(is_query)
    sizes = points.groupBy("size").agg(F.count("*").alias("n"))
    asked = queries.groupBy("size").agg(F.count("*").alias("m"))
    block = F.least(F.lit(float(MOST_BLOCK)), F.greatest(F.lit(float(LEAST_BLOCK)), F.col("n") / BLOCKS))
    plan = sizes.join(asked, "size").select("size", F.ceil(F.col("n") / block).alias("blocks"), F.ceil(F.col("m") / QUERIES).alias("chunks"))
    plan = materialize(plan, owner)  # one row a vector length
    sample = points.orderBy("h").limit(SAMPLE).select("size", "vector")
    means = sample.groupBy("size").agg(F.collect_list("vector").alias("sample"))
    means = means.select("size", F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda i: F.aggregate(
        "sample", F.lit(0.0), lambda acc, v: acc + F.get(v, i)) / F.size("sample")).alias("mean"))
    left = points.join(F.broadcast(plan), "size").join(F.broadcast(means), "size", "left").select(
        "size", F.pmod("h", "blocks").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "ids", "vector", "mean")
    right = queries.join(F.broadcast(plan), "size").select(
        "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("vec_id"), "chunks").alias("chunk"), "vec_id", "vector")
    cell = ["size", "block", "chunk"]

    def met(candidates: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, float]] = []
        if len(candidates) and len(asking):
            vectors = np.stack(candidates["vector"].to_list()).astype(np.float64)
            mean = candidates["mean"].iloc[0]
            forest = Forest(vectors, np.zeros(vectors.shape[1]) if mean is None else np.asarray(mean, np.float64))
            members = candidates["ids"].to_list()
            for one, (ids, distances) in zip(asking["vec_id"], forest.nearest(np.stack(asking["vector"].to_list()).astype(np.float64), k), strict=True):
                own = [(float(d), int(m)) for i, d in zip(ids, distances, strict=True) for m in members[i] if m != one]
                out += [(int(one), m, d) for d, m in sorted(own)[:k]]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    best = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(met, "query_id long, vec_id long, score double")
    ranked = best.distinct().withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
