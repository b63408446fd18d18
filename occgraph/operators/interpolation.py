"""Spatial interpolation: inverse-distance neighbours and local kriging."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occgraph.operators.knn import knn_graph_pairs, knn_join
from occgraph.session import materialize


def inverse_distance(queries: DataFrame, pool: DataFrame, k: int = 15, value: str = "label") -> DataFrame:
    """Distance-weighted mean of the neighbours' values, clipped to [0, 1];
    neighbours at the same spot take all the weight."""
    near = knn_join(queries, pool, k).join(pool.select(F.col("row_id").alias("dst"), F.col(value).cast("double").alias("y")), "dst")
    hit = F.col("dist_km") == 0
    exact = F.avg(F.when(hit, F.col("y")))
    weighted = F.sum(F.when(~hit, F.col("y") / F.col("dist_km"))) / F.sum(F.when(~hit, 1 / F.col("dist_km")))
    return near.groupBy(F.col("src").alias("row_id")).agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(exact, weighted))).alias("y_prob"))


def semivariogram(pool: DataFrame, k: int = 15, bins: int = 12, value: str = "label") -> DataFrame:
    """Mean distance and semivariance of neighbour pairs per distance bin."""
    ends = lambda n: pool.select(F.col("row_id").alias(n), F.col(value).cast("double").alias(f"y_{n}"))
    pairs = knn_graph_pairs(pool, k).join(ends("src"), "src").join(ends("dst"), "dst")
    pairs = materialize(pairs.select("dist_km", (F.pow(F.col("y_src") - F.col("y_dst"), F.lit(2.0)) / 2).alias("half_square")))
    widest = F.broadcast(pairs.agg(F.max("dist_km").alias("widest")))  # one row
    number = F.least(F.floor(F.col("dist_km") / F.col("widest") * bins), F.lit(bins - 1)).cast("int")
    return pairs.join(widest).groupBy(number.alias("bin")).agg(
        F.count("*").alias("n_pairs"), F.avg("dist_km").alias("mean_km"), F.avg("half_square").alias("semivariance"))


def linear_variogram(bins: DataFrame) -> DataFrame:
    """Least-squares line through the bins: one row ``(slope, nugget)``."""
    return bins.agg(F.regr_slope("semivariance", "mean_km").alias("slope"), F.regr_intercept("semivariance", "mean_km").alias("nugget"))


def local_kriging(queries: DataFrame, pool: DataFrame, slope: float, nugget: float, k: int = 15, value: str = "label") -> DataFrame:
    """Ordinary kriging of each query over its ``k`` neighbours, clipped to [0, 1].

    The neighbour join is distributed; every task then solves small systems of
    at most ``k + 1`` unknowns, a whole Arrow batch at a time.
    """
    slope, nugget = max(float(slope), 1e-12), max(float(nugget), 0.0)
    site = pool.select(F.col("row_id").alias("dst"), F.radians("lat").alias("p"), F.radians("lon").alias("q"), F.col(value).cast("double").alias("y"))
    near = knn_join(queries, pool, k).join(site, "dst").groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("rn", "dist_km", "p", "q", "y"))).alias("n")
    ).select(F.col("src").alias("row_id"), *[F.col(f"n.{c}").alias(c) for c in ("dist_km", "p", "q", "y")])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.zeros(len(pdf))
            for size, rows in pdf.groupby(pdf["y"].map(len)).indices.items():
                d, p, q, y = (np.stack(pdf[c].to_numpy()[rows]) for c in ("dist_km", "p", "q", "y"))
                a = np.sin((p[:, :, None] - p[:, None]) / 2) ** 2 + np.cos(p[:, :, None]) * np.cos(p[:, None]) * np.sin((q[:, :, None] - q[:, None]) / 2) ** 2
                between = 2 * 6371.0 * np.arcsin(np.sqrt(np.clip(a, 0, 1)))
                gamma = lambda h: np.where(h > 0, nugget + slope * h, 0.0)
                system = np.ones((len(rows), size + 1, size + 1))
                system[:, :size, :size] = gamma(between)
                system[:, size, size] = 0.0
                right = np.ones((len(rows), size + 1, 1))
                right[:, :size, 0] = gamma(d)
                weights = (np.linalg.pinv(system) @ right)[:, :size, 0]
                out[rows] = (weights * y).sum(axis=1)
            yield pd.DataFrame({"row_id": pdf["row_id"], "y_prob": np.clip(out, 0.0, 1.0)})

    return near.mapInPandas(solve, "row_id bigint, y_prob double")
