"""Ordered sums and exact quantiles that never sort one key in one task.

A key may hold a third of all rows, so its rows are cut into value ranges:
running sums are taken inside each range and shifted by the totals of the
ranges below. The range edges are approximate quantiles of the whole column;
they affect only the balance of the work, never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from occgraph.session import materialize

_STEP = 32
RANGES = _STEP * _STEP


def join_on_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a null key equals a null key, as in a grouping."""
    if not keys:
        return left.join(right, how=how)
    renamed = right.withColumnsRenamed({k: f"right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"right_{k}")) for k in keys])
    return left.join(renamed, same, how).drop(*[f"right_{k}" for k in keys])


def _range_number(value: Column, edges: Column, coarse: Column) -> Column:
    """Number of edges below ``value``: a coarse then a fine search."""
    block = F.size(F.filter(coarse, lambda e: e < value))
    fine = F.size(F.filter(F.slice(edges, block * _STEP + 1, F.lit(_STEP)), lambda e: e < value))
    return block * _STEP + fine


def with_range(df: DataFrame, value: str, name: str = "value_range", edges_from: DataFrame | None = None) -> DataFrame:
    """Add the range number of ``value``; equal values share a range.

    ``edges_from`` is a smaller table with the same spread of values, for use
    when ``df`` holds many weighted copies of it.
    """
    probs = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    edges = (df if edges_from is None else edges_from).agg(F.percentile_approx(F.col(value).cast("double"), probs, F.lit(10000)).alias("edges")).select(
        "edges", F.transform(F.sequence(F.lit(_STEP), F.lit(RANGES - 1), F.lit(_STEP)), lambda i: F.element_at("edges", i)).alias("coarse")
    )
    numbered = df.join(F.broadcast(edges))  # one row of fixed size
    return numbered.withColumn(
        name, _range_number(F.col(value).cast("double"), F.col("edges"), F.col("coarse"))
    ).drop("edges", "coarse")


def running_totals(
    df: DataFrame, keys: list[str], order_by: str, sums: list[str], edges_from: DataFrame | None = None
) -> DataFrame:
    """Per key, add ``<c>_below`` (sum over smaller values) and ``<c>_total``.

    ``df`` must hold one row per (key, order_by); aggregate first.
    """
    if edges_from is None:
        # the collapsed table is read for its edges and again for the sums:
        # write it once instead of aggregating the raw rows twice
        df = materialize(df)
    ranged = with_range(df, order_by, edges_from=edges_from)
    inside = W.partitionBy(*keys, "value_range").orderBy(order_by).rowsBetween(W.unboundedPreceding, -1)
    across = W.partitionBy(*keys).orderBy("value_range").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "value_range").agg(*[F.sum(c).alias(f"{c}_range") for c in sums])
    shifts = totals.select(  # at most RANGES rows per key
        *keys, "value_range",
        *[F.coalesce(F.sum(f"{c}_range").over(across), F.lit(0)).alias(f"{c}_shift") for c in sums],
        *[F.sum(f"{c}_range").over(everything).alias(f"{c}_total") for c in sums],
    )
    local = ranged.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"{c}_local") for c in sums])
    joined = join_on_keys(local, shifts, [*keys, "value_range"])
    return joined.select(
        *df.columns,
        *[(F.col(f"{c}_local") + F.col(f"{c}_shift")).alias(f"{c}_below") for c in sums],
        *[f"{c}_total" for c in sums],
    )


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, keys) if keys else (df.withColumn("all_rows", F.lit(0)), ["all_rows"])


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles per key; nulls are left out."""
    df, by = _keyed(df, keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running_totals(counts, by, value, ["n"])

    def at(position: Column) -> Column:
        hit = (F.col("n_below") <= position) & (position < F.col("n_below") + F.col("n"))
        return F.max(F.when(hit, F.col(value).cast("double")))

    picks = []
    for name, p in probs.items():
        place = (F.col("n_total") - 1) * F.lit(float(p))
        picks += [
            at(F.floor(place)).alias(f"{name}_lo"),
            at(F.ceil(place)).alias(f"{name}_hi"),
            F.max(place - F.floor(place)).alias(f"{name}_part"),
        ]
    found = ranked.groupBy(*by).agg(*picks)
    return found.select(
        *keys,
        *[
            (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_part")).alias(n)
            for n in probs
        ],
    )


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact medians of several columns as driver scalars, in one job."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("f")).select("f.field", "f.value")
    found = {r["field"]: r["mid"] for r in grouped_quantiles(long, ["field"], "value", {"mid": 0.5}).collect()}
    return {c: found.get(c) for c in columns}


def average_ranks(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Add the 1-based rank with ties averaged, and ``<name>_n`` rows ranked."""
    work, by = _keyed(df, keys)
    counts = work.groupBy(*by, value).agg(F.count("*").alias("n"))
    ranked = running_totals(counts, by, value, ["n"]).select(
        *by, value, (F.col("n_below") + (F.col("n") + 1) / 2).alias(name), F.col("n_total").alias(f"{name}_n")
    )
    return join_on_keys(work, ranked, [*by, value]).select(*df.columns, name, f"{name}_n")
