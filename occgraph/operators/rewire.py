"""Degree-preserving random rewiring of an undirected simple graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from occgraph.functions.hashing import hash_order, hash_uniform
from occgraph.operators.splits import hash_rank
from occgraph.session import materialize


def undirected(edges: DataFrame) -> DataFrame:
    """One row ``(a, b, weight)`` per linked pair, ``a < b``."""
    return edges.filter("src < dst").groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.max("weight").alias("weight"))


def rewire(edges: DataFrame, seed: int = 42, swaps_per_edge: int = 2, idle_rounds: int = 3) -> DataFrame:
    """Swap edge ends in parallel rounds until enough are swapped, then shuffle the weights.

    Each round pairs all edges by hash and proposes (a,b),(c,d) -> (a,d),(c,b).
    A pair keeps its edges when a new edge would be a loop, exists already, or
    is proposed twice. Every node keeps its degree. Raises when
    ``idle_rounds`` rounds in a row find nothing to swap before the swaps asked
    for are done: the graph can't be rewired that far.
    """
    start = materialize(undirected(edges))
    current, n_edges, done, idle, r = start.select("a", "b"), start.count(), 0, 0, -1
    while done < swaps_per_edge * n_edges:
        r += 1
        turn = hash_uniform(F.lit("turn"), F.lit(seed), F.lit(r), F.col("a"), F.col("b")) < 0.5
        ranked = hash_rank(current, [], hash_order(F.lit(seed), F.lit(r), F.col("a"), F.col("b")), tie="a")
        ends = ranked.select(
            F.expr("(place - 1) div 2").alias("pair"), ((F.col("place") - 1) % 2).alias("side"),
            F.when(turn, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("v"))
        pick = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
        pairs = materialize(ends.groupBy("pair").agg(
            pick("u", 0).alias("u0"), pick("v", 0).alias("v0"), pick("u", 1).alias("u1"), pick("v", 1).alias("v1")))
        low, high = (lambda x, y: F.least(x, y)), (lambda x, y: F.greatest(x, y))
        new = pairs.select("pair", F.explode(F.array(
            F.struct(low("u0", "v1").alias("a"), high("u0", "v1").alias("b")), F.struct(low("u1", "v0").alias("a"), high("u1", "v0").alias("b")))).alias("e")).select("pair", "e.*")
        loops = pairs.filter(F.col("u1").isNull() | (F.col("u0") == F.col("v1")) | (F.col("u1") == F.col("v0"))).select("pair")
        existing = new.join(current, ["a", "b"], "left_semi").select("pair")
        twice = new.join(new.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1"), ["a", "b"], "left_semi").select("pair")
        bad = loops.unionAll(existing).unionAll(twice).distinct()
        good = pairs.select("pair").join(bad, "pair", "left_anti")
        kept_pairs = pairs.join(bad, "pair", "left_semi")
        kept = kept_pairs.select(F.explode(F.array(
            F.struct(low("u0", "v0").alias("a"), high("u0", "v0").alias("b")), F.struct(low("u1", "v1").alias("a"), high("u1", "v1").alias("b")))).alias("e")).select("e.*").filter("a IS NOT NULL")
        swapped = new.join(good, "pair", "left_semi").select("a", "b", F.lit(True).alias("moved"))
        result = materialize(swapped.unionByName(kept.withColumn("moved", F.lit(False))))
        swapped_now = result.filter("moved").count() // 2
        done, idle = done + swapped_now, 0 if swapped_now else idle + 1
        if idle == idle_rounds:
            raise ValueError(f"only {done} of {swaps_per_edge * n_edges} swaps are possible")
        current = result.select("a", "b")
    slots = hash_rank(current, [], hash_order(F.lit("slot"), F.lit(seed), F.col("a"), F.col("b")), tie="a").select("a", "b", "place")
    weights = hash_rank(start, [], hash_order(F.lit("weight"), F.lit(seed), F.col("a"), F.col("b")), tie="a").select("weight", "place")
    return slots.join(weights, "place").select("a", "b", "weight")


def rewiring_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: links, links that changed, and whether the weights are the same ones. Both sides hold ``(a, b, weight)``."""
    kept = before.select("a", "b").join(after.select("a", "b"), ["a", "b"], "left_semi").agg(F.count("*").alias("kept"))
    side = lambda d, name: d.agg(F.count("*").alias(f"n_{name}"), F.sum(F.xxhash64("weight").cast("decimal(38,0)")).alias(f"w_{name}"))
    return side(before, "before").join(side(after, "after")).join(kept).select(  # one row each
        "n_before", "n_after", (F.col("n_before") - F.col("kept")).alias("n_changed"), F.col("w_before").eqNullSafe(F.col("w_after")).alias("same_weights"))


def as_edges(pairs: DataFrame) -> DataFrame:
    """Both directions of ``(a, b, weight)``, without distances."""
    one = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(None).cast("double").alias("dist_km"), "weight")
    return one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist_km", "weight"))
