"""Weighted k-nearest-neighbour graphs as edge tables.

``nodes`` carry ``row_id`` (and ``role``, ``region``, feature columns);
``edges`` are ``(src, dst, dist_km, weight)``. Parallel edges are kept: two
records that list each other are joined by two edges in each direction.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from occgraph.operators.knn import knn_graph_pairs, knn_join, neighbours_with_fallback
from occgraph.session import materialize

STRATEGIES = ("distance", "feature_similarity", "mixed")
PROPAGATIONS = ("mean", "weighted_mean", "gcn", "attention", "none")
DEGENERATE_NORM = 1e-8


def unweighted_edges(pairs: DataFrame, dedup: bool = False) -> DataFrame:
    """Both directions of every neighbour pair; ``dedup`` merges mutual pairs."""
    one_way = pairs.select("src", "dst").distinct()
    both = one_way.unionAll(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.distinct() if dedup else both


def bandwidth(pairs: DataFrame, fit_nodes: DataFrame | None = None) -> float:
    """Mean neighbour distance in km over fit rows, before any distance cut; 0 without neighbours."""
    if fit_nodes is not None:
        pairs = pairs.join(fit_nodes.select(F.col("row_id").alias("src")), "src", "left_semi")
    return pairs.agg(F.avg("dist_km")).first()[0] or 0.0


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def weigh_edges(
    pairs: DataFrame,
    sigma: float,
    *,
    strategy: str = "mixed",
    alpha: float = 0.6,
    src_geo: DataFrame | None = None,
    dst_geo: DataFrame | None = None,
    both_fit: Column | None = None,
) -> DataFrame:
    """Add ``weight``: exp(-d/sigma), clipped cosine similarity, or their blend.

    ``src_geo``/``dst_geo`` are ``(row_id, geo array<double>)``. A zero vector
    carries no similarity, so its edges use the spatial term alone. With
    ``both_fit`` the same holds for edges where that condition is false.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    # all neighbours at one spot: distance 0 weighs 1, anything farther nothing
    spatial = F.exp(-F.col("dist_km") / F.lit(float(sigma))) if sigma else (F.col("dist_km") == 0).cast("double")
    if strategy == "distance":
        return pairs.withColumn("weight", spatial)
    if src_geo is None:
        raise ValueError(f"strategy {strategy!r} needs feature vectors")
    dst_geo = src_geo if dst_geo is None else dst_geo
    with_norm = lambda g, key, pre: g.select(
        F.col("row_id").alias(key), F.col("geo").alias(f"{pre}_geo"), norm(F.col("geo")).alias(f"{pre}_norm")
    )
    joined = pairs.join(with_norm(src_geo, "src", "s"), "src").join(with_norm(dst_geo, "dst", "d"), "dst")
    dot = F.aggregate(F.zip_with("s_geo", "d_geo", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    similar = F.greatest(F.lit(0.0), dot / (F.col("s_norm") * F.col("d_norm")))
    blended = similar if strategy == "feature_similarity" else F.lit(alpha) * spatial + F.lit(1 - alpha) * similar
    usable = (F.col("s_norm") >= DEGENERATE_NORM) & (F.col("d_norm") >= DEGENERATE_NORM)
    if both_fit is not None:
        usable = usable & both_fit
    return joined.withColumn("weight", F.when(usable, blended).otherwise(spatial)).select(*pairs.columns, "weight")


def both_directions(edges: DataFrame) -> DataFrame:
    """Append every edge reversed with the same weight."""
    columns = ["src", "dst", "dist_km", "weight"]
    return edges.select(*columns).unionAll(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist_km", "weight")
    )


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    sigma: float


def build_weighted_graph(
    nodes: DataFrame,
    k: int = 15,
    *,
    strategy: str = "mixed",
    alpha: float = 0.6,
    sigma: float | None = None,
    max_km: float | None = 2000.0,
    fit_role: str | None = None,
    unify_edge_rule: bool = True,
    pairs: DataFrame | None = None,
) -> Graph:
    """The whole construction; ``pairs`` reuses a neighbour table between variants.

    ``fit_role`` limits the bandwidth to those rows and, when the edge rule is
    not unified, limits feature similarity to edges inside them.
    """
    if pairs is None:
        pairs = materialize(knn_graph_pairs(nodes, k))
    pairs = pairs.filter(F.col("rn") <= k)
    fit = nodes.filter(F.col("role") == fit_role) if fit_role else None
    if sigma is None:
        sigma = bandwidth(pairs, fit)
    kept = neighbours_with_fallback(pairs, max_km)
    both_fit = None
    if fit_role and not unify_edge_rule:
        roles = nodes.select(F.col("row_id"), (F.col("role") == fit_role).alias("fit"))
        kept = kept.join(roles.toDF("src", "src_fit"), "src").join(roles.toDF("dst", "dst_fit"), "dst")
        both_fit = F.col("src_fit") & F.col("dst_fit")
    geo = nodes.select("row_id", "geo") if "geo" in nodes.columns else None
    weighted = weigh_edges(kept, sigma, strategy=strategy, alpha=alpha, src_geo=geo, both_fit=both_fit)
    return Graph(nodes, both_directions(weighted), sigma)


def edge_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree and mean/max incoming weight per node, zero without edges."""
    stats = edges.groupBy(F.col("dst").alias("row_id")).agg(
        F.count("*").alias("degree"), F.avg("weight").alias("mean_weight"), F.max("weight").alias("max_weight")
    )
    return nodes.join(stats, "row_id", "left").fillna(0, ["degree", "mean_weight", "max_weight"])


def induced_subgraph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges with both ends among ``members(row_id)``."""
    ends = lambda name: members.select(F.col("row_id").alias(name))
    return edges.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")


def dense_ids(members: DataFrame, first_role: str = "train") -> DataFrame:
    """Consecutive ids with one role first, without a global one-task window."""
    curve = [(F.col("role") != first_role).alias("later"), F.col("row_id")]
    ordered = materialize(
        members.select("row_id", "role", curve[0]).repartitionByRange("later", "row_id")
        .sortWithinPartitions("later", "row_id").withColumn("seq", F.monotonically_increasing_id())
        .withColumn("part", F.shiftright("seq", 33))
    )
    runs = ordered.groupBy("part").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    before = W.partitionBy(F.lit(0)).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shift = runs.select("part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return ordered.join(shift, "part").select("row_id", "role", (F.col("seq") + F.col("shift")).alias("dense_id"))


# --- held-out records -------------------------------------------------------

def attach_held_out(
    arrivals: DataFrame,
    stored: DataFrame,
    sigma: float,
    *,
    k: int = 10,
    max_km: float = 2000.0,
    strategy: str = "mixed",
    alpha: float = 0.5,
) -> DataFrame:
    """Edges from each held-out record to its nearest stored records.

    All arrivals are attached in one job, yet each sees only stored records,
    never another arrival: dropping one arrival changes no other.
    """
    pairs = neighbours_with_fallback(knn_join(arrivals, stored, k), max_km)
    geo = lambda d: d.select("row_id", "geo") if "geo" in d.columns else None
    return weigh_edges(pairs, sigma, strategy=strategy, alpha=alpha, src_geo=geo(arrivals), dst_geo=geo(stored))


def attached_stats(arrivals: DataFrame, attached: DataFrame) -> DataFrame:
    """Mean and max weight of each held-out record's own edges."""
    stats = attached.groupBy(F.col("src").alias("row_id")).agg(
        F.count("*").alias("n_neighbours"), F.avg("weight").alias("mean_weight"), F.max("weight").alias("max_weight")
    )
    return arrivals.join(stats, "row_id", "left").fillna(0, ["n_neighbours", "mean_weight", "max_weight"])


# --- propagation ------------------------------------------------------------

def propagate(nodes: DataFrame, edges: DataFrame, features: list[str], mode: str = "mean", prefix: str = "h1_") -> DataFrame:
    """One hop of neighbour aggregation over fixed weights, no learned part.

    Returns ``row_id`` and one ``prefix``-named column per feature; a node
    without incoming edges gets zeros (its own part only, for ``gcn``).
    """
    if mode not in PROPAGATIONS:
        raise ValueError(f"mode must be one of {PROPAGATIONS}, got {mode!r}")
    base = nodes.select("row_id", *features)
    if mode == "none":
        return base.select("row_id", *[F.col(f).alias(prefix + f) for f in features])
    source = base.withColumnRenamed("row_id", "src")
    arcs = edges.select("src", "dst", "weight")
    if mode == "gcn":
        return _propagate_gcn(base, arcs, features, prefix)
    joined = arcs.join(source, "src")
    if mode == "mean":
        parts = [F.avg(f).alias(prefix + f) for f in features]
    elif mode == "weighted_mean":
        parts = [F.avg(F.col("weight") * F.col(f)).alias(prefix + f) for f in features]
    else:
        target = base.select(F.col("row_id").alias("dst"), F.array(*features).alias("own"))
        own, other = F.col("own"), F.array(*[F.col(f).cast("double") for f in features])
        joined = joined.join(target, "dst").withColumn("pull", F.exp(F.coalesce(F.try_divide(
            F.aggregate(F.zip_with(own, other, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x),
            norm(own) * norm(other)), F.lit(0.0))))
        parts = [(F.sum(F.col("pull") * F.col(f)) / F.sum("pull")).alias(prefix + f) for f in features]
    hop = joined.groupBy(F.col("dst").alias("row_id")).agg(*parts)
    return base.select("row_id").join(hop, "row_id", "left").fillna(0.0)


def _propagate_gcn(base: DataFrame, arcs: DataFrame, features: list[str], prefix: str) -> DataFrame:
    """Symmetric normalisation with a unit self loop on every node."""
    degree = base.select("row_id").join(
        arcs.groupBy(F.col("dst").alias("row_id")).agg(F.sum("weight").alias("w")), "row_id", "left"
    ).select("row_id", (F.coalesce("w", F.lit(0.0)) + 1.0).alias("deg"))
    loaded = base.join(degree, "row_id").select(
        "row_id", "deg", *[(F.col(f) / F.sqrt("deg")).alias(f) for f in features]
    )
    hop = arcs.join(loaded.withColumnRenamed("row_id", "src"), "src").groupBy(F.col("dst").alias("row_id")).agg(
        *[F.sum(F.col("weight") * F.col(f)).alias(f"sum_{f}") for f in features]
    )
    return loaded.join(hop, "row_id", "left").select(
        "row_id",
        *[((F.coalesce(f"sum_{f}", F.lit(0.0)) + F.col(f)) / F.sqrt("deg")).alias(prefix + f) for f in features],
    )


def propagate_held_out(
    arrivals: DataFrame, stored: DataFrame, edges: DataFrame, attached: DataFrame, features: list[str], mode: str = "mean"
) -> DataFrame:
    """Hop-1 and hop-2 features of held-out records in ``mode``, each as if it were alone.

    Linking a record adds two edges each way to every neighbour it is attached
    to. What that changes for the neighbours (their sums, and for ``gcn`` their
    degrees, also seen by one another) is added by arithmetic instead of
    copying the graph, so it is the same as propagating over a graph that was
    built with this one record.
    """
    if mode not in PROPAGATIONS or mode == "none":
        raise ValueError(f"mode must be one of {PROPAGATIONS[:-1]}, got {mode!r}")
    links = attached.select(F.col("src").alias("a"), F.col("dst").alias("j"), F.col("weight").alias("w"))
    vector = lambda d, key, name: d.select(F.col("row_id").alias(key), F.array(*[F.col(f).cast("double") for f in features]).alias(name))
    arcs = edges.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.col("weight").alias("v"))
    arcs = arcs.join(links.select("j").distinct(), "j", "left_semi").join(vector(stored, "i", "xi"), "i")
    links = links.join(vector(arrivals, "a", "xa"), "a").join(vector(stored, "j", "xj"), "j")
    if mode == "gcn":
        return _held_out_gcn(links, arcs, edges, stored, features)
    pull = lambda x, y: F.exp(F.coalesce(F.try_divide(_dot(x, y), norm(x) * norm(y)), F.lit(0.0)))
    if mode == "attention":
        arcs = arcs.join(vector(stored, "j", "xj"), "j").withColumn("u", pull(F.col("xj"), F.col("xi")))
        links = links.withColumn("u", pull(F.col("xj"), F.col("xa")))
        share, own, total = F.col("u"), F.col("u"), F.col("u")
    else:
        one = F.lit(1.0)
        share, own, total = (one, one, one) if mode == "mean" else (F.col("v"), F.col("w"), one)
    sums = arcs.groupBy("j").agg(F.sum(total).alias("total"), _sum_vectors("xi", share, features).alias("sum"))
    zero = F.array(*[F.lit(0.0) for _ in features])
    # every neighbour's first hop, with this record among its neighbours
    near = links.join(sums, "j", "left").withColumn("total", F.coalesce("total", F.lit(0.0))).withColumn("sum", F.coalesce("sum", zero)).withColumn(
        "hj", F.transform(F.zip_with("sum", "xa", lambda t, x: t + 2 * own * x), lambda t: t / (F.col("total") + 2 * (own if mode == "attention" else F.lit(1.0)))))
    weight = F.col("w") if mode == "weighted_mean" else F.col("u") if mode == "attention" else F.lit(1.0)
    by = F.sum("u") if mode == "attention" else F.count("*")
    first = near.groupBy("a").agg(by.alias("by"), _sum_vectors("xj", weight, features).alias("sum")).select(
        "a", F.transform("sum", lambda t: t / F.col("by")).alias("ha"))
    near = near.join(first, "a")
    if mode == "attention":
        near = near.withColumn("u", pull(F.col("ha"), F.col("hj")))
    second = near.groupBy("a").agg(by.alias("by"), F.first("ha").alias("ha"), _sum_vectors("hj", weight, features).alias("sum")).select(
        "a", "ha", F.transform("sum", lambda t: t / F.col("by")).alias("hh"))
    return _hops(second, features)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _sum_vectors(column: str, weight: Column, features: list[str]) -> Column:
    return F.array(*[F.sum(weight * F.col(column)[i]) for i in range(len(features))])


def _hops(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.select(
        F.col("a").alias("row_id"), *[F.col("ha")[i].alias(f"h1_{f}") for i, f in enumerate(features)], *[F.col("hh")[i].alias(f"h2_{f}") for i, f in enumerate(features)])


def _held_out_gcn(links: DataFrame, arcs: DataFrame, edges: DataFrame, stored: DataFrame, features: list[str]) -> DataFrame:
    """Symmetric normalisation: a new record also changes its neighbours' degrees, which their common edges see."""
    degrees = stored.select("row_id").join(edges.groupBy(F.col("dst").alias("row_id")).agg(F.sum("weight").alias("s")), "row_id", "left").select(
        "row_id", (1 + F.coalesce("s", F.lit(0.0))).alias("d"))
    degree = lambda key, name: degrees.select(F.col("row_id").alias(key), F.col("d").alias(name))
    links = links.join(degree("j", "dj"), "j").withColumn("dj2", F.col("dj") + 2 * F.col("w"))
    links = links.join(links.groupBy("a").agg((1 + 2 * F.sum("w")).alias("da")), "a")
    arcs = arcs.join(degree("i", "di"), "i")
    sums = arcs.groupBy("j").agg(_sum_vectors("xi", F.col("v") / F.sqrt("di"), features).alias("sum"))
    # edges between two neighbours of the same record: their source's degree has grown too
    both = links.select("a", F.col("j").alias("i"), F.col("dj2").alias("di2")).join(arcs, "i").join(links.select("a", "j"), ["a", "j"])
    change = F.col("v") * (1 / F.sqrt("di2") - 1 / F.sqrt("di"))
    changes = both.groupBy("a", "j").agg(_sum_vectors("xi", change, features).alias("more"))
    zero = F.array(*[F.lit(0.0) for _ in features])
    near = links.join(sums, "j", "left").join(changes, ["a", "j"], "left").withColumn("sum", F.zip_with(
        F.coalesce("sum", zero), F.coalesce("more", zero), lambda x, y: x + y))
    own = F.transform("xa", lambda x: 2 * F.col("w") * x / F.sqrt("da"))
    self_loop = F.transform("xj", lambda x: x / F.sqrt("dj2"))
    near = near.withColumn("hj", F.transform(F.zip_with(F.zip_with("sum", own, lambda x, y: x + y), self_loop, lambda x, y: x + y), lambda t: t / F.sqrt("dj2")))
    weight = 2 * F.col("w") / F.sqrt("dj2")

    def hop(rows: DataFrame, neighbour: str, mine: str, name: str, *keep: str) -> DataFrame:
        summed = rows.groupBy("a").agg(F.first("da").alias("da"), F.first(mine).alias("mine"), _sum_vectors(neighbour, weight, features).alias("sum"), *[F.first(k).alias(k) for k in keep])
        return summed.select("a", *keep, F.transform(F.zip_with("sum", "mine", lambda t, x: t + x / F.sqrt("da")), lambda t: t / F.sqrt("da")).alias(name))

    first = hop(near, "xj", "xa", "ha")
    return _hops(hop(near.join(first, "a"), "hj", "ha", "hh", "ha"), features)


# --- diagnostics ------------------------------------------------------------

def degree_by_region(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node count and mean/min/max/median degree per region.

    Degrees are small integers, so the median works on a per-degree tally.
    """
    degrees = edges.groupBy(F.col("dst").alias("row_id")).agg(F.count("*").alias("degree"))
    tally = (
        nodes.select("row_id", "region").join(degrees, "row_id", "left").fillna(0, ["degree"])
        .groupBy("region", "degree").agg(F.count("*").alias("n"))
    )
    return tally.groupBy("region").agg(
        F.sum("n").alias("n_nodes"),
        (F.sum(F.col("n") * F.col("degree")) / F.sum("n")).alias("mean_degree"),
        F.min("degree").alias("min_degree"), F.max("degree").alias("max_degree"),
        F.percentile("degree", 0.5, F.col("n")).alias("median_degree"),
    )


def sparse_nodes(nodes: DataFrame, edges: DataFrame, threshold: int) -> DataFrame:
    """Nodes without edges (``isolated``) or with at most ``threshold`` (``near_isolated``)."""
    degrees = edges.groupBy(F.col("dst").alias("row_id")).agg(F.count("*").alias("degree"))
    return (
        nodes.select("row_id", "region").join(degrees, "row_id", "left").fillna(0, ["degree"])
        .filter(F.col("degree") <= threshold)
        .withColumn("kind", F.when(F.col("degree") == 0, "isolated").otherwise("near_isolated"))
    )


def weight_histogram(edges: DataFrame, keys: list[str], bins: int = 20) -> DataFrame:
    """Equal bins on [0, 1], the last closed, empty bins included."""
    edges = edges.withColumn("bin", F.least(F.floor(F.col("weight") * bins), F.lit(bins - 1)).cast("int"))
    counts = edges.groupBy(*keys, "bin").agg(F.count("*").alias("n_edges"))
    grid = counts.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counts, [*keys, "bin"], "left").fillna(0, ["n_edges"])


def weight_summary(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.groupBy(*keys).agg(
        F.count("*").alias("n_edges"), F.avg("weight").alias("mean_weight"),
        F.stddev_pop("weight").alias("std_weight"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"),
    )


def role_shift(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree and weight levels of train and val nodes."""
    return edge_stats(nodes.select("row_id", "role"), edges).groupBy("role").agg(
        F.count("*").alias("n"), F.avg("degree").alias("mean_degree"), F.stddev_pop("degree").alias("std_degree"),
        F.avg("mean_weight").alias("mean_weight"), F.avg("max_weight").alias("max_weight"),
    )
