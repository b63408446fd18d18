"""Train/val/test splits as long tables, buffered spatial hold-outs, audits.

Every random choice is the order of an MD5 hash of (seed, fold, row id), so a
split can be rebuilt anywhere. Ranks inside a fold are taken by hash ranges:
no fold, however large, is sorted in one task.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from occgraph.functions.geo import unit_xyz
from occgraph.functions.hashing import hash_order
from occgraph.operators.clusters import grouped_kmeans
from occgraph.operators.knn import knn_graph_pairs, knn_join
from occgraph.operators.ranking import grouped_quantiles, join_on_keys
from occgraph.session import materialize, small_values

STRATEGIES = ("block", "buffer")
OVERSHOOT = 1.6
MAX_CASES = 1000


def hash_rank(df: DataFrame, keys: list[str], shuffle: Column, tie: str = "row_id", name: str = "place") -> DataFrame:
    """1-based rank in hash order per key, and ``<name>_n`` rows in the key.

    The hash is uniform, so its first 12 bits cut every key into equal slices;
    ranks are taken per slice and shifted by the sizes of the slices before.
    """
    keyed = df.withColumn("shuffle_key", shuffle).withColumn(
        "slice", F.conv(F.substring("shuffle_key", 1, 3), 16, 10).cast("int")
    )
    sizes = keyed.groupBy(*keys, "slice").agg(F.count("*").alias("n"))
    before = W.partitionBy(*keys).orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(  # at most 4096 rows per key
        *keys, "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"),
        F.sum("n").over(W.partitionBy(*keys)).alias(f"{name}_n"),
    )
    local = keyed.withColumn("local", F.row_number().over(W.partitionBy(*keys, "slice").orderBy("shuffle_key", tie)))
    return join_on_keys(local, shifts, [*keys, "slice"]).withColumn(name, F.col("local") + F.col("shift")).select(
        *df.columns, name, f"{name}_n"
    )


# --- leave-one-out folds ----------------------------------------------------

def leave_one_region_out(df: DataFrame, seeds: list[int], val_ratio: float = 0.2, region: str = "region") -> DataFrame:
    """``(seed, fold, row_id, role)`` for every region as test, all at once.

    Rows without a region are never tested. Val is the first
    ``int(n * val_ratio)`` of the other rows in hash order.
    """
    folds = df.select(F.col(region).alias("fold")).dropna().distinct()
    rows = df.select("row_id", F.col(region).alias("home"))
    return fold_roles(rows, fold_cutoffs(rows, folds, seeds, _at_home, val_ratio), _at_home)


def _at_home(fold: Column) -> Column:
    return F.col("home").eqNullSafe(fold)


def leave_one_group_out(df: DataFrame, flags: list[str], seeds: list[int], val_ratio: float = 0.2) -> DataFrame:
    """Folds over overlapping 0/1 flags: test rows carry the flag, the pool is its
    complement, so a row with several flags never returns through another one.
    Rows without a value for a flag take no part in its fold."""
    held = lambda fold: F.element_at("carries", fold)
    carries = F.create_map(*[x for f in flags for x in (F.lit(f), F.col(f) == 1)])
    rows = df.select("row_id", carries.alias("carries"))
    folds = df.sparkSession.createDataFrame([(f,) for f in flags], "fold string")
    return fold_roles(rows, fold_cutoffs(rows, folds, seeds, held, val_ratio), held)


def fold_cutoffs(rows: DataFrame, folds: DataFrame, seeds: list[int], held: Callable[[Column], Column], val_ratio: float = 0.2) -> DataFrame:
    """Where the val rows of each fold end in hash order: ``seed``, ``fold``, ``cut_key``, ``cut_row``, ``n_pool``, ``n_val``.

    ``held(fold)`` says whether a row is the fold's test row, as an expression
    over ``rows``. One row a case comes out; no row is written or shuffled once a
    fold. Pool rows are counted by slices of the hash, as partial sums; only the
    slice that holds a cut, a 4096th of a pool, is ranked.
    """
    cases = folds.select("fold").withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    # a row a fold and seed: the small side, streamed over by the rows
    pool = rows.crossJoin(F.broadcast(cases)).filter(~held(F.col("fold"))).select("row_id", "seed", "fold", hash_order(F.col("seed"), F.col("fold"), F.col("row_id")).alias("key"))
    sliced = pool.withColumn("slice", F.conv(F.substring("key", 1, 3), 16, 10).cast("int"))
    sizes = sliced.groupBy("seed", "fold", "slice").agg(F.count("*").alias("n"))
    case = W.partitionBy("seed", "fold")
    summed = sizes.select("seed", "fold", "slice", "n", F.sum("n").over(case).alias("n_pool"), F.sum("n").over(case.orderBy("slice")).alias("upto")).withColumn(
        "n_val", F.floor(F.col("n_pool") * F.lit(val_ratio)))
    cut = (F.col("upto") >= F.col("n_val")) & (F.col("upto") - F.col("n") < F.col("n_val"))
    at = materialize(summed.filter(cut | (F.col("n_val") == 0)).groupBy("seed", "fold").agg(
        F.min("slice").alias("slice"), F.min_by(F.col("n_val") - F.col("upto") + F.col("n"), "slice").alias("nth"), F.first("n_pool").alias("n_pool"), F.first("n_val").alias("n_val")))
    last = sliced.join(F.broadcast(at.filter("n_val > 0")), ["seed", "fold", "slice"]).withColumn(
        "place", F.row_number().over(W.partitionBy("seed", "fold").orderBy("key", "row_id"))).filter(F.col("place") == F.col("nth"))
    known = cases.join(at.select("seed", "fold", "n_pool", "n_val"), ["seed", "fold"], "left").fillna(0, ["n_pool", "n_val"])
    return materialize(known.join(last.select("seed", "fold", F.col("key").alias("cut_key"), F.col("row_id").alias("cut_row")), ["seed", "fold"], "left"))


def fold_roles(rows: DataFrame, cutoffs: DataFrame, held: Callable[[Column], Column]) -> DataFrame:
    """``(seed, fold, row_id, role)``: an expression over rows and cut-offs.

    A filter on seed and fold reaches the cut-offs, so that one fold's roles
    cost one pass over the rows.
    """
    key = hash_order(F.col("seed"), F.col("fold"), F.col("row_id"))
    first = (key < F.col("cut_key")) | ((key == F.col("cut_key")) & (F.col("row_id") <= F.col("cut_row")))
    role = F.when(held(F.col("fold")), "test").when(F.coalesce(first, F.lit(False)), "val").otherwise("train")
    joined = rows.crossJoin(F.broadcast(cutoffs)).filter(held(F.col("fold")).isNotNull())  # a row a fold and seed on the small side
    return joined.select("seed", "fold", "row_id", role.alias("role"))


def fold_overlaps(splits: DataFrame) -> DataFrame:
    """Rows holding more than one role in a fold; empty for a valid split."""
    return splits.groupBy("seed", "fold", "row_id").agg(F.count_distinct("role").alias("n_roles")).filter("n_roles > 1")


def require_disjoint(splits: DataFrame) -> DataFrame:
    if not fold_overlaps(splits).isEmpty():
        raise ValueError("a record holds two roles in one fold")
    return splits


def stratified_folds(df: DataFrame, keys: list[str], label: str, k: int, seed: int) -> DataFrame:
    """Add ``fold_no`` 0..f-1 balanced per class; f is capped to the minority
    count, and NULL marks keys with fewer than two minority rows (score in sample)."""
    by = keys or ["all_rows"]
    work = df if keys else df.withColumn("all_rows", F.lit(0))
    ranked = hash_rank(work, [*by, label], hash_order(F.lit(seed), F.col("row_id")))
    sizes = work.groupBy(*by, label).agg(F.count("*").alias("n")).groupBy(*by).agg(F.min("n").alias("n"), F.count("*").alias("classes"))
    minority = F.when(F.col("classes") > 1, F.col("n")).otherwise(0)
    folds = sizes.select(*by, F.when(minority >= 2, F.least(F.lit(k), minority)).alias("n_folds"))
    return join_on_keys(ranked, folds, by).select(
        *df.columns, ((F.col("place") - 1) % F.col("n_folds")).cast("int").alias("fold_no")
    )


# --- spatial blocks ---------------------------------------------------------

def default_block_count(test_ratio: float) -> int:
    """Blocks about half the wanted test size, at least three."""
    return max(3, round(2.0 / test_ratio))


def spatial_blocks(df: DataFrame, n_blocks: int, seed: int, starts: int = 10) -> DataFrame:
    """``(row_id, block)``: K-means labels on the unit sphere, the best of several starts by cost."""
    return _blocks_by(df, F.lit("all"), n_blocks, seed, starts).select("row_id", "block")


def regional_blocks(df: DataFrame, n_blocks: int, seed: int, region: str = "region", starts: int = 10) -> DataFrame:
    """``(seed, region, row_id, block)`` with blocks cut inside every region, all regions and starts in the same jobs."""
    return _blocks_by(df, F.col(region), n_blocks, seed, starts).select(F.lit(seed).alias("seed"), F.col("grp").alias("region"), "row_id", "block")


def _blocks_by(df: DataFrame, group: Column, n_blocks: int, seed: int, starts: int) -> DataFrame:
    located = df.withColumns(unit_xyz(F.col("lat"), F.col("lon")))
    points = located.select("row_id", group.cast("string").alias("grp"), F.array("x", "y", "z").alias("x"))
    return grouped_kmeans(points, max(n_blocks, 2), seed, starts)[0].withColumnRenamed("cell", "block")


def hold_out_blocks(blocks: DataFrame, test_ratio: float = 0.15) -> DataFrame:
    """Rows of the held-out blocks of every (seed, region)."""
    sizes = blocks.groupBy("seed", "region", "block").agg(F.count("*").alias("n"))
    return blocks.join(select_blocks(sizes, ["seed", "region"], test_ratio), ["seed", "region", "block"])


def select_blocks(sizes: DataFrame, keys: list[str], test_ratio: float, overshoot: float = OVERSHOOT) -> DataFrame:
    """Held-out blocks per key from ``(*keys, block, n)``.

    Blocks are visited in hash order until the target is met; one that would
    pass ``overshoot`` times the target is skipped unless nothing is held yet.
    The fold runs over one short array of blocks per key.
    """
    order = hash_order(*[F.col(k) for k in keys], F.col("block"))
    visits = sizes.groupBy(*keys).agg(
        F.sum("n").alias("n_rows"), F.array_sort(F.collect_list(F.struct(order.alias("h"), "block", "n"))).alias("visits")
    ).withColumn("target", F.greatest(F.lit(1.0), F.bround(F.col("n_rows") * F.lit(test_ratio))))
    start = F.struct(F.lit(0).cast("long").alias("held"), F.array().cast("array<int>").alias("blocks"))

    def visit(state: Column, block: Column) -> Column:
        grown = state["held"] + block["n"]
        skip = (state["held"] >= F.col("target")) | ((state["held"] > 0) & (grown > overshoot * F.col("target")))
        taken = F.struct(grown.alias("held"), F.array_append(state["blocks"], block["block"]).alias("blocks"))
        return F.when(skip, state).otherwise(taken)

    return visits.select(*keys, F.explode(F.aggregate("visits", start, visit)["blocks"]).alias("block"))


def random_hold_out(df: DataFrame, keys: list[str], test_ratio: float) -> DataFrame:
    """``(*keys, row_id)`` of randomly held-out rows per key."""
    ranked = hash_rank(df, keys, hash_order(F.lit("hold"), *[F.col(k) for k in keys], F.col("row_id")))
    wanted = F.greatest(F.lit(1.0), F.bround(F.col("place_n") * F.lit(test_ratio)))
    return ranked.filter(F.col("place") <= wanted).select(*keys, "row_id")


def buffered_splits(
    df: DataFrame,
    held: DataFrame,
    *,
    pool: str = "region",
    val_ratio: float = 0.2,
    buffer_km: float | None = None,
    k_for_buffer: int = 15,
    strategy: str = "block",
    test_ratio: float = 0.15,
) -> tuple[DataFrame, DataFrame]:
    """Splits and split information for every (seed, region) at once.

    ``held`` is ``(seed, region, row_id[, block])``. With ``pool="region"`` the
    other rows of the region are the candidates, with ``pool="global"`` all
    other rows. Candidates within the buffer of a test row are excluded unless
    too few would stay. The default buffer is the region's mean neighbour
    distance.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}, got {strategy!r}")
    keys = ["seed", "region"]
    sites = df.select("row_id", F.col("region").alias("home"), "lat", "lon")
    held = materialize(held)
    cases = held.select(*keys).distinct()
    if buffer_km is None:
        located = df.filter("region IS NOT NULL").select("row_id", "region", "lat", "lon")
        near = knn_graph_pairs(located, k_for_buffer, by=("region",))
        radius = materialize(near.groupBy("region").agg(F.avg("dist_km").alias("buffer_km")))
    else:
        radius = cases.select("region").distinct().withColumn("buffer_km", F.lit(float(buffer_km)))
    if pool == "region":
        rows = sites.join(cases, F.col("home") == F.col("region"))
    elif pool == "global":
        pairs = [(r["seed"], r["region"]) for r in cases.limit(MAX_CASES + 1).collect()]
        if len(pairs) > MAX_CASES:
            raise ValueError(f"more than {MAX_CASES} seeds and regions in one call")
        every = F.array(*[F.struct(F.lit(s).alias("seed"), F.lit(r).alias("region")) for s, r in sorted(pairs)])
        rows = sites.withColumn("case", F.explode(every)).select("row_id", "home", "lat", "lon", "case.*")
    else:
        raise ValueError(f"pool must be 'region' or 'global', got {pool!r}")
    marked = rows.drop("home").join(held.select(*keys, "row_id", F.lit(True).alias("is_test")), [*keys, "row_id"], "left")
    marked = materialize(marked.withColumn("is_test", F.coalesce("is_test", F.lit(False))))
    test, rest = marked.filter("is_test"), marked.filter("NOT is_test")
    widest = radius.agg(F.max("buffer_km")).first()[0] or 0.0
    close = knn_join(rest, test, 1, by=("seed", "region"), within_km=widest).select(*keys, F.col("src").alias("row_id"), "dist_km")
    distances = rest.join(close, [*keys, "row_id"], "left").join(radius, "region")
    judged = materialize(distances.select(
        *keys, "row_id", "buffer_km", (F.col("dist_km").isNull() | (F.col("dist_km") > F.col("buffer_km"))).alias("far")))
    n_test = test.groupBy(*keys).agg(F.count("*").alias("n_test"))
    counts = judged.groupBy(*keys).agg(F.count("*").alias("n_rest"), F.count_if("far").alias("n_far"), F.max("buffer_km").alias("buffer_km"))
    info = n_test.join(counts, keys, "left").fillna(0, ["n_rest", "n_far"]).withColumn(
        "buffer_fallback", F.col("n_far") < F.greatest(F.lit(4), F.col("n_test")))
    kept = judged.join(info.select(*keys, "buffer_fallback"), keys).filter(F.col("far") | F.col("buffer_fallback"))
    ranked = hash_rank(kept.select(*keys, "row_id"), keys, hash_order(F.lit("val"), F.col("seed"), F.col("region"), F.col("row_id")))
    share = F.floor(F.col("place_n") * F.lit(val_ratio))
    n_val = F.greatest(F.lit(1), share) if pool == "region" else share
    roles = ranked.select(*keys, "row_id", F.when(F.col("place") <= n_val, "val").otherwise("train").alias("role"))
    splits = materialize(roles.unionByName(test.select(*keys, "row_id", F.lit("test").alias("role"))))
    sizes = splits.groupBy(*keys).agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "val").alias("n_val"))
    region_size = sites.groupBy(F.col("home").alias("region")).agg(F.count("*").alias("n_region"))
    blocks = held.groupBy(*keys).agg(F.count_distinct("block").alias("n_blocks_held_out")) if "block" in held.columns else cases.withColumn("n_blocks_held_out", F.lit(0).cast("long"))
    info = info.join(sizes, keys, "left").join(region_size, "region").join(blocks, keys).select(
        *keys, F.lit(strategy).alias("split_strategy"), F.lit(test_ratio).alias("test_ratio"), "n_test",
        (F.col("n_test") / F.col("n_region")).alias("n_test_frac"), "n_blocks_held_out", "n_train", "n_val", "buffer_km",
        F.when(F.col("buffer_fallback"), 0).otherwise(F.col("n_rest") - F.col("n_far")).alias("n_excluded_by_buffer"), "buffer_fallback",
    )
    return splits, info


# --- manifests and audits ---------------------------------------------------

def fingerprint(df: DataFrame) -> str:
    """Order-free fingerprint of row count, coordinates and regions."""
    row = F.xxhash64("lat", "lon", F.coalesce("region", F.lit("")))
    r = df.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("x"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("s")).select(
        F.sha2(F.concat_ws("|", "n", "x", "s"), 256).substr(1, 16)).first()
    return r[0]


def manifest_meta(df: DataFrame, splits: DataFrame, **constants) -> DataFrame:
    """One row: fingerprint, size, seeds covered and the constants used."""
    return splits.agg(F.array_sort(F.collect_set("seed")).alias("seeds")).select(
        F.lit(fingerprint(df)).alias("fingerprint"), F.lit(df.count()).alias("n_records"), "seeds", F.lit(json.dumps(constants, sort_keys=True)).alias("constants"))


def write_manifest(df: DataFrame, splits: DataFrame, info: DataFrame, path: str, **constants) -> None:
    splits.write.mode("overwrite").partitionBy("seed").parquet(f"{path}/splits")
    info.write.mode("overwrite").parquet(f"{path}/split_info")
    manifest_meta(df, splits, **constants).write.mode("overwrite").parquet(f"{path}/meta")


def missing_seeds(splits: DataFrame, seeds: list[int]) -> DataFrame:
    wanted = splits.sparkSession.createDataFrame([(s,) for s in seeds], "seed int")
    return wanted.join(splits.select(F.col("seed").cast("int").alias("seed")).distinct(), "seed", "left_anti")


def read_manifest(df: DataFrame, path: str, seeds: list[int]) -> DataFrame:
    """Stored splits of ``seeds``; raises on other data or absent seeds."""
    spark = df.sparkSession
    stored = spark.read.parquet(f"{path}/meta").first()["fingerprint"]
    if stored != fingerprint(df):
        raise ValueError("the manifest was built from other records")
    splits = spark.read.parquet(f"{path}/splits")
    absent = [r["seed"] for r in missing_seeds(splits, seeds).collect()]
    if absent:
        raise ValueError(f"the manifest has no splits for seeds {absent}")
    return splits.filter(F.col("seed").isin(seeds))


def split_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose role differs or exists on one side only."""
    columns = ["seed", "region", "row_id", "role"]
    left = a.select(*columns).withColumnRenamed("role", "stored_role")
    right = b.select(*columns).withColumnRenamed("role", "rebuilt_role")
    return left.join(right, columns[:3], "full_outer").filter(~F.col("stored_role").eqNullSafe(F.col("rebuilt_role")))


def info_differences(stored: DataFrame, rebuilt: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Folds whose split information differs, numbers within tolerance."""
    keys = ["seed", "region"]
    values = [c for c in stored.columns if c not in keys]
    joined = stored.select(*keys, *[F.col(c).alias(f"a_{c}") for c in values]).join(
        rebuilt.select(*keys, *[F.col(c).alias(f"b_{c}") for c in values]), keys, "full_outer")
    kinds = dict(stored.dtypes)

    def differs(c: str) -> Column:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        if kinds[c] == "double":
            return F.coalesce(F.abs(a - b) > tolerance, a.isNull() != b.isNull())
        return ~a.eqNullSafe(b)

    wrong = F.array_compact(F.array(*[F.when(differs(c), F.lit(c)) for c in values]))
    return joined.select(*keys, wrong.alias("fields")).filter(F.size("fields") > 0)


def require_same_split(a: DataFrame, b: DataFrame) -> None:
    if not split_differences(a, b).isEmpty():
        raise ValueError("the splits differ")


def distance_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Count, minimum, mean and median of ``dist_km`` per key."""
    base = rows.groupBy(*keys).agg(F.count("*").alias("n_test"), F.min("dist_km").alias("min_km"), F.avg("dist_km").alias("mean_km"))
    return base.join(grouped_quantiles(rows, keys, "dist_km", {"median_km": 0.5}), keys)


def fold_summary(folds: DataFrame) -> DataFrame:
    """Over folds with ``min_km``, ``buffer_km``, ``buffer_fallback``."""
    return folds.agg(
        F.count("*").alias("n_folds"), F.min("min_km").alias("min_of_min"), F.percentile("min_km", 0.5).alias("median_of_min"),
        F.max("min_km").alias("max_of_min"), F.avg(F.col("min_km") / F.col("buffer_km")).alias("mean_ratio_to_buffer"),
        F.count_if(F.col("min_km") > F.col("buffer_km")).alias("n_beyond_buffer"), F.count_if("buffer_fallback").alias("n_fallback"),
    )


def strategy_summary(info: DataFrame, distances: DataFrame) -> DataFrame:
    """Mean fold sizes, exclusions and nearest distances per strategy."""
    return info.join(distances, ["split_strategy", "seed", "region"], "left").groupBy("split_strategy").agg(
        F.count("*").alias("n_folds"), F.avg("n_train").alias("mean_train"), F.avg("n_test").alias("mean_test"),
        F.avg("n_excluded_by_buffer").alias("mean_excluded"), F.avg("min_km").alias("mean_min_km"),
    )
