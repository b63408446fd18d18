"""Exact nearest-neighbour joins on the sphere.

Records are first collapsed to distinct places, so any number of copies at one
spot costs one place. Places are sorted along an octree's curve and cut into
blocks that never leave an octree cell: a cell with more than ``LEAF`` places
is cut further, so blocks are small where places are dense, compact
everywhere, and none straddles a seam of the curve. A join starts from the
cells near the root on both sides and keeps, ``STEP`` depths at a time, only
pairs of cells that can still hold a neighbour. What reaches a query block is
the pool blocks around it, whatever the number of records.

There is one way for every size, and its answer equals the full pairwise
comparison, with ties by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from occgraph.functions.geo import EARTH_RADIUS_KM, chord_of_km, morton_code, unit_xyz
from occgraph.session import materialize

LEAF = 128       # ids in a block, about, or more if more neighbours are wanted
HEAVY = 4096     # a query block that meets more pool ids is taken apart into its places
STEP = 2         # octree depths between two rounds of pruning
DEPTH = 20       # bits of an axis in the curve's code
SLACK = 1e-9     # chord length, about 6 mm: keeps every tie at the 1 mm rounding
TIE_DECIMALS = 6  # neighbours are ordered by distance to 1 mm, then by id
_AXES = ("x", "y", "z")
_BOX = [f"{n}{a}" for a in _AXES for n in ("lo_", "hi_")]


def _spots(df: DataFrame, id_col: str, keep: int, group: list[str]) -> DataFrame:
    """Distinct places with their ``keep`` lowest ids.

    For one query all ids of a place are equally far, so ids beyond the first
    ``keep`` can never be among its answers.
    """
    place = [*group, "lat", "lon"]
    if not keep:
        return df.select(*place).distinct().withColumn("ids", F.array().cast("array<bigint>"))
    ranked = df.select(*place, F.col(id_col).alias("id")).withColumn("nth", F.row_number().over(W.partitionBy(*place).orderBy("id")))
    return ranked.filter(F.col("nth") <= keep).groupBy(*place).agg(F.array_sort(F.collect_list("id")).alias("ids"))


def _leaf(df: DataFrame, keep: int, group: list[str]) -> int:
    """Places in a block: as many as hold about ``LEAF`` ids together, or ``keep`` if that is more.

    Where many records share their places a block of ``LEAF`` places would hold
    ``keep`` times as many ids, all of which travel to every block around it.
    """
    ids = df.groupBy(*group, "lat", "lon").agg(F.least(F.count("*"), F.lit(keep)).alias("n")).agg(F.avg("n")).first()[0]
    return max(2, int(max(LEAF, keep) / (ids or 1)))


def _shared_depth(a: int, b: int) -> int:
    """Depth down to which two codes are in the same cells."""
    return DEPTH - -(-(a ^ b).bit_length() // 3)


def _cut(codes: np.ndarray, leaf: int, closed: bool, before: int) -> tuple[list[int], list[int]]:
    """Ends and depths of the blocks of one sorted run of codes.

    While more than ``leaf`` codes are left, the next block is the largest
    cell around the first of them that doesn't reach the code ``leaf`` places
    on, but at most one depth wider than the block ``before`` it: the rest of
    a wide cell may lie at both its ends. The last ``leaf`` codes wait for what
    follows, or are cut at that depth if nothing does.
    """
    ends, depths, at = [], [], 0
    while len(codes) - at > leaf:
        first = int(codes[at])
        depth = min(DEPTH, max(_shared_depth(first, int(codes[at + leaf])) + 1, before - 1))
        width = 3 * (DEPTH - depth)
        upto = at + int(np.searchsorted(codes[at : at + leaf], ((first >> width) + 1) << width))
        ends.append(upto)
        depths.append(depth)
        at, before = upto, depth
    if closed and at < len(codes):
        depth = max(0, before - 1) if before else _shared_depth(int(codes[at]), int(codes[-1]))
        edges = np.flatnonzero(np.diff(codes[at:] >> (3 * (DEPTH - depth)))) + 1
        ends += [*(edges + at).tolist(), len(codes)]
        depths += [depth] * (len(edges) + 1)
    return ends, depths


def _packed_blocks(group: list[str], leaf: int):
    """Blocks of a task's sorted places, one row each, with their places in arrays."""

    def blocks(table: pa.Table, ends: list[int], depths: list[int]) -> pa.RecordBatch:
        starts = np.array([0, *ends[:-1]])
        columns = [table[c].combine_chunks().take(pa.array(starts)) for c in group]
        codes, sizes = table["code"].to_numpy(), table["n_ids"].to_numpy()
        boxes = [f.reduceat(table[a].to_numpy()[: ends[-1]], starts) for a in _AXES for f in (np.minimum, np.maximum)]
        offsets = pa.array([0, *ends], pa.int32())
        places = [pa.ListArray.from_arrays(offsets, table[c].combine_chunks()) for c in ("lat", "lon", "ids")]
        values = [pa.array(codes[starts]), pa.array(depths, pa.int32()), pa.array(np.add.reduceat(sizes[: ends[-1]], starts).astype(np.int64)), *map(pa.array, boxes), *places]
        return pa.RecordBatch.from_arrays([*columns, *values], names=[*group, "code", "depth", "n_ids", *_BOX, "lat", "lon", "ids"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, 0
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            held = table
            if len(table) <= 4 * leaf and len(table) < 4096:
                continue
            ends, depths, before = _cut_groups(table, group, leaf, False, before)
            if ends:
                yield blocks(table, ends, depths)
                held = table.slice(ends[-1])
        if held is not None and len(held):
            table = held.combine_chunks()
            ends, depths, _ = _cut_groups(table, group, leaf, True, before)
            yield blocks(table, ends, depths)

    return pack


def _cut_groups(table: pa.Table, group: list[str], leaf: int, closed: bool, before: int) -> tuple[list[int], list[int], int]:
    """``_cut`` for each group in turn; only the last group may go on."""
    codes = table["code"].to_numpy()
    changed = np.zeros(max(0, len(codes) - 1), bool)
    for c in group:
        keys = table[c].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        changed |= keys[1:] != keys[:-1]
    edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(codes)]
    ends, depths = [], []
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        last = i == len(edges) - 2
        own_ends, own_depths = _cut(codes[a:b], leaf, closed or not last, before if i == 0 else 0)
        ends += [a + e for e in own_ends]
        depths += own_depths
        before = own_depths[-1] if own_depths else before if last and i == 0 else 0
    return ends, depths, before


def _blocks(df: DataFrame, id_col: str, keep: int, leaf: int, group: list[str]) -> DataFrame:
    """One row a block: its cell (``code``, ``depth``), box, number of ids and places; written once."""
    order = [*group, "code", "lat", "lon"]
    located = _spots(df, id_col, keep, group).withColumns(unit_xyz(F.col("lat"), F.col("lon"))).withColumn(
        "code", morton_code(F.col("x"), F.col("y"), F.col("z"))).withColumn("n_ids", F.size("ids").cast("long"))
    kinds = [T.StructField(c, located.schema[c].dataType) for c in group]
    schema = T.StructType([
        *kinds, T.StructField("code", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("n_ids", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in _BOX], T.StructField("lat", T.ArrayType(T.DoubleType())),
        T.StructField("lon", T.ArrayType(T.DoubleType())), T.StructField("ids", T.ArrayType(T.ArrayType(T.LongType())))])
    ordered = located.select(*group, "code", "lat", "lon", *_AXES, "ids", "n_ids").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.mapInArrow(_packed_blocks(group, leaf), schema).withColumn("block", F.monotonically_increasing_id()))


def _cell(depth: int | None) -> Column:
    """Number of a block's cell at a depth (its own cell if that is wider); without a depth the block's number."""
    if depth is None:
        return F.col("block")
    return F.expr(f"shiftleft(1L, 3 * least({depth}, depth)) | shiftright(code, 3 * ({DEPTH} - least({depth}, depth)))")


def _cells(blocks: DataFrame, side: str, group: list[str], depth: int | None, above: int | None) -> DataFrame:
    """Cells at a depth with their boxes, and the cell above each."""
    parent = F.lit(0).cast("long") if above is None else _cell(above)
    lows = [F.min(c).alias(f"{side}_{c}") for c in _BOX[::2]]
    highs = [F.max(c).alias(f"{side}_{c}") for c in _BOX[1::2]]
    return blocks.select(*group, _cell(depth).alias(side), parent.alias(f"{side}_above"), "n_ids", *_BOX).groupBy(*group, side, f"{side}_above").agg(
        *lows, *highs, F.sum("n_ids").alias(f"{side}_n_ids"))


def _box_bounds() -> tuple[Column, Column]:
    near, far = F.lit(0.0), F.lit(0.0)
    for a in _AXES:
        q_lo, q_hi, p_lo, p_hi = (F.col(f"{s}{n}{a}") for s in ("q_", "p_") for n in ("lo_", "hi_"))
        gap = F.greatest(F.lit(0.0), p_lo - q_hi, q_lo - p_hi)
        span = F.greatest(p_hi - q_lo, q_hi - p_lo)
        near, far = near + gap * gap, far + span * span
    return F.sqrt(near), F.sqrt(far)


def _prune(joined: DataFrame, query: list[str], need: int, reach: float | None) -> DataFrame:
    """Pairs no farther apart than the farthest point of the boxes that, nearest first, hold ``need`` ids together."""
    near, far = _box_bounds()
    measured = joined.select(*query, "p", "p_n_ids", near.alias("near"), far.alias("far"))
    nearest_first = W.partitionBy(*query).orderBy("far", "p").rowsBetween(W.unboundedPreceding, 0)
    summed = measured.withColumn("ids", F.sum("p_n_ids").over(nearest_first))
    bound = F.min(F.when(F.col("ids") >= need, F.col("far"))).over(W.partitionBy(*query))
    kept = summed.withColumn("bound", F.coalesce(bound, F.lit(2.0)) + F.lit(SLACK)).filter(F.col("near") <= F.col("bound"))
    if reach is not None:
        kept = kept.filter(F.col("near") <= F.lit(reach))
    return kept.select(*query, "p", "near", "p_n_ids")


def block_pairs(q_blocks: DataFrame, p_blocks: DataFrame, group: list[str], need: int, reach: float | None) -> DataFrame:
    """``(*group, q, s, p, near, p_n_ids)``, written once: pool blocks that may hold one of the ``need`` nearest of a query's places.

    ``s`` is -1 for a whole query block. One at the edge of a dense area meets
    much of it, though each of its places needs little: such a block is taken
    apart, and ``s`` is the place.
    """
    deepest = q_blocks.select("depth").unionAll(p_blocks.select("depth")).agg(F.max("depth")).first()[0] or 0
    pairs, above = None, None
    for depth in [*range(STEP, deepest, STEP), None]:
        q_cells, p_cells = (_cells(b, s, group, depth, above) for b, s in ((q_blocks, "q"), (p_blocks, "p")))
        if pairs is None:
            joined = q_cells.join(p_cells, group)  # cells of the first depths: a few dozen a side and group
        else:
            known = pairs.select(*group, F.col("q").alias("q_above"), F.col("p").alias("p_above"))
            joined = known.join(p_cells, [*group, "p_above"]).join(q_cells, [*group, "q_above"])
        pairs, above = _prune(joined, [*group, "q"], need, reach), depth
    pairs = materialize(pairs)
    whole = F.lit(-1).cast("long").alias("s")
    heavy = materialize(pairs.groupBy("q").agg(F.sum("p_n_ids").alias("candidates")).filter(F.col("candidates") > HEAVY).select("q"))
    if heavy.isEmpty():
        return pairs.select("*", whole)
    places = q_blocks.withColumnRenamed("block", "q").join(heavy, "q").select("q", F.posexplode(F.arrays_zip("lat", "lon")).alias("s", "at"))
    located = places.withColumns(unit_xyz(F.col("at.lat"), F.col("at.lon")))
    points = located.select("q", F.col("s").cast("long").alias("s"), *[F.col(a).alias(f"q_{n}{a}") for a in _AXES for n in ("lo_", "hi_")])
    boxes = p_blocks.select(F.col("block").alias("p"), *[F.col(c).alias(f"p_{c}") for c in _BOX])
    single = _prune(pairs.drop("near").join(points, "q").join(boxes, "p"), [*group, "q", "s"], need, reach)
    return materialize(pairs.join(heavy, "q", "left_anti").select("*", whole).unionByName(single))


def _xyz(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    p, q = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(p) * np.cos(q), np.cos(p) * np.sin(q), np.sin(p)])


def _nearest(queries: tuple, pool: tuple, k: int, within_km: float | None, limit: np.ndarray) -> tuple:
    """Neighbours of a block's places among some pool records: (place, id, km, rank).

    ``limit`` is a chord length per place beyond which nothing is wanted.
    """
    (q_lat, q_lon), (p_id, p_lat, p_lon) = queries, pool
    squared = np.zeros((len(q_lat), len(p_id)))
    for a, b in zip(_xyz(q_lat, q_lon), _xyz(p_lat, p_lon)):
        squared += (a[:, None] - b) ** 2
    worst = limit
    if k < len(p_id):
        worst = np.minimum(worst, np.sqrt(np.partition(squared, k - 1, axis=1)[:, k - 1]) + SLACK)
    rows, cols = np.nonzero(squared <= (worst**2)[:, None])
    p1, p2 = np.radians(q_lat)[rows], np.radians(p_lat)[cols]
    dl = np.radians(p_lon)[cols] - np.radians(q_lon)[rows]
    a = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(dl / 2) ** 2
    km, ids = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.clip(a, 0, 1))), p_id[cols]
    keep = np.ones(len(rows), dtype=bool) if within_km is None else km <= within_km
    return _ranked(rows[keep], ids[keep], km[keep], k)


def _ranked(rows: np.ndarray, ids: np.ndarray, km: np.ndarray, k: int) -> tuple:
    """The ``k`` best entries per row number, with their ranks."""
    order = np.lexsort((ids, np.floor(km * 10**TIE_DECIMALS + 0.5), rows))
    rows, ids, km = rows[order], ids[order], km[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
    top = rank <= k
    return rows[top], ids[top], km[top], rank[top]


class _Block:
    """Best neighbours so far of the places of one query block."""

    def __init__(self, lat: np.ndarray, lon: np.ndarray, need: int, within_km: float | None):
        self.lat, self.lon, self.need, self.within_km = lat, lon, need, within_km
        self.best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        self.limit = np.full(len(lat), np.inf if within_km is None else chord_of_km(within_km) + SLACK)

    def offer(self, near: float, lat: np.ndarray, lon: np.ndarray, ids: np.ndarray) -> None:
        """A pool block at chord distance ``near``; nearer blocks come first."""
        if near > self.limit.max(initial=0.0):
            return
        new = _nearest((self.lat, self.lon), (ids, lat, lon), self.need, self.within_km, self.limit)
        self.best = _ranked(*[np.concatenate([a, b]) for a, b in zip(self.best[:3], new[:3])], self.need)
        rows, _, km, rank = self.best
        full = rank == self.need
        kth = 2 * np.sin(km[full] / EARTH_RADIUS_KM / 2) + SLACK
        self.limit[rows[full]] = np.minimum(self.limit[rows[full]], kth)

    def result(self, key: list, fields: list[pa.Field]) -> pa.RecordBatch:
        rows, ids, km, rank = self.best
        offsets = np.searchsorted(rows, np.arange(len(self.lat) + 1)).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(rank.astype(np.int32)), pa.array(ids), pa.array(km)], ["rn", "id", "dist_km"])
        keys = [pa.array([v] * len(self.lat), type=f.type) for v, f in zip(key, fields)]
        columns = [*keys, pa.array(self.lat), pa.array(self.lon), pa.ListArray.from_arrays(pa.array(offsets), entries)]
        return pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in fields], "lat", "lon", "near"])


def _search_blocks(stream: DataFrame, group: list[str], need: int, within_km: float | None) -> DataFrame:
    """``(*group, lat, lon, near)`` per query place, by a running search.

    A query block's rows come together: itself first, then pool blocks from
    near to far. Only its places and their best neighbours are held.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, key, fields = None, None, [], []
        for batch in batches:
            fields = [batch.schema.field(c) for c in group]
            near = batch.column("near").to_pylist()
            for i, q in enumerate(zip(batch.column("q").to_pylist(), batch.column("s").to_pylist())):
                lat, lon = (batch.column(c)[i].values.to_numpy() for c in ("lat", "lon"))
                if q != number:
                    if block is not None:
                        yield block.result(key, fields)
                    number, block, key = q, _Block(lat, lon, need, within_km), [batch.column(c)[i].as_py() for c in group]
                else:
                    ids = batch.column("ids")[i].values
                    times = ids.value_lengths().to_numpy()
                    block.offer(near[i], np.repeat(lat, times), np.repeat(lon, times), ids.flatten().to_numpy())
        if block is not None:
            yield block.result(key, fields)

    entry = T.ArrayType(T.StructType([T.StructField("rn", T.IntegerType()), T.StructField("id", T.LongType()), T.StructField("dist_km", T.DoubleType())]))
    schema = T.StructType([*[stream.schema[c] for c in group], T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()), T.StructField("near", entry)])
    return stream.mapInArrow(search, schema)


def _sides(queries: DataFrame, pool: DataFrame, k: int, query_id: str, pool_id: str, lat: str, lon: str, by: tuple[str, ...], exclude_self: bool):
    """Query rows, query blocks, pool blocks, group columns and the ids needed from the pool."""
    group = list(by) or ["all_rows"]

    def side(df: DataFrame, id_col: str) -> DataFrame:
        keys = [F.col(c) for c in by] or [F.lit(0).alias("all_rows")]
        rows = df.select(*keys, F.col(lat).alias("lat"), F.col(lon).alias("lon"), F.col(id_col).cast("bigint").alias("id"))
        return rows.dropna(subset=group)  # a null group has no neighbours

    need = k + (1 if exclude_self else 0)
    q_rows = side(queries, query_id)
    p_rows = q_rows if queries is pool else side(pool, pool_id)
    leaf = _leaf(p_rows, need, group)
    p_blocks = _blocks(p_rows, "id", need, leaf, group)
    q_blocks = p_blocks if queries is pool else _blocks(q_rows, "id", 0, leaf, group)
    return q_rows, q_blocks, p_blocks, group, need


def candidate_counts(queries: DataFrame, pool: DataFrame, k: int, *, by: tuple[str, ...] = (), exclude_self: bool = False, within_km: float | None = None) -> DataFrame:
    """``(q, s, places, candidates)``: how many pool ids a join sends to each query block or place."""
    _, q_blocks, p_blocks, group, need = _sides(queries, pool, k, "row_id", "row_id", "lat", "lon", by, exclude_self)
    pairs = block_pairs(q_blocks, p_blocks, group, need, None if within_km is None else chord_of_km(within_km) + SLACK)
    places = q_blocks.select(F.col("block").alias("q"), F.size("lat").alias("places"))
    sums = pairs.groupBy("q", "s").agg(F.sum("p_n_ids").alias("candidates"))
    return sums.join(places, "q").select("q", "s", F.when(F.col("s") < 0, F.col("places")).otherwise(1).alias("places"), "candidates")


def knn_join(
    queries: DataFrame,
    pool: DataFrame,
    k: int,
    *,
    query_id: str = "row_id",
    pool_id: str = "row_id",
    lat: str = "lat",
    lon: str = "lon",
    by: tuple[str, ...] = (),
    exclude_self: bool = False,
    within_km: float | None = None,
) -> DataFrame:
    """``k`` nearest pool records of every query: ``(*by, src, dst, dist_km, rn)``.

    ``by`` restricts neighbours to the same group. ``within_km`` drops pairs
    farther than the radius and lets the search stop there. Coordinates must
    not be null (see ``require_coordinates``) and ids must be whole numbers.
    """
    q_rows, q_blocks, p_blocks, group, need = _sides(queries, pool, k, query_id, pool_id, lat, lon, by, exclude_self)
    pairs = block_pairs(q_blocks, p_blocks, group, need, None if within_km is None else chord_of_km(within_km) + SLACK)
    none = F.lit(None).cast("array<array<bigint>>").alias("ids")
    own = q_blocks.select(*group, F.col("block").alias("q"), "lat", "lon")
    queries_met = pairs.select("q", "s").distinct().join(own, "q")
    one = lambda c: F.when(F.col("s") < 0, F.col(c)).otherwise(F.array(F.get(c, F.col("s").cast("int")))).alias(c)
    asked = queries_met.select(*group, "q", "s", F.lit(-1.0).alias("near"), one("lat"), one("lon"), none)
    offered = pairs.select(*group, "q", "s", "near", "p").join(p_blocks.select(F.col("block").alias("p"), "lat", "lon", "ids"), "p").select(
        *group, "q", "s", "near", "lat", "lon", "ids")
    # blocks are small and many, so hashing them spreads the work whatever the places
    stream = asked.unionByName(offered).repartition("q", "s").sortWithinPartitions("q", "s", "near")
    best = _search_blocks(stream, group, need, within_km)
    found = q_rows.withColumnRenamed("id", "src").join(best, [*group, "lat", "lon"])
    near = F.col("near")
    if exclude_self:
        near = F.filter(near, lambda n: n["id"] != F.col("src"))
    ranked = found.select(*group, "src", F.posexplode(F.slice(near, 1, k)))
    return ranked.select(
        *by, "src", F.col("col.id").alias("dst"), F.col("col.dist_km").alias("dist_km"),
        (F.col("pos") + 1).alias("rn"),
    )


def knn_graph_pairs(df: DataFrame, k: int, **options) -> DataFrame:
    """Each record's ``k`` nearest other records, itself excluded by id."""
    return knn_join(df, df, k, exclude_self=True, **options)


def neighbours_with_fallback(pairs: DataFrame, max_km: float | None) -> DataFrame:
    """Drop neighbours beyond ``max_km`` but always keep the closest one."""
    return pairs if max_km is None else pairs.filter((F.col("dist_km") <= max_km) | (F.col("rn") == 1))


def mean_knn_distance(pairs: DataFrame, *keys: str) -> DataFrame:
    """Mean neighbour distance per key; no key gives one number for the set."""
    return pairs.groupBy(*keys).agg(F.avg("dist_km").alias("mean_km"), F.count("*").alias("n_pairs"))


def nearest_pool_distance(queries: DataFrame, pool: DataFrame, **options) -> DataFrame:
    """Distance from each query to its closest pool record."""
    return knn_join(queries, pool, 1, **options).drop("rn")


def buffer_filter(
    candidates: DataFrame, held_out: DataFrame, buffer_km: float, *, id_col: str = "row_id", by: tuple[str, ...] = ()
) -> DataFrame:
    """Candidates whose closest held-out record is strictly farther than the buffer."""
    inside = knn_join(candidates, held_out, 1, query_id=id_col, pool_id=id_col, by=by, within_km=buffer_km)
    return candidates.join(inside.select(*by, F.col("src").alias(id_col)), [*by, id_col], "left_anti")
