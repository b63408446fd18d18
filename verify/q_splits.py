"""Split construction and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from occgraph.functions.hashing import hash_order
from occgraph.operators import splits as S
from occgraph.operators.analytics import sample_per_group
from occgraph.operators.knn import nearest_pool_distance
from occgraph.session import materialize
from verify.registry import query
from verify.views import FLAGS, SITE_ATTRS, SITES, hav_sql, site_attrs, sites, with_sql


def _md5(*parts):
    return "md5(" + "||'|'||".join(f"({p})::VARCHAR" for p in parts) + ")"


_LORO = [SITES, f"""loro AS (SELECT seed, fold, row_id, CASE WHEN home = fold THEN 'test' WHEN place <= floor(n*0.2) THEN 'val' ELSE 'train' END AS role FROM (
  SELECT *, row_number() OVER (PARTITION BY seed, fold, home = fold ORDER BY {_md5('seed','fold','row_id')}, row_id) AS place, count(*) OVER (PARTITION BY seed, fold, home = fold) AS n
  FROM (SELECT seed, fold, row_id, region AS home FROM sites, (SELECT DISTINCT region AS fold FROM sites), (VALUES (42),(1)) s(seed))))"""]


@query(with_sql(_LORO, "SELECT * FROM loro"))
def loro_splits(spark, sf):
    return S.leave_one_region_out(sites(spark, sf), [42, 1])


_LOGO = [SITE_ATTRS, "u AS (" + " UNION ALL ".join(f"SELECT row_id, '{f}' AS fold, {f}=1 AS held FROM site_attrs" for f in FLAGS) + ")", f"""logo AS (
  SELECT seed, fold, row_id, CASE WHEN held THEN 'test' WHEN place <= floor(n*0.2) THEN 'val' ELSE 'train' END AS role FROM (
  SELECT *, row_number() OVER (PARTITION BY fold, held ORDER BY {_md5('seed','fold','row_id')}, row_id) AS place, count(*) OVER (PARTITION BY fold, held) AS n
  FROM (SELECT 42 AS seed, * FROM u)))"""]


@query(with_sql(_LOGO, "SELECT * FROM logo"))
def logo_multilabel_splits(spark, sf):
    return S.require_disjoint(S.leave_one_group_out(site_attrs(spark, sf), FLAGS, [42]))


@query(with_sql([SITES], f"""SELECT row_id, region, label, ((place-1) % least(5, m))::INT AS fold_no FROM (SELECT *, min(n) OVER (PARTITION BY region) AS m FROM (
  SELECT *, row_number() OVER (PARTITION BY region, label ORDER BY {_md5("'7'",'row_id')}, row_id) AS place, count(*) OVER (PARTITION BY region, label) AS n FROM sites))"""))
def stratified_folds(spark, sf):
    return S.stratified_folds(sites(spark, sf).select("row_id", "region", "label"), ["region"], "label", 5, 7)


@query(with_sql([SITES], f"""SELECT region, row_id FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY {_md5("'s'",'row_id')}, row_id) AS rn FROM sites) WHERE rn <= 10"""))
def sample_per_region(spark, sf):
    return sample_per_group(sites(spark, sf), "region", 10, hash_order("s", F.col("row_id"))).select("region", "row_id")


_BLOCKS = "blocks AS (SELECT seed, region, row_id, (floor((lat+60)/8)*100 + floor((lon+180)/12))::INT AS block FROM sites, (VALUES (42),(1),(2)) s(seed))"


def _blocks(spark, sf):
    """Fixed grid blocks, so that both engines start from equal labels."""
    b = (F.floor((F.col("lat") + 60) / 8) * 100 + F.floor((F.col("lon") + 180) / 12)).cast("int")
    return sites(spark, sf).select(F.explode(F.array(F.lit(42), F.lit(1), F.lit(2))).alias("seed"), "region", "row_id", b.alias("block"))


_GREEDY = ["""RECURSIVE dummy AS (SELECT 1 AS one)""", SITES, _BLOCKS,
  f"""sz AS (SELECT seed, region, block, n, row_number() OVER (PARTITION BY seed, region ORDER BY {_md5('seed','region','block')}, block) AS i,
     greatest(1, round_even(sum(n) OVER (PARTITION BY seed, region)*0.15, 0)) AS target FROM (SELECT seed, region, block, count(*) AS n FROM blocks GROUP BY 1,2,3))""",
  """walk AS (SELECT seed, region, block, i, n AS held, true AS taken FROM sz WHERE i = 1
     UNION ALL SELECT z.seed, z.region, z.block, z.i, CASE WHEN ok THEN held + z.n ELSE held END, ok FROM (
       SELECT z.*, w.held, NOT (w.held >= z.target OR (w.held > 0 AND w.held + z.n > 1.6*z.target)) AS ok FROM walk w JOIN sz z ON z.seed=w.seed AND z.region=w.region AND z.i=w.i+1) z)""",
  "held AS (SELECT seed, region, block FROM walk WHERE taken)",
  "test AS (SELECT b.* FROM blocks b JOIN held USING (seed, region, block))"]


def _held(spark, sf):
    b = _blocks(spark, sf)
    sizes = b.groupBy("seed", "region", "block").agg(F.count("*").alias("n"))
    return b.join(S.select_blocks(sizes, ["seed", "region"], 0.15), ["seed", "region", "block"])


@query(with_sql(_GREEDY, "SELECT seed, region, block FROM held"))
def greedy_block_holdout(spark, sf):
    b = _blocks(spark, sf)
    return S.select_blocks(b.groupBy("seed", "region", "block").agg(F.count("*").alias("n")), ["seed", "region"], 0.15)


def _buffer_sql(pool):
    join = "s.region = c.region" if pool == "region" else "TRUE"
    minimum = "greatest(1, floor(n*0.2))" if pool == "region" else "floor(n*0.2)"
    return [*_GREEDY, f"""nn AS (SELECT region, dist_km FROM (SELECT a.region, {hav_sql('a','b')} AS dist_km,
        row_number() OVER (PARTITION BY a.row_id ORDER BY round({hav_sql('a','b')},6), b.row_id) AS rn FROM sites a JOIN sites b ON a.region=b.region AND a.row_id<>b.row_id) WHERE rn<=15)""",
      "radius AS (SELECT region, avg(dist_km) AS buffer_km FROM nn GROUP BY region)",
      "cases AS (SELECT DISTINCT seed, region FROM test)",
      "tl AS (SELECT t.seed, t.region, s.row_id, s.lat, s.lon FROM test t JOIN sites s USING (row_id))",
      f"rest AS (SELECT c.seed, c.region, s.row_id, s.lat, s.lon FROM sites s JOIN cases c ON {join} WHERE NOT EXISTS (SELECT 1 FROM test t WHERE t.seed=c.seed AND t.region=c.region AND t.row_id=s.row_id))",
      f"""judged AS (SELECT r.seed, r.region, r.row_id, buffer_km, min({hav_sql('r','t')}) > buffer_km AS far FROM rest r JOIN tl t ON t.seed=r.seed AND t.region=r.region
         JOIN radius ON radius.region = r.region GROUP BY 1,2,3,4)""",
      "nt AS (SELECT seed, region, count(*) AS n_test, count(DISTINCT block) AS n_blocks_held_out FROM test GROUP BY 1,2)",
      "inf AS (SELECT seed, region, n_test, n_blocks_held_out, count(*) AS n_rest, count(*) FILTER (far) AS n_far, max(buffer_km) AS buffer_km, count(*) FILTER (far) < greatest(4, n_test) AS fb FROM judged JOIN nt USING (seed, region) GROUP BY 1,2,3,4)",
      f"""spl AS (SELECT seed, region, row_id, CASE WHEN place <= {minimum} THEN 'val' ELSE 'train' END AS role FROM (SELECT j.*, row_number() OVER (PARTITION BY j.seed, j.region
          ORDER BY {_md5("'val'",'j.seed','j.region','row_id')}, row_id) AS place, count(*) OVER (PARTITION BY j.seed, j.region) AS n FROM judged j JOIN inf USING (seed, region) WHERE far OR fb)
          UNION ALL SELECT seed, region, row_id, 'test' FROM test)"""]


_INFO = """SELECT seed, region, n_test, round(n_test/n_region::DOUBLE,6) AS n_test_frac, n_blocks_held_out, n_train, n_val, round(buffer_km,6) AS buffer_km,
  CASE WHEN fb THEN 0 ELSE n_rest-n_far END AS n_excluded_by_buffer, fb::INT AS buffer_fallback FROM inf JOIN (SELECT seed, region, count(*) FILTER (role='train') AS n_train,
  count(*) FILTER (role='val') AS n_val FROM spl GROUP BY 1,2) USING (seed, region) JOIN (SELECT region, count(*) AS n_region FROM sites GROUP BY 1) USING (region)"""


def _info(info):
    return info.select("seed", "region", "n_test", F.round("n_test_frac", 6).alias("n_test_frac"), "n_blocks_held_out", "n_train", "n_val",
                       F.round("buffer_km", 6).alias("buffer_km"), "n_excluded_by_buffer", F.col("buffer_fallback").cast("int").alias("buffer_fallback"))


@query(with_sql(_buffer_sql("region"), "SELECT * FROM spl"))
def buffered_region_split(spark, sf):
    return S.buffered_splits(sites(spark, sf), _held(spark, sf))[0]


@query(with_sql(_buffer_sql("region"), _INFO))
def buffered_region_split_info(spark, sf):
    return _info(S.buffered_splits(sites(spark, sf), _held(spark, sf))[1])


@query(with_sql(_buffer_sql("global"), _INFO))
def buffered_global_split_info(spark, sf):
    return _info(S.buffered_splits(sites(spark, sf), _held(spark, sf), pool="global")[1])


@query(with_sql([SITES], f"""SELECT 42 AS seed, region, row_id FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY {_md5("'hold'", '42', 'region', 'row_id')}, row_id) AS place,
  count(*) OVER (PARTITION BY region) AS n FROM sites) WHERE place <= greatest(1, round_even(n*0.15, 0))"""))
def random_hold_out(spark, sf):
    return S.random_hold_out(sites(spark, sf).select(F.lit(42).alias("seed"), "region", "row_id"), ["seed", "region"], 0.15)


@query(with_sql(_LORO, """SELECT seed, fold AS region, row_id, role AS stored_role, CASE WHEN row_id % 10 = 3 THEN NULL WHEN row_id % 10 = 4 AND role = 'train' THEN 'val' ELSE role END AS rebuilt_role
  FROM loro WHERE row_id % 10 = 3 OR (row_id % 10 = 4 AND role = 'train')"""))
def split_audit(spark, sf):
    a = S.leave_one_region_out(sites(spark, sf), [42, 1]).withColumnRenamed("fold", "region")
    changed = F.when((F.col("row_id") % 10 == 4) & (F.col("role") == "train"), "val").otherwise(F.col("role"))
    b = a.filter(F.col("row_id") % 10 != 3).withColumn("role", changed)
    return S.split_differences(a, b)


@query(with_sql(_buffer_sql("region") + [f"md AS (SELECT t.seed, t.region, t.row_id, min({hav_sql('t','r')}) AS d FROM tl t JOIN (SELECT spl.seed, spl.region, s.lat, s.lon FROM spl JOIN sites s USING (row_id) WHERE role='train') r ON r.seed=t.seed AND r.region=t.region GROUP BY 1,2,3)",
  "f AS (SELECT seed, region, min(d) AS min_km FROM md GROUP BY 1,2)"],
  """SELECT count(*) AS n_folds, round(min(min_km),6) AS min_of_min, round(median(min_km),6) AS median_of_min, round(max(min_km),6) AS max_of_min,
     round(avg(min_km/buffer_km),6) AS mean_ratio_to_buffer, count(*) FILTER (min_km > buffer_km) AS n_beyond_buffer, count(*) FILTER (fb) AS n_fallback FROM f JOIN inf USING (seed, region)"""))
def fold_distance_summary(spark, sf):
    s = sites(spark, sf)
    splits, info = S.buffered_splits(s, _held(spark, sf))
    located = splits.join(s.select("row_id", "lat", "lon"), "row_id")
    near = nearest_pool_distance(located.filter("role = 'test'"), located.filter("role = 'train'"), by=("seed", "region"))
    folds = near.groupBy("seed", "region").agg(F.min("dist_km").alias("min_km")).join(info, ["seed", "region"])
    out = S.fold_summary(folds)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(with_sql([SITES], "SELECT region, count(*) FILTER (label=1) AS n_pos, count(*) FILTER (label=0) AS n_neg FROM sites GROUP BY region"))
def test_class_counts(spark, sf):
    return sites(spark, sf).groupBy("region").agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg"))


@query()
def spatial_blocks_kmeans(spark, sf):
    s = sites(spark, sf)
    blocks = S.spatial_blocks(s, S.default_block_count(0.15), 42)
    return blocks.groupBy("block").agg(F.count("*").alias("n"))


@query()
def regional_block_split(spark, sf):
    """K-means blocks cut per region, whole blocks held out, buffer applied."""
    s = materialize(sites(spark, sf))
    blocks = S.regional_blocks(s, S.default_block_count(0.15), 42)
    return S.buffered_splits(s, S.hold_out_blocks(materialize(blocks)))[1]


@query(with_sql(_buffer_sql("region"), "SELECT seed, region, 'n_test' AS fields FROM inf WHERE seed = 2"))
def split_info_audit(spark, sf):
    stored = materialize(S.buffered_splits(sites(spark, sf), _held(spark, sf))[1])
    rebuilt = stored.withColumn("n_test", F.when(F.col("seed") == 2, F.col("n_test") + 1).otherwise(F.col("n_test"))).withColumn(
        "buffer_km", F.col("buffer_km") + 1e-12)
    return S.info_differences(stored, rebuilt).withColumn("fields", F.array_join("fields", ","))


@query()
def split_strategy_comparison(spark, sf):
    """Whole blocks against random rows, same buffer rule."""
    s = sites(spark, sf)
    held = {"block": _held(spark, sf), "buffer": S.random_hold_out(_blocks(spark, sf).drop("block"), ["seed", "region"], 0.15)}
    infos, distances = [], []
    for name, h in held.items():
        splits, info = S.buffered_splits(s, h, strategy=name)
        located = splits.join(s.select("row_id", "lat", "lon"), "row_id")
        near = nearest_pool_distance(located.filter("role = 'test'"), located.filter("role = 'train'"), by=("seed", "region"))
        infos.append(info)
        distances.append(near.groupBy("seed", "region").agg(F.min("dist_km").alias("min_km")).withColumn("split_strategy", F.lit(name)))
    return S.strategy_summary(infos[0].unionByName(infos[1]), distances[0].unionByName(distances[1]))


@query()
def data_fingerprint(spark, sf):
    s = sites(spark, sf)
    return S.manifest_meta(s, S.leave_one_region_out(s, [42, 1]), val_ratio=0.2)
