"""Feature preparation, interpolation, models, sweeps, sinks and streaming."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.sql import functions as F

from occgraph.functions import rules as R
from occgraph.functions import text as X
from occgraph.operators import graph as G
from occgraph.operators import interpolation as N
from occgraph.operators import models as M
from occgraph.operators import prep as P
from occgraph.operators import rewire as RW
from occgraph.operators import splits as S
from occgraph.operators import table as B
from occgraph.operators.knn import knn_graph_pairs
from occgraph.operators.metrics import all_metrics
from occgraph.operators.ranking import medians
from occgraph.plans import processed as PL
from occgraph.plans.region_sweep import SweepConfig, fit_fold, run_sweep, score_held_out
from occgraph.plans.sweeps import compare_conditions, condition_metrics, condition_sweep
from occgraph.session import FEW_ROWS, materialize, row_sized, shared_dir
from occgraph.sources import io
from occgraph.streaming.attach import score_stream, scored_rows
from verify.q_eval import rd
from verify.q_spatial import _ATTACH, graph_sql, nodes
from verify.registry import query
from verify.views import FEATS, FEATS_COLS, FLAGS, OCC, ROLES, SITE_ATTRS, SITES, feats, knn_sql, occ, roles, site_attrs, sites, table, with_sql


# --- preparation ------------------------------------------------------------

@query(with_sql([ROLES], """SELECT row_id, round((lat-ml)/sl,6) AS lat_z, round((lon-mo)/so,6) AS lon_z FROM roles,
  (SELECT avg(lat) AS ml, stddev_pop(lat) AS sl, avg(lon) AS mo, stddev_pop(lon) AS so FROM roles WHERE role='train')"""))
def zscore_fit_scope(spark, sf):
    r = roles(spark, sf)
    return rd(P.zscore(r, P.zscore_state(r.filter("role = 'train'"), ["lat", "lon"])).select("row_id", "lat_z", "lon_z"))


@query(with_sql([SITES], """SELECT row_id, round((lat-avg(lat) OVER ())/stddev_pop(lat) OVER (),6) AS lat_z, round((lon-avg(lon) OVER ())/stddev_pop(lon) OVER (),6) AS lon_z FROM sites"""))
def zscore_all_rows(spark, sf):
    s = sites(spark, sf)
    return rd(P.zscore(s, P.zscore_state(s, ["lat", "lon"])).select("row_id", "lat_z", "lon_z"))


@query(with_sql([OCC], "SELECT row_id, " + ", ".join(f"""coalesce((rec_type='{c}')::INT,0) AS "rec_type_{c}" """ for c in R.RECORD_TYPES) + " FROM occ"))
def fixed_category_onehot(spark, sf):
    return occ(spark, sf).select("row_id", *P.fixed_one_hot("rec_type", R.RECORD_TYPES, "rec_type"))


@query(with_sql([SITES], """SELECT row_id, CASE WHEN country IN (SELECT DISTINCT country FROM sites WHERE region<>'ASIA') THEN country ELSE 'Unknown' END AS category FROM sites"""))
def fit_onehot_unknown(spark, sf):
    s = sites(spark, sf)
    cats = P.fit_categories(s.filter("region <> 'ASIA'"), "country")
    return s.select("row_id", P.known_category("country", cats).alias("category"))


@query(with_sql([ROLES, SITE_ATTRS, "md AS (SELECT median(balance) AS b, median(avg_total) AS t FROM site_attrs JOIN roles USING (row_id) WHERE role='train')"],
  "SELECT row_id, round(coalesce(balance,b),6) AS balance, round(coalesce(avg_total,t),6) AS avg_total FROM site_attrs, md"))
def median_impute(spark, sf):
    a = site_attrs(spark, sf)
    mid = medians(a.join(roles(spark, sf).filter("role = 'train'").select("row_id"), "row_id"), ["balance", "avg_total"])
    return rd(a.select("row_id", *[F.coalesce(F.col(c), F.lit(mid[c])).alias(c) for c in mid]))


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "Unknown"]


def records(spark, sf):
    """Model input: site, attributes, role and label."""
    a = site_attrs(spark, sf).drop(*FLAGS[2:])
    return roles(spark, sf).select("row_id", "region", "lat", "lon", "label", "role").join(a, "row_id")


@query(with_sql([ROLES, SITE_ATTRS, "t AS (SELECT * FROM roles JOIN site_attrs USING (row_id) WHERE role='train')",
  "st AS (SELECT avg(lat) AS ml, stddev_pop(lat) AS sl, avg(lon) AS mo, stddev_pop(lon) AS so, median(balance) AS b, median(avg_total) AS tt FROM t)"],
  "SELECT row_id, round((lat-ml)/sl,6) AS lat, round((lon-mo)/so,6) AS lon, round(coalesce(balance,b),6) AS balance, round(coalesce(avg_total,tt),6) AS avg_total, n_orders::DOUBLE AS n_orders, " +
  ", ".join(f"(segment='{c}')::INT::DOUBLE AS \"segment_{c}\"" for c in _SEG) + " FROM roles JOIN site_attrs USING (row_id), st"))
def feature_preparation(spark, sf):
    r = records(spark, sf)
    prep = P.FeaturePrep.from_json(P.FeaturePrep().fit(r.filter("role = 'train'")).to_json())
    if "sparse_value" in prep.numeric:
        raise ValueError("a mostly empty column was kept")
    out = prep.encode(r).select("row_id", "lat", "lon", "balance", "avg_total", "n_orders", *[f"segment_{c}" for c in _SEG])
    return rd(out)


@query(with_sql([SITES, FEATS, *graph_sql("mixed")], """SELECT f.row_id, round(f0,6) AS f0, round(f1,6) AS f1, round(f2,6) AS f2, round(0.5*f0+0.1,6) AS score,
  round(coalesce(avg(weight),0),6) AS mean_weight, round(coalesce(max(weight),0),6) AS max_weight FROM feats f LEFT JOIN e ON e.dst = f.row_id GROUP BY 1,2,3,4,5"""))
def node_vector_full(spark, sf):
    n = nodes(spark, sf)
    g = G.build_weighted_graph(n, 15, max_km=200.0)
    f = feats(spark, sf)
    scores = f.select("row_id", (F.col("f0") * 0.5 + 0.1).alias("score"))
    out, names = P.node_features(f.drop("geo"), FEATS_COLS, "full", scores, G.edge_stats(n.select("row_id"), g.edges))
    return rd(out.select("row_id", *names))


# --- interpolation ----------------------------------------------------------

_TT = ["te AS (SELECT * FROM roles WHERE role='test')", "tr AS (SELECT * FROM roles WHERE role='train')"]


@query(with_sql([ROLES, *_TT, knn_sql("n", 15, "te", "tr", False)], """SELECT src AS row_id, round(greatest(0, least(1, coalesce(avg(label::DOUBLE) FILTER (dist_km=0),
  sum(label/dist_km) FILTER (dist_km>0)/sum(1/dist_km) FILTER (dist_km>0)))),6) AS y_prob FROM n JOIN tr ON dst=row_id GROUP BY src"""))
def spatial_knn_regression(spark, sf):
    r = roles(spark, sf)
    return rd(N.inverse_distance(r.filter("role = 'test'"), r.filter("role = 'train'"), 15))


_VARIO = [ROLES, "tr AS (SELECT * FROM roles WHERE role='train')", knn_sql("n", 10, "tr", "tr"),
          "pp AS (SELECT dist_km, pow(a.label-b.label,2)/2 AS g FROM n JOIN tr a ON src=a.row_id JOIN tr b ON dst=b.row_id)",
          "vb AS (SELECT least(floor(dist_km/(SELECT max(dist_km) FROM pp)*12),11)::INT AS bin, count(*) AS n_pairs, avg(dist_km) AS mean_km, avg(g) AS semivariance FROM pp GROUP BY 1)"]


@query(with_sql(_VARIO, "SELECT bin, n_pairs, round(mean_km,6) AS mean_km, round(semivariance,6) AS semivariance FROM vb"))
def variogram_bins(spark, sf):
    return rd(N.semivariogram(roles(spark, sf).filter("role = 'train'"), 10))


@query(with_sql(_VARIO, "SELECT round(regr_slope(semivariance, mean_km),8) AS slope, round(regr_intercept(semivariance, mean_km),8) AS nugget FROM vb"))
def variogram_fit(spark, sf):
    return rd(N.linear_variogram(N.semivariogram(roles(spark, sf).filter("role = 'train'"), 10)), digits=8)


@query()
def local_kriging(spark, sf):
    r = roles(spark, sf)
    train = r.filter("role = 'train'")
    line = N.linear_variogram(N.semivariogram(train, 10)).first()
    return N.local_kriging(r.filter("role = 'test'"), train, line["slope"], line["nugget"], 10)


# --- ranking and selection --------------------------------------------------

_COEF = {"n_orders": 0.3, "is_f1": -1.5, "is_f2": 0.75}


@query(with_sql([SITE_ATTRS, "mn AS (SELECT avg(n_orders) AS n_orders, avg(is_f1) AS is_f1, avg(is_f2) AS is_f2 FROM site_attrs)",
  "cc AS (" + " UNION ALL ".join(f"SELECT '{g}' AS grp, '{c}' AS feature, avg(abs({w}*(a.{c}-mn.{c}))) AS contribution FROM site_attrs a, mn WHERE a.{g}=1" for g in ("is_f3", "is_f4", "is_f5") for c, w in _COEF.items()) + ")"],
  "SELECT grp, feature, round(contribution,6) AS contribution, rn FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY round(contribution,9) DESC, feature) AS rn FROM cc) WHERE rn <= 2"))
def group_contributions(spark, sf):
    return rd(M.linear_contributions(site_attrs(spark, sf), _COEF, ["is_f3", "is_f4", "is_f5"], top=2))


_SEL = "sel AS (SELECT fold, feature FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY p DESC, feature) AS rn FROM (" + " UNION ALL ".join(
    f"SELECT region AS fold, '{f}' AS feature, avg({f}) AS p FROM site_attrs JOIN sites USING (row_id) GROUP BY region" for f in FLAGS) + ")) WHERE rn <= 3)"


@query(with_sql([SITES, SITE_ATTRS, _SEL], """SELECT feature, n_selected, n_folds, n_union, n_always FROM (SELECT feature, count(DISTINCT fold) AS n_selected FROM sel GROUP BY 1), (SELECT count(DISTINCT fold) AS n_folds, count(DISTINCT feature) AS n_union FROM sel),
  (SELECT count(*) AS n_always FROM (SELECT feature FROM sel GROUP BY 1 HAVING count(DISTINCT fold) = (SELECT count(DISTINCT fold) FROM sel)))"""))
def selection_stability(spark, sf):
    from occgraph.operators.analytics import fields_as_rows
    from pyspark.sql import Window as W

    a = site_attrs(spark, sf).join(sites(spark, sf).select("row_id", F.col("region").alias("fold")), "row_id")
    rates = fields_as_rows(a.groupBy("fold").agg(*[F.avg(f).alias(f) for f in FLAGS]), FLAGS, "feature", "p")
    order = W.partitionBy("fold").orderBy(F.desc("p"), "feature")
    return M.selection_stability(rates.withColumn("rn", F.row_number().over(order)).filter("rn <= 3"))


@query(with_sql([ROLES], """SELECT country, n_train, n_test, train_classes, test_classes, CASE WHEN n_test=0 THEN 'no test rows' WHEN n_train<50 THEN 'too few train rows' WHEN train_classes<2 THEN 'single class in train'
  WHEN test_classes<2 THEN 'single class in test' END AS reason FROM (SELECT country, count(*) FILTER (role<>'test') AS n_train, count(*) FILTER (role='test') AS n_test,
  count(DISTINCT label) FILTER (role<>'test') AS train_classes, count(DISTINCT label) FILTER (role='test') AS test_classes FROM roles GROUP BY country)"""))
def fold_eligibility(spark, sf):
    return M.eligible_folds(roles(spark, sf), ["country"], 50)


# --- models (numbers depend on the fitted model: rows only) -----------------

def _forest(seed):
    return RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=5, seed=seed)


def _small(seed):
    return [M.boosted(seed, iterations=4, depth=3), _forest(seed)]


def vectors(spark, sf):
    r = records(spark, sf)
    prep = P.FeaturePrep().fit(r.filter("role = 'train'"))
    return prep, materialize(prep.transform(r, keep=["role", "label", "region"]).withColumn("label", F.col("label").cast("double")))


def _scored_once(scores):
    """A fitted score can't be computed in SQL, but every record has one, and it is a probability."""
    return scores.groupBy("row_id", "role").agg(F.count("*").alias("n_scores"), F.min(F.col("score").between(0, 1).cast("int")).alias("is_probability"))


_ONCE = with_sql([ROLES, SITE_ATTRS], "SELECT row_id, role, 1 AS n_scores, 1 AS is_probability FROM roles JOIN site_attrs USING (row_id)")


@query(_ONCE)
def out_of_fold_scores(spark, sf):
    return _scored_once(M.leakage_free_scores(vectors(spark, sf)[1], factory=_small, n_folds=5)[0])


@query(_ONCE)
def in_sample_scores(spark, sf):
    return _scored_once(M.leakage_free_scores(vectors(spark, sf)[1], factory=lambda s: [_forest(s)], scoring="in_sample")[0])


def _evaluated(scored, name):
    return all_metrics(scored.filter("role = 'test'").select(F.lit(name).alias("model"), F.col("label").cast("int").alias("y_true"), "y_prob", (F.col("y_prob") >= 0.5).cast("int").alias("y_pred")), ["model"])


@query()
def score_only_control(spark, sf):
    prep, v = vectors(spark, sf)
    scores = M.leakage_free_scores(v, factory=lambda s: [_forest(s)], n_folds=5)[0].withColumnRenamed("score", "y_prob")
    return _evaluated(v.select("row_id", "label").join(scores, "row_id"), "score_only")


@query()
def tabular_models(spark, sf):
    prep, v = vectors(spark, sf)
    width = len(prep.names())
    train = v.filter("role = 'train'")
    members = {"boosted": M.boosted(42, 5, 4), "forest": _forest(42), "perceptron": M.perceptron(42, width, (16, 8)), "latent": M.latent_logistic(8), "svm": M.KernelSVM(components=32)}
    out = None
    for name, est in members.items():
        one = _evaluated(M.predict(est.fit(train), v, "y_prob"), name)
        out = one if out is None else out.unionByName(one)
    return out


@query()
def feature_ranking(spark, sf):
    prep, v = vectors(spark, sf)
    model = _forest(42).fit(v.filter("role = 'train'"))
    top = M.tree_importance(model, prep.names(), 10)
    return M.permutation_importance(model, v.filter("role = 'train'"), prep.names()).withColumn("in_top", F.col("feature").isin(top))


@query()
def validation_grid_search(spark, sf):
    _, v = vectors(spark, sf)
    grid = [{"regParam": r, "elasticNetParam": e} for r in (0.001, 0.1) for e in (0.0, 1.0)]
    return M.grid_search(v, grid, lambda s: LogisticRegression(labelCol="label", **s))[2]


@query()
def pooled_vs_grouped_models(spark, sf):
    _, v = vectors(spark, sf)
    scored, _ = M.pooled_or_by_group(v, "region", lambda s: LogisticRegression(labelCol="label"))
    return all_metrics(scored.select("model", "region", F.col("label").cast("int").alias("y_true"), "y_prob", (F.col("y_prob") >= 0.5).cast("int").alias("y_pred")), ["model", "region"])


def _doc_vectors(spark, sf):
    from verify.q_eval import comp

    labels = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("double").alias("label"))
    source = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "source")
    data = comp(spark, sf).join(labels, "row_id").join(source, "row_id")
    return materialize(M.assemble(data, ["n_nonempty_fields", "text_len", "lang_len"], ["row_id", "label", "source"]))


@query()
def documentation_probe(spark, sf):
    return M.cross_validated_probe(_doc_vectors(spark, sf), _forest, 5)


@query()
def documentation_probe_matched(spark, sf):
    """Documentation features only, each source predicted from all others."""
    return M.leave_out_probe(_doc_vectors(spark, sf), "source", lambda s: LogisticRegression(labelCol="label")).select("row_id", "source", "y_prob")


# --- sweeps, control graphs, stream ----------------------------------------

def _one_forest(seed):
    return [_forest(seed)]


def _config(**more):
    return SweepConfig(factory=_one_forest, selector=_forest, n_folds=2, top_features=5, grid=[{"regParam": 0.01}, {"regParam": 0.1}], **more)


_REGIONS = [(42, r) for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")]


def _sweep_input(spark, sf):
    """Records and their folds. Many records are written once: cases that run side by side would each join the view's tables again."""
    r = records(spark, sf).drop("role")
    if table(spark, sf, "customer").count() > FEW_ROWS:
        r = row_sized(materialize(r))
    return r, S.leave_one_region_out(r, [42])


@query()
def leave_region_out_run(spark, sf):
    r, splits = _sweep_input(spark, sf)
    return run_sweep(r, splits, _REGIONS, _config())


@query()
def no_message_passing_run(spark, sf):
    r = records(spark, sf).drop("role")
    splits = S.leave_one_region_out(r, [42])
    return run_sweep(r, splits, _REGIONS, _config(propagation="none"), model="no_graph")


@query()
def weighted_vs_unweighted_run(spark, sf):
    """Two propagation modes on the same folds, tuned apart and compared over all regions."""
    r, splits = _sweep_input(spark, sf)
    swept = condition_sweep(r, splits, _REGIONS, {"mean": _config(use_score=False), "weighted": _config(use_score=False, propagation="weighted_mean")})
    return compare_conditions(condition_metrics(materialize(swept)), "weighted", "mean")


@query()
def model_inputs(spark, sf):
    """All fixed-width model inputs of the processed records."""
    o = occ(spark, sf)
    done, _, _ = PL.processed_table(o, n_tokens=20, drop_region=None)
    done = materialize(B.attach_by_row(done, B.hierarchy_features(o)).drop("ree_mins"))
    tokens, groups = B.columns_with_prefix(done, "has_"), B.columns_with_prefix(done, "is_", ("is_composite_system", "is_part_of_complex"))
    scaled = P.zscore(done, P.zscore_state(done, ["lat", "lon"]))
    wide = scaled.select(
        "*", *X.commodity_flags(F.col("commods")), *P.fixed_one_hot("region", R.REGIONS, "region"),
        *P.fixed_one_hot("rec_type_raw", R.RECORD_TYPES, "rec_type"), *P.fixed_one_hot("system_class", R.SYSTEMS, "system"))
    frame = B.model_frame(wide, tokens, groups)
    return frame.select("row_id", "lat_z", "lon_z", "commodity_count", "system_other", "label")


_LINKS = [SITES, FEATS, *graph_sql("distance", k=5, max_km=2000), "u AS (SELECT DISTINCT src, dst FROM e)"]


def _rewired(spark, sf):
    edges = materialize(G.build_weighted_graph(sites(spark, sf), 5, strategy="distance").edges)
    return edges, RW.rewire(edges)


@query(with_sql(_LINKS, "SELECT dst AS row_id, count(*) AS degree FROM u GROUP BY dst"))
def rewired_degrees(spark, sf):
    return RW.as_edges(_rewired(spark, sf)[1]).groupBy(F.col("dst").alias("row_id")).agg(F.count("*").alias("degree"))


@query(with_sql(_LINKS, "SELECT count(*) AS n_before, count(*) AS n_after, TRUE AS mostly_changed, TRUE AS same_weights FROM u WHERE src < dst"))
def rewiring_report(spark, sf):
    """Two swaps a link: most links are new, and their weights are the old ones dealt anew."""
    edges, after = _rewired(spark, sf)
    report = RW.rewiring_report(RW.undirected(edges), after)
    return report.select("n_before", "n_after", (F.col("n_changed") > F.col("n_before") / 2).alias("mostly_changed"), "same_weights")


@query(with_sql(_ATTACH, "SELECT src, dst, round(weight,6) AS weight FROM att"))
def stream_attach(spark, sf):
    """Held-out records arriving as files, attached by a stream."""
    n = nodes(spark, sf)
    tv = materialize(n.filter("role <> 'test'"))
    sigma = G.build_weighted_graph(tv, 15, alpha=0.5, max_km=200.0, fit_role="train").sigma
    base = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    test = n.filter("role = 'test'").select("row_id", "lat", "lon", "geo")
    test.repartition(3).write.parquet(f"{base}/in")
    score = lambda batch: G.attach_held_out(batch, tv, sigma, k=10, max_km=200.0)
    run = score_stream(spark, f"{base}/in", test.schema, score, f"{base}/out", f"{base}/state", max_files=2)
    run.awaitTermination()
    return scored_rows(spark, f"{base}/out").select("src", "dst", F.round("weight", 6).alias("weight"))


@query()
def stream_score(spark, sf):
    """Held-out records through the whole fitted fold, by a stream."""
    r = records(spark, sf)
    fold = fit_fold(r, _config())
    base = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    test = r.filter("role = 'test'")
    test.repartition(2).write.parquet(f"{base}/in")
    run = score_stream(spark, f"{base}/in", test.schema, lambda b: score_held_out(fold, b), f"{base}/out", f"{base}/state")
    run.awaitTermination()
    return scored_rows(spark, f"{base}/out").select("row_id", "y_prob", "y_pred")


# --- whole pipeline, sinks and sources --------------------------------------

@query(with_sql([OCC], """SELECT count(*) AS n, (count(*) FILTER (ree_mins IS NOT NULL))::BIGINT AS n_label FROM occ WHERE region IS DISTINCT FROM 'AFRICA'"""))
def processed_table(spark, sf):
    done, _, _ = PL.processed_table(occ(spark, sf), n_tokens=20, drop_region="AFRICA")
    return done.agg(F.count("*").alias("n"), F.sum("label").alias("n_label"))


@query()
def released_graph(spark, sf):
    done, _, _ = PL.processed_table(occ(spark, sf), n_tokens=20, drop_region=None)
    g = PL.released_graph(done, [c for c in done.columns if c.startswith("is_")], k=5)
    return G.degree_by_region(g.nodes, g.edges)


@query(with_sql([SITES, knn_sql("n", 3)], """SELECT e.src, e.dst, round(e.dist_km,5) AS dist_km, round(e.weight,9) AS weight, s.region AS src_region, s.label AS src_label FROM (
  SELECT src, dst, dist_km, 1.0::DOUBLE/rn AS weight FROM n UNION ALL SELECT dst, src, dist_km, 1.0::DOUBLE/rn FROM n) e JOIN sites s ON s.row_id = e.src"""))
def graph_sink_round_trip(spark, sf):
    """Edges with their weights, and the nodes and targets they belong to, as written and read back."""
    s = sites(spark, sf)
    edges = G.both_directions(knn_graph_pairs(s, 3).withColumn("weight", 1.0 / F.col("rn")))
    path = f"{shared_dir(spark)}/sink/{uuid.uuid4().hex}"
    io.write_graph(s, edges, path)
    read = io.scan(spark, f"{path}/nodes", columns=["row_id", "region", "label"]).toDF("src", "src_region", "src_label")
    return io.scan(spark, f"{path}/edges", columns=["src", "dst", "dist_km", "weight"]).join(read, "src").select(
        "src", "dst", F.round("dist_km", 5).alias("dist_km"), F.round("weight", 9).alias("weight"), "src_region", "src_label")


def _round_trip(spark, sf, fmt):
    s = site_attrs(spark, sf).select("row_id", "segment", "balance")
    path = f"{shared_dir(spark)}/sink/{uuid.uuid4().hex}.{fmt}"
    io.write_table(s, path, fmt=fmt) if fmt != "csv" else s.write.option("header", True).csv(path)
    return io.scan(spark, path, schema=s.schema)


@query(with_sql([SITE_ATTRS], "SELECT row_id, segment, balance FROM site_attrs"))
def csv_round_trip(spark, sf):
    return _round_trip(spark, sf, "csv")


@query(with_sql([SITE_ATTRS], "SELECT row_id, segment, balance FROM site_attrs"))
def json_round_trip(spark, sf):
    return _round_trip(spark, sf, "json")


@query(with_sql([SITE_ATTRS], "SELECT row_id, segment, CASE WHEN segment='BUILDING' THEN balance+1 ELSE balance END AS balance FROM site_attrs"))
def partition_overwrite(spark, sf):
    s = site_attrs(spark, sf).select("row_id", "balance", "segment")
    path = f"{shared_dir(spark)}/sink/{uuid.uuid4().hex}"
    io.write_table(s, path, partition_by=["segment"])
    io.replace_partitions(s.filter("segment = 'BUILDING'").withColumn("balance", F.col("balance") + 1), path, ["segment"])
    return spark.read.schema(s.schema).parquet(path)
