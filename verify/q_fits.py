"""Many models at once: logistic fits by Newton rounds, leaf-wise boosting."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from occgraph.functions.hashing import hash_uniform
from occgraph.operators import boosting as B
from occgraph.operators import newton as L
from occgraph.operators import perceptron as N
from occgraph.operators import prep as P
from occgraph.operators import splits as S
from occgraph.plans.baseline import baseline_sweep, baseline_vectors
from occgraph.session import materialize, small_values
from verify.q_eval import rd
from verify.q_models import records
from verify.registry import query
from verify.views import FLAGS, ROLES, SITE_ATTRS, SITES, roles, site_attrs, sites, table, u_sql, with_sql


def _flagged(spark, sf):
    """Label and one flag a site: the fit on a flag has a closed form."""
    return sites(spark, sf).join(site_attrs(spark, sf).select("row_id", F.array(F.col("is_f1").cast("double")).alias("features")), "row_id")


_CELLS = "cells AS (SELECT region, count(*) FILTER (is_f1=0) AS n0, sum(label) FILTER (is_f1=0) AS s0, count(*) FILTER (is_f1=1) AS n1, coalesce(sum(label) FILTER (is_f1=1),0) AS s1 FROM sites JOIN site_attrs USING (row_id) GROUP BY region)"
_OTHERS = "others AS (SELECT c.region, sum(o.n0) AS n0, sum(o.s0) AS s0, sum(o.n1) AS n1, sum(o.s1) AS s1 FROM cells c JOIN cells o ON o.region <> c.region GROUP BY c.region)"


def _closed_form(name: str) -> str:
    return f"""SELECT region AS model, (n0+n1)::BIGINT AS n, round(ln(s0::DOUBLE/(n0-s0)),5) AS intercept,
  round(CASE WHEN n1=0 THEN 0.0::DOUBLE ELSE ln(s1::DOUBLE/(n1-s1))-ln(s0::DOUBLE/(n0-s0)) END,5) AS coefficient FROM {name} WHERE s0>0 AND s0<n0 AND (n1=0 OR (s1>0 AND s1<n1))"""


def _fitted(data, on):
    fits = L.logistic_fits(data, "region", on=on, l2=0.0, max_rounds=25)
    return rd(fits.filter("converged").select("model", "n", "intercept", F.element_at("coefficients", 1).alias("coefficient")), digits=5)


@query(with_sql([SITES, SITE_ATTRS, _CELLS], _closed_form("cells")))
def region_logistic_fits(spark, sf):
    """A model a region on its own sites, all in the same jobs."""
    return _fitted(_flagged(spark, sf), "own")


@query(with_sql([SITES, SITE_ATTRS, _CELLS, _OTHERS], _closed_form("others")))
def leave_region_out_logistic_fits(spark, sf):
    """A model a region on the sites of all others."""
    return _fitted(_flagged(spark, sf), "others")


def _site_rows(spark, sf):
    """Roles, a label that follows latitude with every fifth one turned, and five numbers a site."""
    a = site_attrs(spark, sf)
    turned = hash_uniform(F.lit("turned"), F.col("row_id")) < 0.2
    numbers = F.array(*[F.col(c).cast("double") for c in ("lat", "lon", "balance", "n_orders", "is_f1")])
    return roles(spark, sf).join(a, "row_id").select(
        "row_id", "role", "region", ((F.col("lat") > 0) != turned).cast("double").alias("label"), numbers.alias("features"))


_ROWS = f"made AS (SELECT row_id, role, region, ((lat > 0) <> ({u_sql(chr(39) + 'turned' + chr(39), 'row_id')} < 0.2))::INT AS label FROM roles)"


@query(with_sql([SITES, SITE_ATTRS, """counts AS (SELECT """ + ", ".join(
    f"sum({f}) AS n_{f}, sum({f}*label) AS s_{f}" for f in FLAGS) + """, count(*) AS n, sum(label) AS s FROM sites JOIN site_attrs USING (row_id))""",
    "gains AS (" + " UNION ALL ".join(
        f"SELECT '{f}' AS flag, {i} AS i, n_{f} AS n1, s_{f} AS s1, n-n_{f} AS n0, s-s_{f} AS s0, s::DOUBLE/n AS p FROM counts" for i, f in enumerate(FLAGS)) + ")",
    """best AS (SELECT * FROM gains WHERE n1>0 AND n0>0 ORDER BY round(pow(n0*p-s0,2)/(n0*p*(1-p))+pow(n1*p-s1,2)/(n1*p*(1-p)),9) DESC, i LIMIT 1)"""],
    "SELECT row_id, round(1/(1+exp(-(ln(p/(1-p))-CASE WHEN x=1 THEN (n1*p-s1)/(n1*p*(1-p)) ELSE (n0*p-s0)/(n0*p*(1-p)) END))),6) AS score FROM ("
    + " UNION ALL ".join(f"SELECT row_id, '{f}' AS flag, {f} AS x FROM site_attrs" for f in FLAGS) + ") JOIN best USING (flag)"))
def boosted_stump(spark, sf):
    """One tree of one split on five flags, by its gradient and Hessian sums."""
    data = sites(spark, sf).join(site_attrs(spark, sf).select("row_id", F.array(*[F.col(f).cast("double") for f in FLAGS]).alias("features")), "row_id")
    stump = B.BoostConfig(iterations=1, leaves=2, learning_rate=1.0, min_rows=1, l2=0.0, row_share=1.0, feature_share=1.0)
    fit = B.fit_boosted(data.withColumns({"trains": F.array(F.lit(0)), "watches": F.array().cast("array<int>")}), 1, stump)
    return data.select("row_id", F.round(fit.score(F.col("features"), F.lit(0)), 6).alias("score"))


@query(with_sql([ROLES, _ROWS], "SELECT count(*) AS n_val, TRUE AS loss_fell, TRUE AS stopped, TRUE AS kept_the_best, TRUE AS better_than_the_rate FROM made WHERE role='val'"))
def boosted_early_stop(spark, sf):
    """Leaf-wise growth on train rows, stopped by val rows, judged on test rows."""
    data = _site_rows(spark, sf)
    config = B.BoostConfig(learning_rate=0.2, patience=8)
    fit = B.boosted_with_stop(data, config)
    losses, n = fit.losses[0], len(fit.trees[0])
    rate = data.filter("role = 'train'").agg(F.avg("label")).first()[0]
    p = fit.score(F.col("features"), F.lit(0))
    loss = lambda q: F.avg(F.when(F.col("role") == "test", -F.when(F.col("label") == 1, F.log(q)).otherwise(F.log(1 - q))))
    return data.withColumn("p", p).agg(
        F.count_if(F.col("role") == "val").alias("n_val"), F.lit(losses[n] < losses[0]).alias("loss_fell"), F.lit(n < config.iterations).alias("stopped"),
        F.lit(n == losses.index(min(losses))).alias("kept_the_best"), (loss(F.col("p")) < loss(F.lit(rate))).alias("better_than_the_rate"))


@query(with_sql([ROLES, _ROWS], "SELECT count(*) AS n_val, TRUE AS loss_fell, TRUE AS kept_the_best, TRUE AS better_than_the_rate FROM made WHERE role='val'"))
def perceptron_early_stop(spark, sf):
    """Two hidden layers of the published size, stopped by val rows, judged on test rows."""
    data = _site_rows(spark, sf).withColumn("features", F.transform("features", lambda v: F.coalesce(v, F.lit(0.0))))
    model = N.Perceptron(batch=50, step=0.003).fit(data)
    rate = data.filter("role = 'train'").agg(F.avg("label")).first()[0]
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), model.score(F.col("features"))))
    loss = lambda q: F.avg(F.when(F.col("role") == "test", -F.when(F.col("label") == 1, F.log(q)).otherwise(F.log(1 - q))))
    best = min(model.losses)
    return data.withColumn("p", p).agg(
        F.count_if(F.col("role") == "val").alias("n_val"), F.lit(best < model.losses[0]).alias("loss_fell"),
        F.lit(len(model.losses) == model.rounds or len(model.losses) - 1 - model.losses.index(best) == model.patience).alias("kept_the_best"),
        (loss(F.col("p")) < loss(F.lit(rate))).alias("better_than_the_rate"))


@query(with_sql([ROLES], "SELECT row_id, role, TRUE AS is_probability FROM roles"))
def boosted_out_of_fold_scores(spark, sf):
    """Five folds and the refit grow in the same jobs; every row has one score."""
    scores, _ = B.boosted_out_of_fold(_site_rows(spark, sf), B.BoostConfig(iterations=12, learning_rate=0.2))
    return scores.select("row_id", "role", F.coalesce(F.col("score").between(0, 1), F.lit(False)).alias("is_probability"))


@query(with_sql([ROLES, _ROWS, """status AS (SELECT region, CASE WHEN n_test=0 OR n_train<30 OR train_classes<2 OR test_classes<2 THEN 0 ELSE 1 END AS fits FROM (
  SELECT region, count(*) FILTER (role<>'test') AS n_train, count(*) FILTER (role='test') AS n_test, count(DISTINCT label) FILTER (role<>'test') AS train_classes,
  count(DISTINCT label) FILTER (role='test') AS test_classes FROM made GROUP BY region))"""],
  "SELECT 'pooled' AS model, region, count(*) AS n, sum(label)::BIGINT AS n_pos, TRUE AS is_probability FROM made WHERE role='test' GROUP BY region UNION ALL "
  "SELECT 'by_group', region, count(*), sum(label)::BIGINT, TRUE FROM made JOIN status USING (region) WHERE role='test' AND fits=1 GROUP BY region"))
def boosted_pooled_vs_grouped(spark, sf):
    """The pooled model and every region's own grow together; each scores the same held-out rows."""
    preds, _ = B.boosted_pooled_and_grouped(_site_rows(spark, sf), "region", B.BoostConfig(iterations=12, learning_rate=0.2))
    return preds.groupBy("model", "region").agg(
        F.count("*").alias("n"), F.sum("label").cast("long").alias("n_pos"), F.min(F.coalesce(F.col("y_prob").between(0, 1), F.lit(False))).alias("is_probability"))


@query(with_sql([ROLES, SITE_ATTRS], "SELECT row_id, role, label, 6 AS n_features, TRUE AS is_probability FROM roles JOIN site_attrs USING (row_id)"))
def baseline_score_vectors(spark, sf):
    """Five selected columns and a single model's out-of-fold score a record."""
    data = records(spark, sf)
    prep = P.FeaturePrep().fit(data.filter("role = 'train'"))
    made, _ = baseline_vectors(materialize(prep.transform(data, keep=["role", "label"])), prep.names(), B.BoostConfig(iterations=12, learning_rate=0.2), top=5)
    x = vector_to_array("features")
    return made.select("row_id", "role", "label", F.size(x).alias("n_features"), F.element_at(x, -1).between(0, 1).alias("is_probability"))


@query(with_sql([SITES, SITE_ATTRS], "SELECT model, region, count(*) AS n, sum(label)::BIGINT AS n_pos, TRUE AS is_probability FROM sites JOIN site_attrs USING (row_id), (VALUES ('logistic'), ('forest')) m (model) GROUP BY ALL"))
def baseline_region_sweep(spark, sf):
    """Every region held out once; two classifiers on the same baseline vectors."""
    data = records(spark, sf).drop("role")
    cases = [(42, r) for r in small_values(data, "region")]
    builders = {"logistic": lambda s: LogisticRegression(labelCol="label"), "forest": lambda s: RandomForestClassifier(labelCol="label", numTrees=20, maxDepth=5, seed=s)}
    preds = baseline_sweep(data, S.leave_one_region_out(data, [42]), cases, builders, B.BoostConfig(iterations=5, learning_rate=0.3), top=5, n_folds=3)
    return preds.groupBy("model", "region").agg(
        F.count("*").alias("n"), F.sum("y_true").cast("long").alias("n_pos"), F.min(F.col("y_prob").between(0, 1)).alias("is_probability"))


# --- wide categories: a value for nearly every line item -----------------------------

def _lines(spark, sf):
    value = F.when(F.col("l_orderkey") % 9 != 0, F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", value.alias("line"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"))


_INDEX = ["""lines AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey%9<>0 THEN l_orderkey||'-'||l_linenumber END AS line, l_returnflag AS flag, l_quantity AS quantity FROM lineitem)""",
  """idx AS (SELECT 'line' AS col, v, row_number() OVER (ORDER BY md5('line|'||v), v) - 1 AS place FROM (SELECT DISTINCT coalesce(line,'Unknown') AS v FROM lines WHERE l_orderkey%5<>0 UNION SELECT 'Unknown')
  UNION ALL SELECT 'flag', v, row_number() OVER (ORDER BY md5('flag|'||v), v) - 1 FROM (SELECT DISTINCT coalesce(flag,'Unknown') AS v FROM lines WHERE l_orderkey%5<>0 UNION SELECT 'Unknown'))"""]


@query(with_sql(_INDEX, """SELECT l_orderkey, l_linenumber, coalesce(a.place, (SELECT place FROM idx WHERE col='line' AND v='Unknown')) AS line_place,
  coalesce(b.place, (SELECT place FROM idx WHERE col='flag' AND v='Unknown')) AS flag_place
  FROM lines LEFT JOIN idx a ON a.col='line' AND a.v=coalesce(line,'Unknown') LEFT JOIN idx b ON b.col='flag' AND b.v=coalesce(flag,'Unknown')"""))
def wide_category_places(spark, sf):
    """Every line item's category among all that the fit rows have, by a join."""
    lines = _lines(spark, sf)
    index = P.category_index(lines.filter("l_orderkey % 5 <> 0"), ["line", "flag"])
    return P.with_places(lines, index, ["line", "flag"]).select("l_orderkey", "l_linenumber", "line_place", "flag_place")


@query(with_sql([*_INDEX, """given AS (SELECT 'line' AS col, coalesce(line,'Unknown') AS v, count(*) AS n FROM lines GROUP BY ALL UNION ALL SELECT 'flag', coalesce(flag,'Unknown'), count(*) FROM lines GROUP BY ALL)""",
  "unknown AS (SELECT col, place FROM idx WHERE v='Unknown')"],
  """SELECT 1 + CASE g.col WHEN 'flag' THEN (SELECT count(*) FROM idx WHERE col='line') ELSE 0 END + coalesce(i.place, u.place) AS place, sum(n)::DOUBLE AS total
  FROM given g JOIN unknown u USING (col) LEFT JOIN idx i ON i.col=g.col AND i.v=g.v GROUP BY 1 UNION ALL SELECT 0, round(sum(quantity),6) FROM lines"""))
def wide_category_vectors(spark, sf):
    """Sparse vectors added up: how often each place of the vector is set."""
    lines = _lines(spark, sf)
    prep = P.SparsePrep(["quantity"], ["line", "flag"]).fit(lines.filter("l_orderkey % 5 <> 0"))
    sums = P.vector_sums(prep.transform(lines, ["l_orderkey"]), "features")
    return sums.filter("total <> 0").select("place", F.round("total", 6).alias("total"))


# --- K-means of all regions and starts together --------------------------------------

@query(with_sql([SITES], "SELECT region, count(*) AS n, 13 AS n_blocks, TRUE AS at_nearest_mean FROM sites WHERE region IS NOT NULL GROUP BY region HAVING count(DISTINCT (lat, lon)) >= 13"))
def regional_kmeans_blocks(spark, sf):
    """Every site is in the block whose mean is the nearest of its region's: where Lloyd's rounds end."""
    s = sites(spark, sf)
    blocks = S.regional_blocks(s, S.default_block_count(0.15), 42).drop("seed")
    placed = s.select("row_id", *[c.alias(n) for n, c in S.unit_xyz(F.col("lat"), F.col("lon")).items()]).join(blocks, "row_id")
    means = placed.groupBy("region", "block").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    square = sum((F.col(c) - F.col(f"m{c}")) ** 2 for c in "xyz")
    own = placed.join(means, ["region", "block"]).select("region", "row_id", square.alias("own"))
    least = placed.drop("block").join(means, "region").groupBy("region", "row_id").agg(F.min(square).alias("least"))  # 13 means a region
    counts = blocks.groupBy("region").agg(F.count("*").alias("n"), F.count_distinct("block").cast("int").alias("n_blocks"))
    return own.join(least, ["region", "row_id"]).groupBy("region").agg(F.min(F.col("own") <= F.col("least") + 1e-9).alias("at_nearest_mean")).join(counts, "region").select(
        "region", "n", "n_blocks", "at_nearest_mean")
