"""Metrics, inference, diagnostics and result-set management on predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from occgraph.functions import text as X
from occgraph.operators import analytics as A
from occgraph.operators import infer as I
from occgraph.operators import metrics as M
from occgraph.operators import resultsets as RS
from occgraph.operators.ranking import grouped_quantiles
from occgraph.operators.table import label_not_null
from occgraph.session import materialize, shared_dir
from occgraph.sources import io, json_leaves, runs
from verify.registry import query
from verify.views import DOCS, FLAGS, OCC, PREDS, SEEDS, SITE_ATTRS, SITES, docs, knn_sql, occ, preds, site_attrs, sites, u_sql, with_sql

K3 = ["model", "seed", "region"]


def rd(df, *skip, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


_CONF = """conf AS (SELECT model, seed, region, count(*) FILTER (y_true=1 AND y_pred=1) AS tp, count(*) FILTER (y_true=0 AND y_pred=0) AS tn,
  count(*) FILTER (y_true=0 AND y_pred=1) AS fp, count(*) FILTER (y_true=1 AND y_pred=0) AS fn, count(*) AS n FROM preds GROUP BY 1,2,3)"""
_CM = """cm AS (SELECT model, seed, region, n, (tp+tn)/n::DOUBLE AS accuracy, coalesce(tp/nullif(tp+fp,0)::DOUBLE,0) AS precision,
  coalesce(tp/nullif(tp+fn,0)::DOUBLE,0) AS recall, coalesce(2*tp/nullif(2*tp+fp+fn,0)::DOUBLE,0) AS f1 FROM conf)"""


def auc_sql(name, keys, source="preds", w="1"):
    return f"""{name} AS (SELECT {keys}, n_pos, n_neg, CASE WHEN n_pos>0 AND n_neg>0 THEN wins/(n_pos::DOUBLE*n_neg) END AS roc_auc,
      CASE WHEN n_pos>0 AND n_neg>0 THEN steps/n_pos END AS pr_auc FROM (SELECT {keys}, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg,
      sum(pos*(cn - neg/2.0::DOUBLE))::DOUBLE AS wins, sum(pos*(dp::DOUBLE/nullif(dp+dn,0))) AS steps FROM (
      SELECT *, sum(neg) OVER (PARTITION BY {keys} ORDER BY y_prob) AS cn, sum(pos) OVER (PARTITION BY {keys} ORDER BY y_prob DESC) AS dp, sum(neg) OVER (PARTITION BY {keys} ORDER BY y_prob DESC) AS dn
      FROM (SELECT {keys}, y_prob, sum({w}*y_true) AS pos, sum({w}*(1-y_true)) AS neg FROM {source} GROUP BY {keys}, y_prob)) GROUP BY {keys}))"""


_AUC = auc_sql("auc", "model, seed, region")


@query(with_sql([PREDS, _CONF, _CM], "SELECT model, seed, region, n, round(accuracy,6) AS accuracy, round(precision,6) AS precision, round(recall,6) AS recall, round(f1,6) AS f1 FROM cm"))
def classification_metrics(spark, sf):
    return rd(M.classification_metrics(preds(spark, sf), K3))


@query(with_sql([PREDS, _AUC], "SELECT model, seed, region, n_pos, n_neg, round(roc_auc,6) AS roc_auc FROM auc"))
def roc_auc_grouped(spark, sf):
    return rd(M.rank_metrics(preds(spark, sf), K3).drop("pr_auc"))


@query(with_sql([PREDS, _AUC], "SELECT model, seed, region, round(pr_auc,6) AS pr_auc FROM auc"))
def average_precision_grouped(spark, sf):
    return rd(M.rank_metrics(preds(spark, sf), K3).select(*K3, "pr_auc"))


@query(with_sql([PREDS, auc_sql("auc", "model")], "SELECT model, n_pos, n_neg, round(roc_auc,6) AS roc_auc, round(pr_auc,6) AS pr_auc FROM auc"))
def pooled_rank_metrics(spark, sf):
    return rd(M.rank_metrics(preds(spark, sf), ["model"]))


_ONE = "one AS (SELECT * FROM preds WHERE NOT (region='ASIA' AND y_true=0))"


@query(with_sql([PREDS, _ONE, auc_sql("auc", "model, seed, region", "one")], "SELECT model, seed, region, n_pos, n_neg FROM auc WHERE roc_auc IS NULL"))
def single_class_folds(spark, sf):
    p = preds(spark, sf).filter("NOT (region = 'ASIA' AND y_true = 0)")
    return M.repair_single_class(M.rank_metrics(p, K3).fillna(0.5, ["roc_auc"]), K3)[1]


@query(with_sql([PREDS, _ONE, auc_sql("auc", "model, seed, region", "one")], "SELECT model, seed, round(avg(roc_auc),6) AS value FROM auc GROUP BY 1,2"))
def repaired_region_average(spark, sf):
    p = preds(spark, sf).filter("NOT (region = 'ASIA' AND y_true = 0)")
    fixed, _ = M.repair_single_class(M.rank_metrics(p, K3).fillna(0.5, ["roc_auc", "pr_auc"]), K3)
    return rd(M.average_over(fixed.withColumn("value", F.col("roc_auc")), ["model", "seed"]))


_LONG = "ml AS (SELECT model, seed, region, 'f1' AS metric, f1 AS value FROM cm UNION ALL SELECT model, seed, region, 'roc_auc', roc_auc FROM auc)"
_MET = [PREDS, _CONF, _CM, _AUC, _LONG]


def metric_rows(spark, sf):
    return M.metric_rows(M.all_metrics(preds(spark, sf), K3), K3, ("f1", "roc_auc"))


@query(with_sql(_MET, """SELECT model, metric, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, count(v) AS n FROM (
  SELECT model, seed, metric, avg(value) AS v FROM ml GROUP BY 1,2,3) GROUP BY 1,2"""))
def region_then_seed_average(spark, sf):
    return rd(M.mean_and_std(M.average_over(metric_rows(spark, sf), ["model", "seed", "metric"]), ["model", "metric"]))


@query(with_sql([PREDS], "SELECT model, count(*) AS n, round(avg((y_prob-y_true)*(y_prob-y_true)),6) AS brier FROM preds GROUP BY model"))
def brier(spark, sf):
    return rd(M.brier(preds(spark, sf), ["model"]))


_BIN = "+".join(f"(y_prob >= {i * 0.1!r}::DOUBLE)::INT" for i in range(1, 10))


@query(with_sql([PREDS], f"SELECT model, {_BIN} AS bin, count(*) AS n, round(avg(y_prob),6) AS mean_predicted, round(avg(y_true),6) AS observed_rate FROM preds GROUP BY 1,2"))
def reliability_bins(spark, sf):
    return rd(M.reliability_bins(preds(spark, sf), ["model"]))


_PROP = "prop AS (SELECT model, seed, region, avg(y_prob) AS predicted, avg(y_true) AS actual, count(*) AS n, abs(avg(y_prob)-avg(y_true)) AS abs_error FROM preds GROUP BY 1,2,3)"


@query(with_sql([PREDS, _PROP], "SELECT model, seed, region, round(predicted,6) AS predicted, round(actual,6) AS actual, n, round(abs_error,6) AS abs_error FROM prop"))
def group_proportions(spark, sf):
    return rd(M.proportions(preds(spark, sf), K3))


@query(with_sql([PREDS, _PROP], "SELECT model, seed, round(avg(abs_error),6) AS mae, round(sqrt(avg(abs_error*abs_error)),6) AS rmse, count(abs_error) AS n_regions FROM prop GROUP BY 1,2"))
def proportion_mae_rmse(spark, sf):
    return rd(M.proportion_errors(M.proportions(preds(spark, sf), K3), ["model", "seed"]))


@query(with_sql(_MET, """SELECT metric, model AS best_model, round(value,6) AS best_value FROM (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value DESC, model) AS rn FROM (
  SELECT metric, model, avg(value) AS value FROM ml WHERE model<>'m1' GROUP BY 1,2)) WHERE rn=1"""))
def best_baseline(spark, sf):
    avg = M.average_over(metric_rows(spark, sf), ["metric", "model"])
    return rd(M.best_per_key(avg, ["metric"], "model", "value", True, ["m1"]))


@query(with_sql(_MET, """SELECT coalesce(o.model,n.model) AS model, coalesce(o.metric,n.metric) AS metric, round(o.v,6) AS old_value, round(n.v,6) AS new_value, round(n.v-o.v,6) AS delta FROM
  (SELECT model, metric, avg(value) AS v FROM ml WHERE seed IN (42,1) AND model<>'m3' GROUP BY 1,2) o FULL JOIN
  (SELECT model, metric, avg(value) AS v FROM ml WHERE seed IN (2,4,7) AND model<>'m1' GROUP BY 1,2) n ON o.model=n.model AND o.metric=n.metric"""))
def old_vs_new(spark, sf):
    m = metric_rows(spark, sf)
    old = M.average_over(m.filter("seed IN (42,1) AND model <> 'm3'"), ["model", "metric"])
    return rd(M.compare_results(old, M.average_over(m.filter("seed IN (2,4,7) AND model <> 'm1'"), ["model", "metric"]), ["model", "metric"]))


@query(with_sql(_MET, """SELECT model, metric, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std_between, min_by(region, v) AS worst, round(min(v),6) AS worst_value
  FROM (SELECT model, metric, region, avg(value) AS v FROM ml GROUP BY 1,2,3) GROUP BY 1,2"""))
def worst_region(spark, sf):
    return rd(M.worst_region(metric_rows(spark, sf), ["model", "metric"]))


@query(with_sql(_MET, """SELECT a.region, a.v AS value_m1, a.c AS n_m1, b.v AS value_m2, b.c AS n_m2, round(a.v-b.v,6) AS difference FROM
  (SELECT region, round(avg(value),9) AS v, count(*) AS c FROM ml WHERE metric='f1' AND model='m1' GROUP BY 1) a LEFT JOIN
  (SELECT region, round(avg(value),9) AS v, count(*) AS c FROM ml WHERE metric='f1' AND model='m2' GROUP BY 1) b ON a.region=b.region"""))
def paired_region_means(spark, sf):
    p = M.paired_regions(metric_rows(spark, sf).filter("metric = 'f1'"), "m1", "m2", ["region"])
    return p.select("region", F.round("value_m1", 9).alias("value_m1"), "n_m1", F.round("value_m2", 9).alias("value_m2"), "n_m2", F.round("difference", 6).alias("difference"))


# hyperparameter trials: one per (model, seed, region), settings taken from the keys
_TRIALS = "trials AS (SELECT model, seed, region, 16*ascii(right(model,1))-768 AS width, seed%3 AS rate, round(f1,3) AS val_f1 FROM cm)"


def _trials(spark, sf):
    return M.classification_metrics(preds(spark, sf), K3).select(
        *K3, (16 * F.ascii(F.right(F.col("model"), F.lit(1))) - 768).alias("width"), (F.col("seed") % 3).alias("rate"), F.round("f1", 3).alias("val_f1"))


@query(with_sql([PREDS, _CONF, _CM, _TRIALS], "SELECT model, seed, region, width, rate, val_f1 FROM trials JOIN (SELECT region, max(val_f1) AS top FROM trials GROUP BY 1) USING (region) WHERE abs(val_f1-top) <= 1e-8+1e-5*top"))
def best_trials_with_ties(spark, sf):
    return M.best_trials(_trials(spark, sf), ["region"], "val_f1")


@query(with_sql([PREDS, _CONF, _CM, _TRIALS], "SELECT width, " + ", ".join(f'max(val_f1) FILTER (rate={i}) AS "{i}"' for i in range(3)) + " FROM trials GROUP BY width"))
def trial_surface_pivot(spark, sf):
    return M.trial_surface(_trials(spark, sf), "width", "rate", "val_f1", [0, 1, 2])


@query(with_sql(_MET, """SELECT model, seed, metric, round(coalesce(CASE WHEN model='m2' THEN NULL ELSE v END, b),6) AS value FROM (SELECT model, seed, metric, avg(value) AS v FROM ml GROUP BY 1,2,3)
  LEFT JOIN (SELECT seed, metric, avg(value) AS b FROM ml GROUP BY 1,2) USING (seed, metric)"""))
def series_with_fallback(spark, sf):
    m = metric_rows(spark, sf)
    main = M.average_over(m, ["model", "seed", "metric"]).withColumn("value", F.when(F.col("model") != "m2", F.col("value")))
    return rd(M.with_fallback(main, M.average_over(m, ["seed", "metric"]), ["seed", "metric"]))


# --- resampling -------------------------------------------------------------

_POIS = "+".join(f"(u >= {c!r}::DOUBLE)::INT" for c in __import__("itertools").accumulate(
    __import__("itertools").accumulate(range(1, 12), lambda t, n: t / n, initial=0.36787944117144233)))


_ROW_DRAWS = f"""bw AS (SELECT * FROM (SELECT *, {_POIS} AS w FROM (SELECT * EXCLUDE (h, j, k), 4*k+j AS rep, ('0x'||substr(h,(1+8*j)::INT,8))::BIGINT/4294967296.0 AS u FROM
     (SELECT *, md5('boot|42|'||k||'|'||model||'|'||seed||'|'||row_id) AS h FROM preds, range(250) b(k)), range(4) s(j))) WHERE w > 0)"""


@query(with_sql([PREDS, _ROW_DRAWS, auc_sql("rep_auc", "model, rep", "bw", "w"), auc_sql("point", "model")],
  """SELECT model, round(point.roc_auc,6) AS point, round(quantile_cont(r.roc_auc, 0.025),6) AS ci_lower, round(quantile_cont(r.roc_auc, 0.975),6) AS ci_upper, count(r.roc_auc) AS n_valid
     FROM rep_auc r JOIN point USING (model) GROUP BY model, point.roc_auc"""))
def row_bootstrap_auc(spark, sf):
    return rd(I.row_bootstrap(preds(spark, sf), ["model"], "roc_auc", 1000, ["model", "seed", "row_id"]))


@query(with_sql([PREDS, _ROW_DRAWS, auc_sql("rep_auc", "model, rep", "bw", "w"), auc_sql("point", "model")],
  """SELECT model, round(point.pr_auc,6) AS point, round(quantile_cont(r.pr_auc, 0.025),6) AS ci_lower, round(quantile_cont(r.pr_auc, 0.975),6) AS ci_upper, count(r.pr_auc) AS n_valid
     FROM rep_auc r JOIN point USING (model) GROUP BY model, point.pr_auc"""))
def row_bootstrap_average_precision(spark, sf):
    return rd(I.row_bootstrap(preds(spark, sf), ["model"], "pr_auc", 1000, ["model", "seed", "row_id"]))


def _sums_sql(name, keys, source, w):
    return f"""{name} AS (SELECT {keys}, sum({w}*pow(y_prob-y_true,2))/sum({w}) AS brier,
      coalesce(2.0::DOUBLE*sum({w}*y_true*y_pred)/nullif(2*sum({w}*y_true*y_pred)+sum({w}*(y_true<>y_pred)::INT),0),0) AS f1 FROM {source} GROUP BY {keys})"""


def _interval_sql(metric):
    return f"""SELECT model, round(point.{metric},6) AS point, round(quantile_cont(r.{metric}, 0.025),6) AS ci_lower, round(quantile_cont(r.{metric}, 0.975),6) AS ci_upper,
      count(r.{metric}) AS n_valid{{more}} FROM reps r JOIN point USING (model) {{join}} GROUP BY model, point.{metric}{{more}}"""


_SIZES = "JOIN (SELECT model, count(*) AS n_pred, count(DISTINCT region) AS n_clusters FROM preds GROUP BY 1) USING (model)"


@query(with_sql([PREDS, _ROW_DRAWS, _sums_sql("reps", "model, rep", "bw", "w"), _sums_sql("point", "model", "preds", "1")], _interval_sql("brier").format(more="", join="")))
def row_bootstrap_brier(spark, sf):
    return rd(I.row_bootstrap(preds(spark, sf), ["model"], "brier", 1000, ["model", "seed", "row_id"]))


@query(with_sql([PREDS, _ROW_DRAWS, _sums_sql("reps", "model, rep", "bw", "w"), _sums_sql("point", "model", "preds", "1")], _interval_sql("f1").format(more="", join="")))
def row_bootstrap_f1(spark, sf):
    return rd(I.row_bootstrap(preds(spark, sf), ["model"], "f1", 1000, ["model", "seed", "row_id"]))


def _draws(reps):
    return [f"reg AS (SELECT region, row_number() OVER (ORDER BY region)-1 AS no FROM (SELECT DISTINCT region FROM preds))",
            f"""dr AS (SELECT rep, reg.region, count(*) AS w FROM (SELECT rep, floor({u_sql("'draw'", '42', 'rep', 'slot')}*5)::INT AS no FROM range({reps}) r(rep), range(5) s(slot)) d JOIN reg USING (no) GROUP BY 1,2)""",
            "bw AS (SELECT p.*, rep, w FROM preds p JOIN dr USING (region))", auc_sql("rep_auc", "model, rep", "bw", "w"), auc_sql("point", "model")]


def _cluster_sql(metric, reps):
    return with_sql([PREDS, *_draws(reps)], f"""SELECT model, round(point.{metric},6) AS point, round(quantile_cont(r.{metric}, 0.025),6) AS ci_lower, round(quantile_cont(r.{metric}, 0.975),6) AS ci_upper,
      count(r.{metric}) AS n_valid, n_pred, n_clusters FROM rep_auc r JOIN point USING (model) JOIN (SELECT model, count(*) AS n_pred, count(DISTINCT region) AS n_clusters FROM preds GROUP BY 1) USING (model)
      GROUP BY model, point.{metric}, n_pred, n_clusters""")


@query(_cluster_sql("roc_auc", 2000))
def cluster_bootstrap_auc(spark, sf):
    return rd(I.cluster_bootstrap(preds(spark, sf), "roc_auc", 2000))


@query(_cluster_sql("pr_auc", 2000))
def cluster_bootstrap_average_precision(spark, sf):
    return rd(I.cluster_bootstrap(preds(spark, sf), "pr_auc", 2000))


@query(with_sql([PREDS, *_draws(2000)[:3], _sums_sql("reps", "model, rep", "bw", "w"), _sums_sql("point", "model", "preds", "1")], _interval_sql("brier").format(more=", n_pred, n_clusters", join=_SIZES)))
def cluster_bootstrap_brier(spark, sf):
    return rd(I.cluster_bootstrap(preds(spark, sf), "brier", 2000))


@query(with_sql([PREDS, *_draws(2000)[:3], _sums_sql("reps", "model, rep", "bw", "w"), _sums_sql("point", "model", "preds", "1")], _interval_sql("f1").format(more=", n_pred, n_clusters", join=_SIZES)))
def cluster_bootstrap_f1(spark, sf):
    return rd(I.cluster_bootstrap(preds(spark, sf), "f1", 2000))


@query(with_sql([PREDS, *_draws(2000), "d AS (SELECT a.roc_auc-b.roc_auc AS diff FROM rep_auc a JOIN rep_auc b ON a.rep=b.rep WHERE a.model='m1' AND b.model='m2')",
   "e AS (SELECT quantile_cont(diff,0.025) AS lo, quantile_cont(diff,0.975) AS hi, count(diff) AS n FROM d)"],
  """SELECT 'm1' AS model_a, 'm2' AS model_b, round(a.roc_auc,6) AS point_a, round(b.roc_auc,6) AS point_b, round(a.roc_auc-b.roc_auc,6) AS diff, round(lo,6) AS ci_lower, round(hi,6) AS ci_upper,
     (lo>0 OR hi<0)::INT AS excludes_zero, n AS n_valid FROM e, point a, point b WHERE a.model='m1' AND b.model='m2'"""))
def paired_cluster_difference(spark, sf):
    return rd(I.paired_cluster_difference(preds(spark, sf), "m1", "m2", "roc_auc", 2000)).withColumn("excludes_zero", F.col("excludes_zero").cast("int"))


@query(with_sql(_MET, "SELECT model, string_agg(DISTINCT seed::VARCHAR, ',' ORDER BY seed::VARCHAR) AS seeds, count(DISTINCT seed) AS n_seeds FROM ml GROUP BY model"))
def seed_sets(spark, sf):
    m = metric_rows(spark, sf)
    I.require_same_seeds(m)
    return m.groupBy("model").agg(F.array_join(F.array_sort(F.collect_set(F.col("seed").cast("string"))), ",").alias("seeds"), F.count_distinct("seed").alias("n_seeds"))


_PAIRS = """pr AS (SELECT seed, region, round(a.value,6) AS a, round(b.value,6) AS b, round(a.value,6)-round(b.value,6) AS d FROM ml a JOIN ml b USING (seed, region, metric)
  WHERE metric='f1' AND a.model='m1' AND b.model='m2' AND a.value IS NOT NULL AND b.value IS NOT NULL)"""


def _pairs(spark, sf):
    m = metric_rows(spark, sf).filter("metric = 'f1'").withColumn("value", F.round("value", 6))
    return I.pair_results(m.filter("model = 'm1'"), m.filter("model = 'm2'"), ["seed", "region"])


@query(with_sql([*_MET, _PAIRS], "SELECT region, count(*) AS n_pairs, round(avg(d),6) AS mean_diff, count(*) FILTER (d>0) AS wins, round(avg(d)/(stddev_samp(d)/sqrt(count(*))),4) AS t_stat FROM pr GROUP BY region"))
def paired_t_statistic(spark, sf):
    return rd(I.paired_tests(_pairs(spark, sf), ["region"]).select("region", "n_pairs", "mean_diff", "wins", F.round("t_stat", 4).alias("t_stat")))


_WIL = """rk AS (SELECT region, d, rank() OVER (PARTITION BY region ORDER BY abs(d)) + (count(*) OVER (PARTITION BY region, abs(d)) - 1)/2.0 AS r FROM pr WHERE d<>0),
  ws AS (SELECT region, count(*) AS n, least(sum(CASE WHEN d>0 THEN r ELSE 0 END), sum(CASE WHEN d<0 THEN r ELSE 0 END)) AS w, list(r) AS rs FROM rk GROUP BY region)"""


@query(with_sql([*_MET, _PAIRS, _WIL], """SELECT region, w::DOUBLE AS w_stat, round(least(1.0, 2*sum(CASE WHEN s <= w THEN 1 ELSE 0 END)/(1<<n)::DOUBLE),6) AS w_p FROM (
  SELECT region, n, w, list_sum(list_transform(range(n), lambda i: CASE WHEN (m >> i) & 1 = 1 THEN rs[i+1] ELSE 0 END)) AS s FROM ws, range(0, 32) q(m) WHERE m < (1<<n)) GROUP BY region, w, n"""))
def wilcoxon_exact(spark, sf):
    return rd(I.paired_tests(_pairs(spark, sf), ["region"]).select("region", "w_stat", "w_p"))


@query()
def paired_test_adoption(spark, sf):
    return I.adoption(I.paired_tests(_pairs(spark, sf), []))


@query(with_sql([SITE_ATTRS], """SELECT count(*) AS n, round(corr(x,y),6) AS pearson_r, round(corr(rx,ry),6) AS spearman_r FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x)-1)/2.0 AS rx,
  rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y)-1)/2.0 AS ry FROM (SELECT n_orders AS x, balance AS y FROM site_attrs WHERE balance IS NOT NULL AND n_orders IS NOT NULL))"""))
def pearson_spearman(spark, sf):
    return rd(I.correlations(site_attrs(spark, sf), "n_orders", "balance").select("n", "pearson_r", "spearman_r"))


# --- diagnostics ------------------------------------------------------------

_F5 = ["text", "lang", "source", "quality", "toxic"]
_COMP = DOCS + ", comp AS (SELECT row_id, " + "+".join(f"({f} IS NOT NULL)::INT" for f in _F5) + " AS n_nonempty_fields, length(coalesce(text,'')) AS text_len, length(coalesce(lang,'')) AS lang_len FROM docs)"


def comp(spark, sf):
    return X.completeness(docs(spark, sf), _F5, ["text", "lang"]).select("row_id", "n_nonempty_fields", "text_len", "lang_len")


@query(with_sql([_COMP], "SELECT row_id, CASE WHEN text_len > (SELECT median(text_len) FROM comp) THEN 'well_documented' ELSE 'poorly_documented' END AS bucket FROM comp"))
def completeness_bucket(spark, sf):
    return A.median_bucket(comp(spark, sf), "text_len").select("row_id", "bucket")


_RANK = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c})-1)/2.0::DOUBLE)/count(*) OVER ()"
_QUINT = [_COMP, f"sc AS (SELECT row_id, round(({_RANK('n_nonempty_fields')}+{_RANK('text_len')}+{_RANK('lang_len')})/3, 9) AS score FROM comp)",
          "eg AS (SELECT " + ", ".join(f"quantile_cont(score, {i / 5}) AS q{i}" for i in range(1, 5)) + " FROM sc)",
          "qt AS (SELECT row_id, score, 1+(score>=q1)::INT+(score>=q2)::INT+(score>=q3)::INT+(score>=q4)::INT AS quintile FROM sc, eg)"]


def _quint(spark, sf):
    s = A.percent_rank_score(comp(spark, sf), ["n_nonempty_fields", "text_len", "lang_len"]).withColumn("score", F.round("score", 9))
    return A.quintiles(s, "score").select("row_id", "score", "quintile")


@query(with_sql(_QUINT, "SELECT row_id, round(score,6) AS score, quintile FROM qt"))
def completeness_quintile(spark, sf):
    return rd(_quint(spark, sf))


_SRC = "src AS (SELECT model AS source, row_id, y_true, y_prob FROM preds WHERE model IN ('m1','m3'))"


@query(with_sql([*_QUINT, PREDS, _SRC, "sj AS (SELECT src.*, quintile FROM src JOIN qt USING (row_id))", auc_sql("sa", "quintile, source", "sj")],
  """SELECT quintile, n_predictions, round(prevalence,6) AS prevalence, n_records, round(a.roc_auc,6) AS auc_a, round(b.roc_auc,6) AS auc_b, round(a.roc_auc-b.roc_auc,6) AS gap
     FROM sa a JOIN sa b USING (quintile) JOIN (SELECT quintile, count(*) AS n_predictions, avg(y_true) AS prevalence FROM sj WHERE source='m1' GROUP BY 1) USING (quintile)
     JOIN (SELECT quintile, count(*) AS n_records FROM qt GROUP BY 1) USING (quintile) WHERE a.source='m1' AND b.source='m3' AND a.roc_auc IS NOT NULL"""))
def stratified_auc_gap(spark, sf):
    p = preds(spark, sf).filter("model IN ('m1','m3')").withColumnRenamed("model", "source")
    return rd(A.stratified_gap(p, _quint(spark, sf), "quintile", "m1", "m3"))


@query(with_sql([PREDS, SITE_ATTRS, knn_sql("n", 15, on="a.region = b.region"), "mk AS (SELECT src AS row_id, avg(dist_km) AS mean_km FROM n GROUP BY 1)",
  "bk AS (SELECT row_id, n_orders > (SELECT median(n_orders) FROM site_attrs) AS well, is_f1, is_f2 FROM site_attrs)"],
  """SELECT seed, region, count(*) AS n_test, count(*) FILTER (y_true=1 AND y_pred=1) AS tp, count(*) FILTER (y_true=0 AND y_pred=0) AS tn, count(*) FILTER (y_true=0 AND y_pred=1) AS fp,
     count(*) FILTER (y_true=1 AND y_pred=0) AS fn, count(*) FILTER (y_true<>y_pred) AS n_wrong, count(*) FILTER (y_true<>y_pred AND is_f1=1) AS wrong_is_f1, count(*) FILTER (y_true<>y_pred AND is_f2=1) AS wrong_is_f2,
     count(*) FILTER (y_true<>y_pred AND well) AS wrong_well_documented, count(*) FILTER (y_true<>y_pred AND NOT well) AS wrong_poorly_documented,
     round(avg(mean_km) FILTER (y_true<>y_pred),6) AS mean_km_wrong, round(avg(mean_km) FILTER (y_true=y_pred),6) AS mean_km_right
     FROM preds JOIN mk USING (row_id) JOIN bk USING (row_id) WHERE model='m1' GROUP BY 1,2"""))
def error_decomposition(spark, sf):
    from occgraph.operators.knn import knn_graph_pairs, mean_knn_distance

    near = mean_knn_distance(knn_graph_pairs(sites(spark, sf), 15, by=("region",)), "src").select(F.col("src").alias("row_id"), "mean_km")
    buckets = A.median_bucket(site_attrs(spark, sf), "n_orders").select("row_id", "bucket", "is_f1", "is_f2")
    rows = preds(spark, sf).filter("model = 'm1'").join(near, "row_id").join(buckets, "row_id")
    return rd(A.error_decomposition(rows, ["seed", "region"], ["is_f1", "is_f2"], "bucket"))


@query(with_sql([PREDS], "SELECT row_id, count(*) AS n_runs, round(avg((y_pred<>y_true)::INT),6) AS error_rate FROM preds WHERE model='m2' GROUP BY row_id"))
def record_error_rate(spark, sf):
    return rd(A.record_error_rate(preds(spark, sf).filter("model = 'm2'"), sites(spark, sf)))


_FL = SITES + ", " + SITE_ATTRS + ", fl AS (SELECT region, a.* FROM site_attrs a JOIN sites USING (row_id))"


def _flagged(spark, sf):
    return site_attrs(spark, sf).join(sites(spark, sf).select("row_id", "region"), "row_id")


@query(with_sql([_FL, "c AS (" + " UNION ALL ".join(f"SELECT region, sum({f})::DOUBLE AS c FROM fl GROUP BY region" for f in FLAGS) +
  " UNION ALL SELECT region, count(*) FILTER (" + "+".join(FLAGS) + "=0)::DOUBLE FROM fl GROUP BY region)"],
  """SELECT region, n, round(sum(CASE WHEN c>0 THEN -(c/t)*log2(c/t) ELSE 0 END),6) AS entropy FROM (SELECT *, sum(c) OVER (PARTITION BY region) AS t FROM c)
     JOIN (SELECT region, count(*) AS n FROM fl GROUP BY 1) USING (region) GROUP BY region, n"""))
def entropy_by_region(spark, sf):
    return rd(A.flag_entropy(_flagged(spark, sf), ["region"], FLAGS))


@query(with_sql([_FL], " UNION ALL ".join(f"SELECT region, '{f}' AS flag, sum({f})::BIGINT AS n FROM fl GROUP BY region" for f in FLAGS)))
def contingency_cells(spark, sf):
    return A.contingency(_flagged(spark, sf), "region", FLAGS)


_CELLS = " UNION ALL ".join(f"SELECT region, '{f}' AS flag, sum({f}) AS n FROM fl GROUP BY region" for f in FLAGS)


@query(with_sql([_FL], f"""SELECT n_cells, n_cells_below_110, n_cells_below_90, n_multi_label, n_unflagged FROM (SELECT count(*) AS n_cells, count(*) FILTER (n<110) AS n_cells_below_110, count(*) FILTER (n<90) AS n_cells_below_90 FROM ({_CELLS})),
  (SELECT count(*) FILTER ({'+'.join(FLAGS)} > 1) AS n_multi_label, count(*) FILTER ({'+'.join(FLAGS)} = 0) AS n_unflagged FROM fl)"""))
def contingency_small_cells(spark, sf):
    return A.contingency_summary(_flagged(spark, sf), "region", FLAGS, (110, 90))


@query(with_sql([SITE_ATTRS], " UNION ALL ".join(f"SELECT '{c}' AS field, round(avg(({c} IS NOT NULL)::INT),6) AS fill_rate FROM site_attrs" for c in ("avg_total", "balance", "sparse_value"))))
def fill_rates(spark, sf):
    return rd(A.fill_rates(site_attrs(spark, sf), ["avg_total", "balance", "sparse_value"]))


@query(with_sql([OCC], """SELECT country, region FROM (SELECT country, region, row_number() OVER (PARTITION BY country ORDER BY count(*) DESC, region) AS rn FROM occ
  WHERE region IS NOT NULL GROUP BY 1,2) WHERE rn=1"""))
def majority_vote(spark, sf):
    return A.majority_value(occ(spark, sf), "country", "region")


@query(with_sql([SITE_ATTRS], "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS flag, round(avg({f}),6) AS prevalence FROM site_attrs" for f in FLAGS if f != "is_f2") + ") ORDER BY prevalence DESC, flag LIMIT 3"))
def flag_prevalence_topk(spark, sf):
    return rd(A.flag_prevalence(site_attrs(spark, sf), FLAGS, ["is_f2"], 3))


@query(with_sql(_MET, "SELECT region, round(avg(value),6) AS value FROM ml WHERE metric='f1' AND model='m1' GROUP BY region"))
def mean_f1_by_region(spark, sf):
    return rd(M.average_over(metric_rows(spark, sf).filter("metric = 'f1' AND model = 'm1'"), ["region"]))


@query(with_sql([SITES], "SELECT region, round(median(lat),6) AS centre_lat, round(median(lon),6) AS centre_lon FROM sites GROUP BY region"))
def group_centres(spark, sf):
    return rd(A.group_centres(sites(spark, sf), ["region"]))


# --- documents, merges, guards ----------------------------------------------

def _flat(spark, sf, layout):
    p = preds(spark, sf).withColumn("shard", F.expr("row_id div 200"))
    docs_ = runs.nest_predictions(p, layout, ["shard"])
    return runs.flatten_predictions(docs_, layout).select("shard", "seed", "region", "model", "y_true", "y_prob")


_FLAT = with_sql([PREDS], "SELECT row_id//200 AS shard, seed, region, model, y_true, y_prob FROM preds")


@query(_FLAT)
def flatten_runs_per_region(spark, sf):
    return _flat(spark, sf, "per_region")


@query(_FLAT)
def flatten_runs_model_first(spark, sf):
    return _flat(spark, sf, "model_first")


@query(_FLAT)
def flatten_runs_per_model(spark, sf):
    return _flat(spark, sf, "per_model")


def _files(spark, docs_, keys):
    """Each document as a file of its own, read in splits."""
    path = f"{shared_dir(spark)}/documents/{uuid.uuid4().hex}"
    docs_.select(*keys, "doc").repartition(*keys).write.partitionBy(*keys).text(path)
    return json_leaves.json_leaves(spark, f"{path}/*")


def _large(spark, sf, layout):
    p = preds(spark, sf).withColumn("shard", F.expr("row_id div 200"))
    leaves = _files(spark, runs.nest_predictions(p, layout, ["shard"]), ["shard"])
    shard = F.regexp_extract("file", "shard=([0-9]+)", 1).cast("long").alias("shard")
    return json_leaves.predictions_of(materialize(leaves), layout).select(shard, "seed", "region", "model", "y_true", "y_prob")


@query(_FLAT)
def large_documents_per_region(spark, sf):
    """Run documents as files that are read in byte ranges, no document as one string."""
    return _large(spark, sf, "per_region")


@query(_FLAT)
def large_documents_model_first(spark, sf):
    return _large(spark, sf, "model_first")


@query(_FLAT)
def large_documents_per_model(spark, sf):
    return _large(spark, sf, "per_model")


@query(with_sql(_MET, "SELECT seed, region, model, metric, round(value,6) AS value FROM ml WHERE value IS NOT NULL"))
def flatten_metric_documents(spark, sf):
    m = metric_rows(spark, sf)
    table = m.filter("value IS NOT NULL").groupBy("seed", "region", "model").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.col("value").cast("string")))).alias("t"))
    table = table.withColumn("t", F.map_concat("t", F.create_map(F.lit("note"), F.lit("not a number"))))
    regions = table.groupBy("seed", "region").agg(F.map_from_entries(F.collect_list(F.struct("model", "t"))).alias("test_metrics"))
    documents = regions.groupBy("seed").agg(F.map_from_entries(F.collect_list(F.struct("region", F.struct("test_metrics")))).alias("per_region")).select(
        F.to_json(F.struct(F.array(F.struct("seed", "per_region")).alias("runs"))).alias("doc"))
    return rd(runs.flatten_metrics(documents).select("seed", "region", "model", "metric", "value"))


@query(with_sql(_MET, """SELECT model, seed, region, metric, round(CASE WHEN seed IN (1,2) THEN value+1 ELSE value END,6) AS value FROM ml WHERE seed<>7 OR region<>'ASIA'"""))
def upsert_by_seed(spark, sf):
    m = metric_rows(spark, sf).filter("seed <> 7 OR region <> 'ASIA'")
    new = m.filter("seed IN (1,2)").withColumn("value", F.col("value") + 1)
    return rd(io.upsert(m, new, ["seed"]))


@query(with_sql(_MET, """SELECT model, seed, region, metric, round(CASE WHEN seed=1 THEN value+1 ELSE value END,6) AS value, 'sweep' AS source FROM ml"""))
def upsert_by_cell(spark, sf):
    m = metric_rows(spark, sf)
    new = m.filter("seed = 1").withColumn("value", F.col("value") + 1)
    return rd(io.with_provenance(io.upsert_latest(m, new, ["model", "seed", "region", "metric"]), "sweep"))


def _shards(spark, sf):
    m = metric_rows(spark, sf).filter("metric = 'f1'").withColumnRenamed("model", "condition").withColumn("file", F.concat(F.lit("shard_"), F.col("region")))
    again = m.filter("region = 'ASIA' AND seed = 42").withColumn("file", F.lit("shard_again"))
    return m.filter("NOT (region = 'EUROPE' AND seed = 7 AND condition = 'm2')").unionByName(again)


@query(with_sql(_MET, """SELECT model AS condition, seed, region, 2::BIGINT AS n_sources, 'shard_ASIA, shard_again' AS sources FROM ml WHERE metric='f1' AND region='ASIA' AND seed=42"""))
def shard_duplicates(spark, sf):
    return RS.duplicate_cells(_shards(spark, sf))


@query(with_sql(_MET, """SELECT c.condition, s.seed, r.region FROM (VALUES ('m1'),('m2'),('m3'),('m9')) c(condition), (VALUES (42),(1),(2),(4),(7)) s(seed), (SELECT DISTINCT region FROM ml) r
  WHERE c.condition='m9' OR (c.condition='m2' AND s.seed=7 AND r.region='EUROPE')"""))
def shard_coverage(spark, sf):
    rows = _shards(spark, sf)
    regions = [r[0] for r in sites(spark, sf).select("region").distinct().collect()]  # one string per region
    return RS.missing_cells(rows, {"condition": ["m1", "m2", "m3", "m9"], "seed": SEEDS, "region": regions})


@query(with_sql(_MET, """SELECT model AS condition, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, count(*) AS n FROM (SELECT model, seed, avg(value) AS v FROM ml WHERE metric='f1'
  AND NOT (region='EUROPE' AND seed=7 AND model='m2') GROUP BY 1,2) GROUP BY 1"""))
def shard_merge_summary(spark, sf):
    rows = _shards(spark, sf).filter("file <> 'shard_again'")
    return rd(RS.merge_summary(RS.require_unique_cells(rows), ["condition"]))


@query(with_sql(_MET, """SELECT metric, count(*) AS n_pairs, round(avg(a-b),6) AS mean_diff, count(*) FILTER (a>b) AS wins FROM (SELECT metric, seed, avg(value) FILTER (model='m1') AS a, avg(value) FILTER (model='m3') AS b
  FROM ml GROUP BY 1,2) GROUP BY metric"""))
def condition_differences(spark, sf):
    m = metric_rows(spark, sf).withColumnRenamed("model", "condition")
    return rd(RS.condition_differences(m, "m1", "m3", ["seed"]).select("metric", "n_pairs", "mean_diff", "wins"))


@query(with_sql(_MET, """SELECT model, seed, region, CASE WHEN model='m9' THEN 'missing' ELSE 'no value' END AS reason FROM (SELECT model, seed, region FROM ml WHERE metric='f1' AND region='ASIA' AND seed=4
  UNION ALL SELECT 'm9', seed, region FROM ml WHERE metric='f1' AND model='m1')"""))
def skipped_inputs(spark, sf):
    m = metric_rows(spark, sf).filter("metric = 'f1'").withColumn("value", F.when(~((F.col("region") == "ASIA") & (F.col("seed") == 4)), F.col("value")))
    expected = m.select(*K3).unionByName(m.filter("model = 'm1'").select(F.lit("m9").alias("model"), "seed", "region"))
    return RS.with_skipped(expected, m, K3, {"no value": F.col("value").isNull()})[1]


@query(with_sql(_MET, """SELECT model AS condition, metric, round(avg(v),6) AS mean, round(stddev_pop(v),6) AS std, count(*) AS n FROM (SELECT model, metric, seed, avg(value) AS v
  FROM ml WHERE value IS NOT NULL GROUP BY 1,2,3) GROUP BY 1,2"""))
def shard_files_merge(spark, sf):
    """Shard files, one per region, read back as documents and merged."""
    m = metric_rows(spark, sf).filter("value IS NOT NULL")
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    folds = m.groupBy("region", "model", "seed").agg(entries("metric", F.col("value").cast("string")).alias("metrics"))
    cells = folds.withColumn("per_region", F.create_map("region", F.struct(F.lit(1).alias("n_test"), "metrics")))
    runs_ = cells.groupBy("region", "model").agg(entries(F.col("seed").cast("string"), F.struct("per_region")).alias("runs"))
    shards = runs_.groupBy("region").agg(entries("model", F.struct("runs")).alias("results")).select("region", F.to_json(F.struct("results")).alias("value"))
    path = f"{shared_dir(spark)}/shards/{uuid.uuid4().hex}"
    shards.write.partitionBy("region").text(path)
    rows = runs.flatten_shards(runs.read_documents(spark, path))
    return rd(RS.merge_summary(RS.require_unique_cells(rows, ["condition", "seed", "region", "metric"]), ["condition", "metric"]))
