"""Neighbour joins, graph construction, propagation, graph diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from occgraph.functions.geo import haversine_km, unit_xyz
from occgraph.operators import graph as G
from occgraph.operators import knn as K
from verify.registry import query
from verify.views import (
    FEATS, FEATS_COLS, ROLES, SITES, feats, hav_sql, knn_sql, roles, sites, table, with_sql,
)


def _r(name, digits=6):
    return F.round(name, digits).alias(name)


# --- distances and neighbour joins ------------------------------------------

@query(with_sql([SITES], f"""SELECT a.row_id, round({hav_sql('a','b')},6) AS dist_km FROM sites a
  JOIN (SELECT 0.0::DOUBLE AS lat, 0.0::DOUBLE AS lon) b ON TRUE"""))
def haversine_to_origin(spark, sf):
    s = sites(spark, sf)
    return s.select("row_id", F.round(haversine_km(s.lat, s.lon, F.lit(0.0), F.lit(0.0)), 6).alias("dist_km"))


@query(with_sql([SITES], """SELECT row_id, round(cos(radians(lat))*cos(radians(lon)),9) AS x,
  round(cos(radians(lat))*sin(radians(lon)),9) AS y, round(sin(radians(lat)),9) AS z FROM sites"""))
def unit_sphere_coordinates(spark, sf):
    return sites(spark, sf).withColumns(unit_xyz(F.col("lat"), F.col("lon"))).select("row_id", _r("x", 9), _r("y", 9), _r("z", 9))


@query(with_sql([SITES, knn_sql("n", 5)], "SELECT src, dst, round(dist_km,5) AS dist_km, rn FROM n"))
def knn_join_k5(spark, sf):
    return K.knn_graph_pairs(sites(spark, sf), 5).withColumn("dist_km", F.round("dist_km", 5))


@query(with_sql([SITES, knn_sql("n", 15)], "SELECT src, dst, round(dist_km,5) AS dist_km, rn FROM n"))
def knn_block_join_k15(spark, sf):
    """The block join used beyond small pools."""
    return K.knn_graph_pairs(sites(spark, sf), 15).withColumn("dist_km", F.round("dist_km", 5))


@query(with_sql([ROLES, knn_sql("n", 3, "(SELECT * FROM roles WHERE role='test')", "(SELECT * FROM roles WHERE role<>'test')", False, on="a.region = b.region")],
                "SELECT src, dst, round(dist_km,5) AS dist_km, rn FROM n WHERE dist_km <= 60"))
def knn_block_join_two_sets(spark, sf):
    """Two sets, inside regions, with a radius, by the block join."""
    r = roles(spark, sf)
    pairs = K.knn_join(r.filter("role = 'test'"), r.filter("role <> 'test'"), 3, by=("region",), within_km=60.0)
    return pairs.select("src", "dst", F.round("dist_km", 5).alias("dist_km"), "rn")


def _order_places(spark, sf):
    """Every order as a record with a place of its own: ten times the sites."""
    key = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("row_id"), (F.lit(-60.0) + (key * 7919 % 12000) / 100.0).alias("lat"), (F.lit(-180.0) + (key * 104729 % 36000) / 100.0).alias("lon"))


@query()
def knn_orders_k15(spark, sf):
    """All pairs in SQL would take hours here; the join is tested against brute force on awkward points."""
    return K.knn_graph_pairs(_order_places(spark, sf), 15)


@query()
def knn_sites_to_orders(spark, sf):
    return K.knn_join(sites(spark, sf), _order_places(spark, sf), 10, within_km=500.0)


@query(with_sql([SITES, knn_sql("n", 15)], "SELECT src, dst, round(dist_km,5) AS dist_km, rn FROM n WHERE dist_km <= 200 OR rn = 1"))
def knn_max_distance_fallback(spark, sf):
    pairs = K.neighbours_with_fallback(K.knn_graph_pairs(sites(spark, sf), 15), 200.0)
    return pairs.withColumn("dist_km", F.round("dist_km", 5))


@query(with_sql([ROLES, knn_sql("n", 10, "(SELECT * FROM roles WHERE role='test')", "(SELECT * FROM roles WHERE role<>'test')", False)],
                "SELECT src, dst, round(dist_km,5) AS dist_km, rn FROM n WHERE dist_km <= 300 OR rn = 1"))
def knn_pool_join(spark, sf):
    r = roles(spark, sf)
    pairs = K.knn_join(r.filter("role = 'test'"), r.filter("role <> 'test'"), 10)
    return K.neighbours_with_fallback(pairs, 300.0).withColumn("dist_km", F.round("dist_km", 5))


@query(with_sql([SITES, knn_sql("n", 15, on="a.region = b.region", keys="a.region,").replace("PARTITION BY a.region, src", "PARTITION BY src")],
                "SELECT region, round(avg(dist_km),6) AS mean_km, count(*) AS n_pairs FROM n GROUP BY region"))
def mean_knn_distance_by_region(spark, sf):
    pairs = K.knn_graph_pairs(sites(spark, sf), 15, by=("region",))
    return K.mean_knn_distance(pairs, "region").withColumn("mean_km", F.round("mean_km", 6))


@query(with_sql([SITES, knn_sql("n", 15, on="a.region = b.region")], "SELECT src, round(avg(dist_km),6) AS mean_km, count(*) AS n_pairs FROM n GROUP BY src"))
def mean_knn_distance_per_record(spark, sf):
    pairs = K.knn_graph_pairs(sites(spark, sf), 15, by=("region",))
    return K.mean_knn_distance(pairs, "src").withColumn("mean_km", F.round("mean_km", 6))


@query(with_sql([ROLES, knn_sql("n", 1, "(SELECT * FROM roles WHERE role='test')", "(SELECT * FROM roles WHERE role='train')", False)],
                """SELECT region, count(*) AS n_test, round(min(dist_km),6) AS min_km, round(avg(dist_km),6) AS mean_km,
                   round(median(dist_km),6) AS median_km FROM n JOIN sites ON src = row_id GROUP BY region"""))
def nearest_pool_distance(spark, sf):
    from occgraph.operators.splits import distance_summary

    r = roles(spark, sf)
    test = r.filter("role = 'test'")
    near = K.nearest_pool_distance(test, r.filter("role = 'train'"))
    rows = near.join(test.select(F.col("row_id").alias("src"), "region"), "src")
    return distance_summary(rows, ["region"]).select("region", "n_test", _r("min_km"), _r("mean_km"), _r("median_km"))


@query(with_sql([ROLES], f"""SELECT a.row_id FROM roles a WHERE a.role<>'test' AND NOT EXISTS
  (SELECT 1 FROM roles b WHERE b.role='test' AND {hav_sql('a','b')} <= 75.0)"""))
def buffer_anti_join(spark, sf):
    r = roles(spark, sf)
    return K.buffer_filter(r.filter("role <> 'test'"), r.filter("role = 'test'"), 75.0).select("row_id")


# --- graph construction -----------------------------------------------------

COS = """(CASE WHEN sqrt(a.f0*a.f0+a.f1*a.f1+a.f2*a.f2) >= 1e-8 AND sqrt(b.f0*b.f0+b.f1*b.f1+b.f2*b.f2) >= 1e-8
  THEN greatest(0.0, (a.f0*b.f0+a.f1*b.f1+a.f2*b.f2)/(sqrt(a.f0*a.f0+a.f1*a.f1+a.f2*a.f2)*sqrt(b.f0*b.f0+b.f1*b.f1+b.f2*b.f2))) END)"""


def graph_sql(strategy="mixed", alpha=0.6, k=15, max_km=200, nodes="sites", fit=None, gate=False):
    """CTEs n (neighbours), w (directed weighted edges), e (both directions)."""
    wanted = {"distance": "ws", "feature_similarity": "coalesce(wg, ws)",
              "mixed": f"coalesce({alpha}*ws + {1 - alpha}*wg, ws)"}[strategy]
    if gate:
        wanted = f"CASE WHEN both_fit THEN {wanted} ELSE ws END"
    fit_src = f"WHERE src IN (SELECT row_id FROM {fit})" if fit else ""
    both = f"(src IN (SELECT row_id FROM {fit}) AND dst IN (SELECT row_id FROM {fit}))" if fit else "TRUE"
    return [knn_sql("n", k, nodes, nodes), f"sig AS (SELECT avg(dist_km) AS sigma FROM n {fit_src})",
            f"""w AS (SELECT src, dst, dist_km, {wanted}::DOUBLE AS weight FROM (
              SELECT src, dst, dist_km, exp(-dist_km/sigma) AS ws, {COS} AS wg, {both} AS both_fit
              FROM n, sig, feats a, feats b WHERE a.row_id = src AND b.row_id = dst AND (dist_km <= {max_km} OR rn = 1)))""",
            "e AS (SELECT src, dst, dist_km, weight FROM w UNION ALL SELECT dst, src, dist_km, weight FROM w)"]


def nodes(spark, sf):
    return roles(spark, sf).join(feats(spark, sf), "row_id")


@query(with_sql([SITES, FEATS, *graph_sql("distance", k=15, max_km=2000)],
                """SELECT region, count(*) AS n_nodes, round(avg(d),6) AS mean_degree, min(d) AS min_degree, max(d) AS max_degree,
                   median(d) AS median_degree FROM (SELECT s.row_id, s.region, count(e.dst) AS d FROM sites s LEFT JOIN e ON e.dst = s.row_id
                   GROUP BY 1, 2) GROUP BY region"""))
def knn_graph_degree_by_region(spark, sf):
    s = sites(spark, sf)
    g = G.build_weighted_graph(s, 15, strategy="distance")
    return G.degree_by_region(s, g.edges).withColumn("mean_degree", F.round("mean_degree", 6))


@query(with_sql([SITES, knn_sql("n", 5)], """SELECT src, dst, count(*) AS copies FROM (SELECT src, dst FROM n UNION ALL SELECT dst, src FROM n)
  GROUP BY src, dst"""))
def unweighted_symmetric_graph(spark, sf):
    return G.unweighted_edges(K.knn_graph_pairs(sites(spark, sf), 5)).groupBy("src", "dst").agg(F.count("*").alias("copies"))


@query(with_sql([SITES, knn_sql("n", 5)], "SELECT src, dst FROM n UNION SELECT dst, src FROM n"))
def unweighted_graph_dedup(spark, sf):
    return G.unweighted_edges(K.knn_graph_pairs(sites(spark, sf), 5), dedup=True)


_W = [("distance", 0.6), ("feature_similarity", 0.6), ("mixed", 0.6)]


@query("WITH " + ", ".join([SITES, FEATS, *graph_sql("mixed", k=10)[:2]]) + ", " + ", ".join(
    graph_sql(s, k=10)[2].replace("w AS", f"w_{s} AS", 1) for s, _ in _W) + " " + " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, src, dst, round(weight,6) AS weight FROM w_{s}" for s, _ in _W))
def edge_weight_strategies(spark, sf):
    from functools import reduce

    n = nodes(spark, sf)
    pairs = G.materialize(K.knn_graph_pairs(n, 10))
    sigma = G.bandwidth(pairs)
    kept = K.neighbours_with_fallback(pairs, 200.0)
    return reduce(lambda a, b: a.unionByName(b), [
        G.weigh_edges(kept, sigma, strategy=s, alpha=a, src_geo=n.select("row_id", "geo")).select(
            F.lit(s).alias("strategy"), "src", "dst", _r("weight")) for s, a in _W])


def _three(spark, sf):
    from functools import reduce

    n = nodes(spark, sf)
    pairs = G.materialize(K.knn_graph_pairs(n, 15))
    return reduce(lambda a, b: a.unionByName(b), [
        G.build_weighted_graph(n, 15, strategy=s, alpha=a, max_km=200.0, pairs=pairs).edges.withColumn("strategy", F.lit(s))
        for s, a in _W])


_THREE = "WITH " + ", ".join([SITES, FEATS, *graph_sql("mixed")[:2]]) + ", " + ", ".join(
    graph_sql(s)[2].replace("w AS", f"w_{s} AS", 1) for s, _ in _W) + ", e AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS strategy, weight FROM w_{s} UNION ALL SELECT '{s}', weight FROM w_{s}" for s, _ in _W) + ") "


@query(_THREE + """SELECT g.strategy, g.bin, coalesce(n, 0) AS n_edges FROM (SELECT strategy, bin FROM (SELECT DISTINCT strategy FROM e), range(20) r(bin)) g
  LEFT JOIN (SELECT strategy, least(floor(weight*20),19)::INT AS bin, count(*) AS n FROM e GROUP BY 1,2) c USING (strategy, bin)""")
def edge_weight_histogram(spark, sf):
    return G.weight_histogram(_three(spark, sf), ["strategy"])


@query(_THREE + """SELECT strategy, count(*) AS n_edges, round(avg(weight),6) AS mean_weight, round(stddev_pop(weight),6) AS std_weight,
  round(min(weight),6) AS min_weight, round(max(weight),6) AS max_weight FROM e GROUP BY strategy""")
def edge_weight_summary(spark, sf):
    s = G.weight_summary(_three(spark, sf), ["strategy"])
    return s.select("strategy", "n_edges", *[_r(c) for c in s.columns[2:]])


@query(with_sql([SITES, FEATS, *graph_sql("mixed")],
                """SELECT s.row_id, count(e.dst) AS degree, round(coalesce(avg(weight),0),6) AS mean_weight,
                   round(coalesce(max(weight),0),6) AS max_weight FROM sites s LEFT JOIN e ON e.dst = s.row_id GROUP BY s.row_id"""))
def incoming_edge_stats(spark, sf):
    n = nodes(spark, sf)
    g = G.build_weighted_graph(n, 15, max_km=200.0)
    return G.edge_stats(n.select("row_id"), g.edges).select("row_id", "degree", _r("mean_weight"), _r("max_weight"))


@query(with_sql([ROLES, FEATS, *graph_sql("mixed")],
                """SELECT src, dst, round(weight,6) AS weight FROM e WHERE src IN (SELECT row_id FROM roles WHERE role<>'test')
                   AND dst IN (SELECT row_id FROM roles WHERE role<>'test')"""))
def induced_subgraph(spark, sf):
    n = nodes(spark, sf)
    g = G.build_weighted_graph(n, 15, max_km=200.0)
    return G.induced_subgraph(g.edges, n.filter("role <> 'test'")).select("src", "dst", _r("weight"))


@query(with_sql([ROLES], "SELECT row_id, role, row_number() OVER (ORDER BY (role<>'train')::INT, row_id) - 1 AS dense_id FROM roles WHERE role<>'test'"))
def subgraph_dense_ids(spark, sf):
    return G.dense_ids(roles(spark, sf).filter("role <> 'test'"))


@query(with_sql([SITES, FEATS, *graph_sql("distance", k=3, max_km=20)],
                """SELECT s.row_id, s.region, count(e.dst) AS degree, CASE WHEN count(e.dst)=0 THEN 'isolated' ELSE 'near_isolated' END AS kind
                   FROM sites s LEFT JOIN e ON e.dst = s.row_id GROUP BY 1,2 HAVING count(e.dst) <= 2"""))
def sparse_nodes(spark, sf):
    s = sites(spark, sf)
    return G.sparse_nodes(s, G.build_weighted_graph(s, 3, strategy="distance", max_km=20.0).edges, 2)


_TV = "tv AS (SELECT * FROM roles WHERE role <> 'test')"
_FIT = "fit AS (SELECT * FROM roles WHERE role = 'train')"


def _shift_sql():
    def part(rule, gate):
        ctes = graph_sql("mixed", k=15, nodes="tv", fit="fit", gate=gate)
        return ctes[2].replace("w AS", f"w_{rule} AS", 1)
    body = " UNION ALL ".join(f"""SELECT '{r}' AS edge_rule, role, count(*) AS n, round(avg(d),6) AS mean_degree, round(stddev_pop(d),6) AS std_degree,
      round(avg(mw),6) AS mean_weight, round(avg(xw),6) AS max_weight FROM (SELECT tv.row_id, role, count(weight) AS d, coalesce(avg(weight),0) AS mw,
      coalesce(max(weight),0) AS xw FROM tv LEFT JOIN (SELECT dst, weight FROM w_{r} UNION ALL SELECT src, weight FROM w_{r}) e ON e.dst = tv.row_id
      GROUP BY 1,2) GROUP BY role""" for r in ("unified", "asymmetric"))
    head = graph_sql("mixed", k=15, nodes="tv", fit="fit")[:2]
    return with_sql([ROLES, FEATS, _TV, _FIT, *head, part("unified", False), part("asymmetric", True)], body)


@query(_shift_sql())
def train_val_shift(spark, sf):
    tv = nodes(spark, sf).filter("role <> 'test'")
    pairs = G.materialize(K.knn_graph_pairs(tv, 15))
    out = None
    for rule, unify in (("unified", True), ("asymmetric", False)):
        g = G.build_weighted_graph(tv, 15, max_km=200.0, fit_role="train", unify_edge_rule=unify, pairs=pairs)
        part = G.role_shift(tv, g.edges).withColumn("edge_rule", F.lit(rule))
        out = part if out is None else out.unionByName(part)
    return out.select("edge_rule", "role", "n", *[_r(c) for c in ("mean_degree", "std_degree", "mean_weight", "max_weight")])


# --- held-out records and propagation ---------------------------------------

_ATTACH = [ROLES, FEATS, _TV, _FIT, "test AS (SELECT * FROM roles WHERE role = 'test')", *graph_sql("mixed", 0.5, 15, 200, "tv", "fit"),
           knn_sql("a0", 10, "test", "tv", False),
           f"""att AS (SELECT src, dst, dist_km, coalesce(0.5*ws+0.5*wg, ws) AS weight FROM (SELECT src, dst, dist_km, exp(-dist_km/sigma) AS ws, {COS} AS wg
             FROM a0, sig, feats a, feats b WHERE a.row_id = src AND b.row_id = dst AND (dist_km <= 200 OR rn = 1)))"""]


def _attached(spark, sf):
    n = nodes(spark, sf)
    tv, test = n.filter("role <> 'test'"), n.filter("role = 'test'")
    g = G.build_weighted_graph(tv, 15, alpha=0.5, max_km=200.0, fit_role="train")
    return tv, test, g, G.attach_held_out(test, tv, g.sigma, k=10, max_km=200.0)


@query(with_sql(_ATTACH, "SELECT src, dst, round(weight,6) AS weight FROM att"))
def attach_heldout(spark, sf):
    return _attached(spark, sf)[3].select("src", "dst", _r("weight"))


@query(with_sql(_ATTACH, """SELECT src AS row_id, count(*) AS n_neighbours, round(avg(weight),6) AS mean_weight, round(max(weight),6) AS max_weight
  FROM att GROUP BY src"""))
def attach_heldout_stats(spark, sf):
    _, test, _, at = _attached(spark, sf)
    return G.attached_stats(test.select("row_id"), at).select("row_id", "n_neighbours", _r("mean_weight"), _r("max_weight"))


@query(with_sql([*_ATTACH, "nb AS (SELECT e.dst AS id, count(*) AS c, sum(f0) AS s0, sum(f1) AS s1, sum(f2) AS s2 FROM e JOIN feats ON e.src = row_id GROUP BY 1)"],
  """SELECT att.src AS row_id, """ + ", ".join(
      f"round(avg(j.f{i}),6) AS h1_f{i}, round(avg((coalesce(s{i},0)+2*o.f{i})/(coalesce(c,0)+2)),6) AS h2_f{i}" for i in range(3)) +
  """ FROM att JOIN feats j ON att.dst = j.row_id JOIN feats o ON att.src = o.row_id LEFT JOIN nb ON nb.id = att.dst GROUP BY att.src"""))
def propagate_heldout(spark, sf):
    tv, test, g, at = _attached(spark, sf)
    out = G.propagate_held_out(test, tv, g.edges, at, FEATS_COLS)
    return out.select("row_id", *[_r(c) for c in out.columns[1:]])


def _held_out(spark, sf, mode):
    tv, test, g, at = _attached(spark, sf)
    out = G.propagate_held_out(test, tv, g.edges, at, FEATS_COLS, mode)
    return out.select("row_id", *[_r(c) for c in out.columns[1:]])


@query(with_sql([*_ATTACH, "nb AS (SELECT e.dst AS id, count(*) AS c, sum(weight*f0) AS s0, sum(weight*f1) AS s1, sum(weight*f2) AS s2 FROM e JOIN feats ON e.src = row_id GROUP BY 1)"],
  """SELECT att.src AS row_id, """ + ", ".join(
      f"round(avg(weight*j.f{i}),6) AS h1_f{i}, round(avg(weight*(coalesce(s{i},0)+2*weight*o.f{i})/(coalesce(c,0)+2)),6) AS h2_f{i}" for i in range(3)) +
  """ FROM att JOIN feats j ON att.dst = j.row_id JOIN feats o ON att.src = o.row_id LEFT JOIN nb ON nb.id = att.dst GROUP BY att.src"""))
def propagate_heldout_weighted(spark, sf):
    return _held_out(spark, sf, "weighted_mean")


def _pull(a, b):
    long = lambda x: f"sqrt({x}0*{x}0+{x}1*{x}1+{x}2*{x}2)"
    return f"exp(CASE WHEN {long(a)}*{long(b)} > 0 THEN ({a}0*{b}0+{a}1*{b}1+{a}2*{b}2)/({long(a)}*{long(b)}) ELSE 0 END)"


_3 = lambda text: ", ".join(text.replace("#", str(i)) for i in range(3))


@query(with_sql([*_ATTACH,
  f"nb AS (SELECT e.dst AS id, sum({_pull('y.f', 'x.f')}) AS c, {_3(f'sum({_pull("y.f", "x.f")}*x.f#) AS s#')} FROM e JOIN feats x ON e.src = x.row_id JOIN feats y ON e.dst = y.row_id GROUP BY 1)",
  f"nr AS (SELECT att.src AS a, {_pull('j.f', 'o.f')} AS u, coalesce(c,0) AS c, {_3('j.f# AS f#')}, {_3('o.f# AS o#')}, {_3('coalesce(s#,0) AS s#')} FROM att JOIN feats j ON att.dst = j.row_id JOIN feats o ON att.src = o.row_id LEFT JOIN nb ON nb.id = att.dst)",
  f"h1 AS (SELECT a, {_3('sum(u*f#)/sum(u) AS h#')} FROM nr GROUP BY a)",
  f"hj AS (SELECT a, {_3('(s#+2*u*o#)/(c+2*u) AS g#')} FROM nr)",
  f"h2 AS (SELECT a, {_3(f'sum({_pull("h", "g")}*g#)/sum({_pull("h", "g")}) AS hh#')} FROM hj JOIN h1 USING (a) GROUP BY a)"],
  f"SELECT a AS row_id, {_3('round(h#,6) AS h1_f#')}, {_3('round(hh#,6) AS h2_f#')} FROM h1 JOIN h2 USING (a)"))
def propagate_heldout_attention(spark, sf):
    return _held_out(spark, sf, "attention")


@query(with_sql([*_ATTACH,
  "dg AS (SELECT tv.row_id AS id, 1 + coalesce(sum(weight), 0) AS d FROM tv LEFT JOIN e ON e.dst = tv.row_id GROUP BY 1)",
  "da AS (SELECT src AS a, 1 + 2*sum(weight) AS da FROM att GROUP BY 1)",
  "lk AS (SELECT src AS a, dst AS j, weight AS w, d + 2*weight AS dj, da FROM att JOIN dg ON id = dst JOIN da ON da.a = att.src)",
  f"nb AS (SELECT e.dst AS j, {_3('sum(weight*x.f#/sqrt(d)) AS s#')} FROM e JOIN feats x ON e.src = x.row_id JOIN dg ON id = e.src GROUP BY 1)",
  f"ch AS (SELECT l.a, m.j, {_3('sum(weight*x.f#*(1/sqrt(l.dj)-1/sqrt(d))) AS m#')} FROM lk l JOIN e ON e.src = l.j JOIN lk m ON m.a = l.a AND m.j = e.dst JOIN feats x ON x.row_id = l.j JOIN dg ON id = l.j GROUP BY 1, 2)",
  f"hj AS (SELECT lk.*, {_3('y.f# AS y#')}, {_3('o.f# AS o#')}, {_3('(coalesce(s#,0)+coalesce(m#,0)+2*w*o.f#/sqrt(da)+y.f#/sqrt(dj))/sqrt(dj) AS g#')} FROM lk JOIN feats y ON y.row_id = lk.j JOIN feats o ON o.row_id = lk.a LEFT JOIN nb ON nb.j = lk.j LEFT JOIN ch ON ch.a = lk.a AND ch.j = lk.j)",
  f"h1 AS (SELECT a, max(da) AS da, {_3('(sum(2*w*y#/sqrt(dj)) + max(o#)/sqrt(max(da)))/sqrt(max(da)) AS h#')} FROM hj GROUP BY a)"],
  f"SELECT a AS row_id, {_3('round(max(h#),6) AS h1_f#')}, {_3('round((sum(2*w*g#/sqrt(dj)) + max(h#)/sqrt(max(h1.da)))/sqrt(max(h1.da)),6) AS h2_f#')} FROM hj JOIN h1 USING (a) GROUP BY a"))
def propagate_heldout_gcn(spark, sf):
    return _held_out(spark, sf, "gcn")


def _hop(spark, sf, mode):
    n = nodes(spark, sf)
    g = G.build_weighted_graph(n, 15, max_km=200.0)
    out = G.propagate(n, g.edges, FEATS_COLS, mode)
    return out.select("row_id", *[_r(c) for c in out.columns[1:]])


_GR = [SITES, FEATS, *graph_sql("mixed")]


def _hop_sql(expr):
    return with_sql(_GR, "SELECT s.row_id, " + ", ".join(
        f"round(coalesce({expr.format(f=f'f{i}')},0),6) AS h1_f{i}" for i in range(3)) +
        " FROM sites s LEFT JOIN (e JOIN feats ON e.src = feats.row_id) ON e.dst = s.row_id GROUP BY s.row_id")


@query(_hop_sql("avg({f})"))
def propagate_mean_hop1(spark, sf):
    return _hop(spark, sf, "mean")


@query(_hop_sql("avg(weight*{f})"))
def propagate_weighted_hop1(spark, sf):
    return _hop(spark, sf, "weighted_mean")


@query(with_sql([*_GR, "dg AS (SELECT s.row_id, 1+coalesce(sum(weight),0) AS deg FROM sites s LEFT JOIN e ON e.dst = s.row_id GROUP BY 1)"],
  "SELECT o.row_id, " + ", ".join(f"round((o.f{i}/sqrt(od.deg) + coalesce(sum(weight*x.f{i}/sqrt(xd.deg)),0))/sqrt(od.deg),6) AS h1_f{i}" for i in range(3)) +
  """ FROM feats o JOIN dg od ON o.row_id = od.row_id LEFT JOIN (e JOIN feats x ON e.src = x.row_id JOIN dg xd ON xd.row_id = x.row_id) ON e.dst = o.row_id
  GROUP BY o.row_id, o.f0, o.f1, o.f2, od.deg"""))
def propagate_gcn_hop1(spark, sf):
    return _hop(spark, sf, "gcn")


_ATT = "exp(CASE WHEN sqrt(a.f0*a.f0+a.f1*a.f1+a.f2*a.f2)*sqrt(x.f0*x.f0+x.f1*x.f1+x.f2*x.f2) > 0 THEN (a.f0*x.f0+a.f1*x.f1+a.f2*x.f2)/(sqrt(a.f0*a.f0+a.f1*a.f1+a.f2*a.f2)*sqrt(x.f0*x.f0+x.f1*x.f1+x.f2*x.f2)) ELSE 0 END)"


@query(with_sql(_GR, "SELECT a.row_id, " + ", ".join(f"round(coalesce(sum({_ATT}*x.f{i})/sum({_ATT}),0),6) AS h1_f{i}" for i in range(3)) +
  " FROM feats a LEFT JOIN (e JOIN feats x ON e.src = x.row_id) ON e.dst = a.row_id GROUP BY a.row_id"))
def propagate_attention_hop1(spark, sf):
    return _hop(spark, sf, "attention")


@query(with_sql([SITES, FEATS, *graph_sql("distance", k=20, max_km=200)[:1]], "SELECT k, count(*)*2 AS n_edges, round(avg(dist_km),6) AS mean_km FROM n, "
  "(VALUES (5),(10),(15),(20)) kk(k) WHERE rn <= k AND (dist_km <= 200 OR rn = 1) GROUP BY k"))
def k_sweep_topology(spark, sf):
    from occgraph.plans.sweeps import k_sweep

    return k_sweep(sites(spark, sf), [5, 10, 15, 20], max_km=200.0).withColumn("mean_km", F.round("mean_km", 6))


@query(with_sql([SITES, FEATS, *graph_sql("distance", k=15, max_km=200)[:1]], """SELECT max_km, count(*)*2 AS n_edges, round(avg(dist_km),6) AS mean_km FROM n,
  (VALUES (50),(100),(150),(200),(500),(3000)) kk(max_km) WHERE dist_km <= max_km OR rn = 1 GROUP BY max_km"""))
def max_distance_sweep_topology(spark, sf):
    from occgraph.plans.sweeps import max_distance_sweep

    return max_distance_sweep(sites(spark, sf), [50, 100, 150, 200, 500, 3000], k=15).withColumn("mean_km", F.round("mean_km", 6))
