"""Properties of splits, graphs, preparation, scoring, and streams."""

from __future__ import annotations

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from occgraph.operators import graph as G
from occgraph.operators import models as M
from occgraph.operators import resultsets as RS
from occgraph.operators import rewire as RW
from occgraph.operators import splits as S
from occgraph.operators.knn import knn_graph_pairs, nearest_pool_distance
from occgraph.operators.prep import FeaturePrep
from occgraph.operators.table import attach_by_row, keep_first, require_coordinates
from occgraph.session import materialize, shared_dir
from verify import q_models as Q
from verify.views import FLAGS, feats, roles, site_attrs, sites


@pytest.fixture(scope="module")
def site_rows(spark, sf):
    return materialize(sites(spark, sf))


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_roles_partition_every_fold(site_rows, spark):
    splits = S.leave_one_region_out(site_rows, [1, 2])
    S.require_disjoint(splits)
    n = site_rows.count()
    assert {r["count"] for r in splits.groupBy("seed", "fold").count().collect()} == {n}
    nulls = site_rows.withColumn("region", F.when(F.col("row_id") % 5 != 0, F.col("region")))
    tested = S.leave_one_region_out(nulls, [1]).filter("role = 'test'").join(nulls, "row_id")
    assert tested.filter("region IS NULL OR region <> fold").isEmpty()


def test_multi_label_rows_never_return(spark, sf):
    a = site_attrs(spark, sf)
    pool = S.leave_one_group_out(a, FLAGS, [42]).filter("role <> 'test'").join(a, "row_id")
    for f in FLAGS:
        assert pool.filter((F.col("fold") == f) & (F.col(f) == 1)).isEmpty()


def test_overlap_guard(spark):
    bad = spark.createDataFrame([(1, "a", 7, "train"), (1, "a", 7, "test")], "seed int, fold string, row_id bigint, role string")
    with pytest.raises(ValueError):
        S.require_disjoint(bad)


def test_buffer_holds_unless_fallback(site_rows):
    b = site_rows.select(F.lit(1).alias("seed"), "region", "row_id", F.floor(F.col("lon") / 10).cast("int").alias("block"))
    sizes = b.groupBy("seed", "region", "block").agg(F.count("*").alias("n"))
    held = b.join(S.select_blocks(sizes, ["seed", "region"], 0.15), ["seed", "region", "block"])
    for pool in ("region", "global"):
        splits, info = S.buffered_splits(site_rows, held, pool=pool, buffer_km=120.0)
        located = splits.join(site_rows.select("row_id", "lat", "lon"), "row_id")
        near = nearest_pool_distance(located.filter("role <> 'test'"), located.filter("role = 'test'"), by=("seed", "region"))
        closest = near.groupBy("seed", "region").agg(F.min("dist_km").alias("d")).join(info, ["seed", "region"])
        assert closest.filter("NOT buffer_fallback AND d <= buffer_km").isEmpty()
        assert info.filter("n_excluded_by_buffer > 0 AND buffer_fallback").isEmpty()
        assert splits.groupBy("seed", "region", "row_id").count().filter("count > 1").isEmpty()


def test_fold_capping(spark):
    rows = [(i, "few", int(i < 3)) for i in range(20)] + [(100 + i, "one", int(i < 1)) for i in range(9)]
    df = spark.createDataFrame(rows, "row_id bigint, k string, label int")
    folds = as_dict(S.stratified_folds(df, ["k"], "label", 5, 1).groupBy("k").agg(F.max("fold_no").alias("m")), "k", "m")
    assert folds == {"few": 2, "one": None}


def test_hash_rank_is_a_permutation(site_rows):
    ranks = sorted(r.place for r in S.hash_rank(site_rows, [], F.md5(F.col("row_id").cast("string"))).collect())
    assert ranks == list(range(1, len(ranks) + 1))


def test_manifest_guards(site_rows, tmp_path):
    splits = S.leave_one_region_out(site_rows, [1, 2]).withColumnRenamed("fold", "region")
    S.write_manifest(site_rows, splits, splits.limit(1), str(tmp_path), val_ratio=0.2)
    S.require_same_split(S.read_manifest(site_rows, str(tmp_path), [1, 2]), splits)
    with pytest.raises(ValueError, match="seeds"):
        S.read_manifest(site_rows, str(tmp_path), [1, 9])
    with pytest.raises(ValueError, match="other records"):
        S.read_manifest(site_rows.withColumn("lat", F.col("lat") + 1e-7), str(tmp_path), [1])
    with pytest.raises(ValueError):
        S.require_same_split(splits, splits.filter("row_id <> 3"))
    assert S.fingerprint(site_rows) == S.fingerprint(site_rows.orderBy(F.desc("row_id")))


def test_graph_weights_and_degrees(spark, sf):
    n = materialize(roles(spark, sf).join(feats(spark, sf), "row_id"))
    g = G.build_weighted_graph(n, 8)
    assert g.edges.filter("weight < 0 OR weight > 1").isEmpty()
    stats = G.edge_stats(n.select("row_id"), g.edges)
    assert stats.agg(F.sum("degree")).first()[0] == g.edges.count()
    with pytest.raises(ValueError):
        G.build_weighted_graph(n, 8, strategy="other")
    zero = as_dict(n.filter("f0 = 0 AND f1 = 0 AND f2 = 0"), "row_id", "row_id")
    alone = g.edges.filter(F.col("src").isin(list(zero)) | F.col("dst").isin(list(zero)))
    assert alone.filter(F.abs(F.col("weight") - F.exp(-F.col("dist_km") / g.sigma)) > 1e-12).isEmpty()


def test_held_out_records_are_independent(spark, sf):
    n = materialize(roles(spark, sf).join(feats(spark, sf), "row_id"))
    tv, test = n.filter("role <> 'test'"), n.filter("role = 'test'")
    g = G.build_weighted_graph(tv, 8, fit_role="train")
    some = test.filter("row_id % 2 = 0")
    cols = ["f0", "f1", "f2"]

    def result(rows):
        at = G.attach_held_out(rows, tv, g.sigma, k=5)
        return {r.row_id: tuple(round(v, 9) for v in r[1:]) for r in G.propagate_held_out(rows, tv, g.edges, at, cols).collect()}

    whole, part = result(test), result(some)
    assert part and all(whole[k] == v for k, v in part.items())


def test_rewiring_keeps_degrees_and_changes_links(site_rows):
    edges = G.both_directions(knn_graph_pairs(site_rows, 4).withColumn("weight", F.exp(-F.col("dist_km") / 100)))
    before, after = materialize(RW.undirected(edges)), materialize(RW.rewire(edges, swaps_per_edge=1))
    degree = lambda e: as_dict(RW.as_edges(e).groupBy("dst").count(), "dst", "count")
    assert degree(before) == degree(after)
    assert after.filter("a >= b").isEmpty() and after.groupBy("a", "b").count().filter("count > 1").isEmpty()
    assert after.join(before, ["a", "b"], "left_semi").count() < 0.5 * before.count()
    total = lambda e: e.agg(F.sum("weight")).first()[0]
    assert total(before) == pytest.approx(total(after))


def test_fit_sees_only_fit_rows(spark, sf):
    r = Q.records(spark, sf)
    fit = r.filter("role = 'train'")
    changed = fit.unionByName(r.filter("role <> 'train'").withColumn("balance", F.lit(1e9)).withColumn("segment", F.lit("NEW")))
    one, two = FeaturePrep().fit(fit), FeaturePrep().fit(changed.filter("role = 'train'"))
    assert one.to_json() == two.to_json()
    coded = one.encode(changed).filter(F.col("`segment_Unknown`") == 1)
    assert coded.count() == r.filter("role <> 'train'").count()
    assert FeaturePrep.from_json(one.to_json()).names() == one.names()


def test_out_of_fold_score_ignores_own_label(spark, sf):
    from pyspark.ml.classification import LogisticRegression

    _, v = Q.vectors(spark, sf)
    factory = lambda s: [LogisticRegression(labelCol="label", regParam=0.1)]
    folds = S.stratified_folds(v.filter("role = 'train'"), [], "label", 3, 42)
    target = folds.filter("fold_no = 1").orderBy("row_id").first()["row_id"]
    scores = M.leakage_free_scores(v, factory=factory, n_folds=3)[0]
    assert scores.count() == v.count() and scores.groupBy("row_id").count().filter("count > 1").isEmpty()
    mate = folds.filter("fold_no <> 1")
    model = factory(0)[0].fit(mate)
    alone = M.predict(model, folds.filter(F.col("row_id") == target).drop("fold_no")).first()["score"]
    assert scores.filter(F.col("row_id") == target).first()["score"] == pytest.approx(alone, abs=1e-9)


def test_stream_equals_batch(spark, sf):
    from occgraph.streaming.attach import scored_rows, score_stream

    n = materialize(roles(spark, sf).join(feats(spark, sf), "row_id"))
    tv, test = n.filter("role <> 'test'"), n.filter("role = 'test'").select("row_id", "lat", "lon", "geo")
    score = lambda rows: G.attach_held_out(rows, tv, 300.0, k=5)
    base = f"{shared_dir(spark)}/test/{uuid.uuid4().hex}"
    test.repartition(4).write.parquet(f"{base}/in")
    score_stream(spark, f"{base}/in", test.schema, score, f"{base}/out", f"{base}/state", max_files=1).awaitTermination()
    rows = lambda d: sorted((r.src, r.dst, round(r.weight, 9)) for r in d.select("src", "dst", "weight").collect())
    assert rows(scored_rows(spark, f"{base}/out")) == rows(score(test))


def test_replayed_batches_are_there_once(spark):
    """A batch that died while writing, one that ran again after it was whole, one that came in between."""
    from occgraph.streaming import attach

    sink = f"{shared_dir(spark)}/test/{uuid.uuid4().hex}"
    rows = spark.createDataFrame([(i, i % 3) for i in range(30)], "row_id long, part long")
    assert attach.scored_rows(spark, sink, rows.schema).count() == 0
    rows.write.parquet(f"{sink}/data/halfway")  # no entry: it belongs to no batch
    left = []

    def score(batch):
        copy = materialize(batch)
        left.append(copy.inputFiles()[0])
        return copy

    for number in (0, 1, 1, 2, 0):
        attach.write_batch(score, rows.filter(F.col("part") == number), number, sink)
    assert sorted(r["row_id"] for r in attach.scored_rows(spark, sink).collect()) == list(range(30))
    assert sorted(attach.journal(spark, sink)) == [0, 1, 2]
    folders = {f.split("/data/")[1].split("/")[0] for f in spark.read.parquet(f"{sink}/data/*").inputFiles()}
    assert len(folders - {"halfway"}) == 3
    for path in left:
        files, where = attach._files(spark, path)
        assert not files.exists(where)


def test_row_guards(spark):
    with pytest.raises(ValueError):
        require_coordinates(spark.createDataFrame([(1, None, 2.0)], "row_id bigint, lat double, lon double"))
    rows = spark.createDataFrame([(1,), (2,)], "row_id bigint")
    with pytest.raises(ValueError):
        attach_by_row(rows, spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "row_id bigint, v string"))
    dup = spark.createDataFrame([(3, 1.0), (1, 1.0), (2, None), (4, None)], "row_id bigint, id_no double")
    assert {r.row_id for r in keep_first(dup, "id_no").collect()} == {1, 2}


def test_shard_guards(spark):
    rows = spark.createDataFrame([("c", 1, "r", "f1"), ("c", 1, "r", "f2"), ("c", 2, "r", "f1")], "condition string, seed int, region string, file string")
    with pytest.raises(ValueError, match="twice"):
        RS.require_unique_cells(rows)
    with pytest.raises(ValueError, match="missing"):
        RS.require_coverage(rows, {"condition": ["c"], "seed": [1, 2, 3], "region": ["r"]})
    assert RS.require_coverage(rows, {"condition": ["c"], "seed": [1, 2], "region": ["r"]}).isEmpty()


@pytest.mark.parametrize("mode", ["mean", "weighted_mean", "gcn", "attention"])
def test_held_out_hops_equal_a_graph_with_the_one_record(spark, mode):
    """Every record propagated alone over the graph it is linked into, two edges each way per link."""
    r = np.random.default_rng(0)
    n, names = 14, ["f0", "f1"]
    stored = spark.createDataFrame([(i, float(r.normal()), float(r.normal())) for i in range(n)], "row_id long, f0 double, f1 double")
    arrivals = spark.createDataFrame([(100 + i, float(r.normal()), float(r.normal())) for i in range(3)], "row_id long, f0 double, f1 double")
    one_way = [(int(a), int(b), None, float(r.random())) for a in range(n) for b in r.choice(n, 3, replace=False) if a != b]
    edges = spark.createDataFrame(one_way + [(b, a, d, w) for a, b, d, w in one_way], "src long, dst long, dist_km double, weight double")
    attached = [(100 + i, int(j), float(r.random())) for i in range(3) for j in r.choice(n, 4, replace=False)]
    got = {x["row_id"]: x for x in G.propagate_held_out(
        arrivals, stored, edges, spark.createDataFrame(attached, "src long, dst long, weight double"), names, mode).collect()}
    for i in range(3):
        mine = [(a, j, None, w) for a, j, w in attached if a == 100 + i]
        more = spark.createDataFrame(2 * mine + 2 * [(j, a, d, w) for a, j, d, w in mine], edges.schema)
        nodes, whole = stored.unionByName(arrivals.filter(f"row_id = {100 + i}")), edges.unionByName(more)
        one = G.propagate(nodes, whole, names, mode, "h1_")
        two = G.propagate(one, whole, [f"h1_{f}" for f in names], mode, "h2_")
        w1, w2 = one.filter(f"row_id = {100 + i}").first(), two.filter(f"row_id = {100 + i}").first()
        for f in names:
            assert got[100 + i][f"h1_{f}"] == pytest.approx(w1[f"h1_{f}"]) and got[100 + i][f"h2_{f}"] == pytest.approx(w2[f"h2_h1_{f}"])


def test_too_many_swaps_raise(spark):
    """A triangle has no two links whose ends can be swapped."""
    one = [(0, 1), (1, 2), (0, 2)]
    edges = spark.createDataFrame([(a, b, None, 1.0) for a, b in one] + [(b, a, None, 1.0) for a, b in one], "src long, dst long, dist_km double, weight double")
    with pytest.raises(ValueError, match="only 0 of 6 swaps"):
        RW.rewire(edges)


def test_feature_families_leave_and_come_back():
    from occgraph.operators.prep import GROUP_FLAGS, MINERAL_FLAGS, candidate_columns

    names = ["lat", "lon", *MINERAL_FLAGS, *GROUP_FLAGS, "region_ASIA", "country_X", "has_gold", "is_part_of_complex"]
    left = lambda **k: [c for c in names if c not in candidate_columns(names, **k)]
    assert left(minerals=False) == MINERAL_FLAGS and "has_barite" in MINERAL_FLAGS and len(MINERAL_FLAGS) == 6
    assert left(lithology=False) == GROUP_FLAGS and len(GROUP_FLAGS) == 9
    assert left(places=False) == ["region_ASIA", "country_X"] and left(coordinates=False) == ["lat", "lon"]


def test_prep_without_a_family(spark, sf):
    rows = Q.records(spark, sf).withColumn("has_barite", (F.col("row_id") % 2).cast("int"))
    whole = FeaturePrep().fit(rows)
    without = FeaturePrep.from_json(FeaturePrep(without=("minerals", "places")).fit(rows).to_json())
    assert set(whole.names()) - set(without.names()) == {n for n in whole.names() if n == "has_barite" or n.startswith(("region_", "country_"))}
    assert len(without.transform(rows).first()["features"]) == len(without.names())


def test_ablations_change_one_thing_each():
    from occgraph.plans.region_sweep import SweepConfig
    from occgraph.plans.sweeps import ablations

    base = SweepConfig()
    differing = {n: [f for f in vars(base) if getattr(c, f) != getattr(base, f)] for n, c in ablations(base).items()}
    assert differing == {"all": [], "no_coordinates": ["drop_coordinates"], "no_minerals": ["without"], "no_lithology": ["without"],
                         "no_places": ["without"], "asymmetric_edges": ["unify_edge_rule"]}


def test_targets_of_the_specificity_probe(spark):
    flags = spark.createDataFrame([(i, int(i < 60), int(i < 40), int(i < 50), int(i < 10)) for i in range(100)], "row_id long, has_a int, has_zircon int, has_b int, has_c int")
    assert M.probe_targets(flags, ["has_c", "has_b", "has_zircon", "has_a"], ["has_zircon"], top=3) == ["has_a", "has_b"]


def test_text_fields_may_not_all_be_null(spark):
    from occgraph.functions.text import require_text

    df = spark.createDataFrame([(1, None, None), (2, None, "x")], "row_id long, a string, b string")
    assert require_text(df, ["a", "b"]).count() == 2
    with pytest.raises(ValueError, match="null"):
        require_text(df, ["a"])


def test_copies_of_a_fold_are_deleted(spark):
    from occgraph.session import owned_copies

    with owned_copies(spark, "fold"):
        inner = materialize(spark.range(3))
        kept = materialize(spark.range(4), "kept")
        assert inner.count() == 3
    assert kept.count() == 4
    with pytest.raises(Exception, match="(?i)not.?(exist|found)"):
        spark.read.parquet(inner.inputFiles()[0])
