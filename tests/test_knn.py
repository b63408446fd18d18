"""Neighbour joins against brute force, on points chosen to be awkward."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from occgraph.operators import knn
from occgraph.operators.knn import buffer_filter, candidate_counts, knn_graph_pairs, knn_join, neighbours_with_fallback


def awkward_points(n: int, seed: int = 0) -> pd.DataFrame:
    """A third of all rows on one spot, a dense cluster over the date line,
    poles, exact ties on a lattice, and a thin spread elsewhere."""
    rng = np.random.default_rng(seed)
    lat, lon = np.round(rng.uniform(-90, 90, n), 0), np.round(rng.uniform(-180, 180, n), 0)
    kind = rng.random(n)
    lat, lon = np.where(kind < 0.34, 10.0, lat), np.where(kind < 0.34, 20.0, lon)
    dense = (kind > 0.34) & (kind < 0.6)
    lat = np.where(dense, 45 + rng.normal(0, 0.01, n), lat)
    lon = np.where(dense, 179.995 + rng.normal(0, 0.01, n), lon)
    lat[:3], lon[:3] = [90.0, 90.0, -90.0], [0.0, 77.0, 0.0]
    lon = np.where(lon >= 180, lon - 360, lon)
    return pd.DataFrame({"row_id": np.arange(n) * 7 + 3, "lat": lat, "lon": lon, "g": rng.integers(0, 3, n)})


def brute(q: pd.DataFrame, p: pd.DataFrame, k: int, exclude: bool) -> set:
    la, lb = np.radians(q.lat.to_numpy())[:, None], np.radians(p.lat.to_numpy())[None]
    oa, ob = np.radians(q.lon.to_numpy())[:, None], np.radians(p.lon.to_numpy())[None]
    a = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((ob - oa) / 2) ** 2
    d = np.floor(2 * 6371.0 * np.arcsin(np.sqrt(np.clip(a, 0, 1))) * 1e6 + 0.5)
    ids, out = p.row_id.to_numpy(), set()
    for i, me in enumerate(q.row_id.to_numpy()):
        order = ids[np.lexsort((ids, d[i]))]
        out |= {(int(me), int(j), r + 1) for r, j in enumerate(order[order != me][:k] if exclude else order[:k])}
    return out


def rows(df) -> set:
    return {(r.src, r.dst, r.rn) for r in df.select("src", "dst", "rn").toPandas().itertuples()}


@pytest.mark.parametrize("k", [1, 15])
def test_self_join_equals_brute_force(spark, k):
    pdf = awkward_points(700)
    assert rows(knn_graph_pairs(spark.createDataFrame(pdf), k)) == brute(pdf, pdf, k, True)


def test_two_sets_equal_brute_force(spark):
    pdf = awkward_points(600, 1)
    q, p = pdf.iloc[:200], pdf.iloc[200:]
    found = knn_join(spark.createDataFrame(q), spark.createDataFrame(p), 10)
    assert rows(found) == brute(q, p, 10, False)


def test_groups_stay_apart(spark):
    pdf = awkward_points(400, 2)
    found = knn_graph_pairs(spark.createDataFrame(pdf), 4, by=("g",))
    assert rows(found) == set().union(*[brute(g, g, 4, True) for _, g in pdf.groupby("g")])


def test_pool_smaller_than_k(spark):
    pdf = awkward_points(5, 3)
    assert rows(knn_graph_pairs(spark.createDataFrame(pdf), 15)) == brute(pdf, pdf, 15, True)


def test_buffer_keeps_only_strictly_farther_rows(spark):
    pdf = awkward_points(500, 4)
    test, rest = pdf.iloc[:40], pdf.iloc[40:]
    near = {(a, b) for a, b, _ in brute(rest, test, 1, False)}
    place = pdf.set_index("row_id")[["lat", "lon"]]

    def km(a, b):
        (p1, q1), (p2, q2) = np.radians(place.loc[a]), np.radians(place.loc[b])
        x = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin((q2 - q1) / 2) ** 2
        return 2 * 6371.0 * np.arcsin(np.sqrt(x))

    inside = knn_join(spark.createDataFrame(rest), spark.createDataFrame(test), 1, within_km=300.0)
    want = {a for a, b in near if km(a, b) <= 300.0}
    assert {r.src for r in inside.toPandas().itertuples()} == want
    kept = buffer_filter(spark.createDataFrame(rest), spark.createDataFrame(test), 300.0)
    assert {r.row_id for r in kept.toPandas().itertuples()} == set(map(int, rest.row_id)) - want


def test_fallback_keeps_the_closest(spark):
    pdf = pd.DataFrame({"row_id": [1, 2, 3], "lat": [0.0, 0.0, 50.0], "lon": [0.0, 1.0, 0.0]})
    kept = neighbours_with_fallback(knn_graph_pairs(spark.createDataFrame(pdf), 2), 200.0)
    assert rows(kept) == {(1, 2, 1), (2, 1, 1), (3, 1, 1)}


def test_ranks_are_dense_and_self_is_absent(spark):
    pdf = awkward_points(300, 5)
    found = knn_graph_pairs(spark.createDataFrame(pdf), 6).toPandas()
    assert (found.src != found.dst).all()
    assert found.groupby("src").rn.apply(lambda s: sorted(s) == list(range(1, 7))).all()


def spread(kind: str, n: int) -> pd.DataFrame:
    rng = np.random.default_rng(n)
    z, lon = rng.uniform(-1, 1, n), rng.uniform(-180, 180, n)
    lat = np.degrees(np.arcsin(z))
    if kind == "cities":  # two dense spots far apart and nothing between
        lat = np.where(rng.random(n) < 0.5, 10, -40) + rng.normal(0, 0.1, n)
        lon = np.where(lat > 0, 20, 120) + rng.normal(0, 0.1, n)
    if kind == "date_line":
        lat, lon = rng.normal(45, 0.5, n), (180 + rng.normal(0, 0.5, n) + 180) % 360 - 180
    if kind == "one_spot":
        here = rng.random(n) < 1 / 3
        lat, lon = np.where(here, 5.0, lat), np.where(here, 6.0, lon)
    return pd.DataFrame({"row_id": np.arange(n), "lat": lat, "lon": lon})


@pytest.mark.parametrize("kind", ["uniform", "cities", "date_line", "one_spot"])
def test_blocks_meet_few_candidates_at_every_size(spark, kind):
    worst = []
    for n in (10_000, 40_000):
        counts = candidate_counts(*[spark.createDataFrame(spread(kind, n))] * 2, 15, exclude_self=True).toPandas()
        assert counts.places.max() <= knn.LEAF and counts.places.sum() <= n
        assert counts.candidates.max() <= 2 * knn.HEAVY
        worst.append(counts.candidates.max())
    assert worst[1] <= 2 * worst[0]


def test_cut_blocks_stay_in_their_cells():
    rng = np.random.default_rng(0)
    codes = np.sort(np.concatenate([rng.integers(0, 1 << 60, 500), rng.integers(0, 1 << 20, 500), np.full(300, 77)]))
    ends, depths = knn._cut(codes, 64, True, 0)
    assert ends[-1] == len(codes) and sorted(set(ends)) == ends
    for a, b, d in zip([0, *ends[:-1]], ends, depths):
        assert b - a <= 64 and len(set((codes[a:b] >> (3 * (knn.DEPTH - d))).tolist())) == 1


def test_blocks_of_shared_places_hold_few_ids(spark):
    """Thirty records a place: a block holds about as many ids as where each has its own, and the answer stays."""
    at = np.repeat(np.arange(60), 30)
    pdf = pd.DataFrame({"row_id": np.arange(len(at)), "lat": (at % 8) * 5.0, "lon": (at // 8) * 7.0})
    df = spark.createDataFrame(pdf)
    blocks = knn._sides(df, df, 15, "row_id", "row_id", "lat", "lon", (), True)[2]
    assert blocks.agg({"n_ids": "max"}).first()[0] <= knn.LEAF
    assert rows(knn_graph_pairs(df, 15)) == brute(pdf, pdf, 15, True)
