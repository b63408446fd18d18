"""The prefix forest against brute force."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from occgraph.llm import forest
from occgraph.llm.common import table

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, is_query, k=10):
    ok = [(i, np.array(v, dtype=np.float32).astype(np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, x in ok:
        if is_query(q):
            near = sorted({(float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q and len(y) == len(x)})
            out[q] = near[:k]
    return out


def found(df, condition=None, k=10):
    got = {}
    for r in forest.nearest_neighbours(df, F.col("vec_id") % 10 == 0 if condition is None else condition, k).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


def recall(got, want):
    return sum(len({i for _, i in got.get(q, [])} & {i for _, i in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_the_table_and_exact_scores(spark, sf):
    df = table(spark, sf, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got, want = found(df), brute(rows, lambda i: i % 10 == 0)
    assert recall(got, want) >= 0.95 and {len(v) for v in got.values()} == {10}
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for q, near in got.items():
        assert near == sorted(near) and all(s == float(np.sqrt(((vectors[i] - vectors[q]) ** 2).sum())) for s, i in near)


def test_clusters_and_copies(spark):
    """A third of all vectors equal, a third very close together."""
    r = np.random.default_rng(0)
    centre = r.normal(size=16)
    vectors = [centre if i % 3 == 0 else centre + r.normal(size=16) * 1e-3 if i % 3 == 1 else r.normal(size=16) for i in range(900)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    got, want = found(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)), brute(rows, lambda i: i % 10 == 0)
    assert recall(got, want) >= 0.95
    assert [i for _, i in got[0]] == [3 * j for j in range(1, 11)]  # equal vectors: the smallest ids


def test_many_blocks_and_query_cells(spark, monkeypatch):
    monkeypatch.setattr(forest, "LEAST_BLOCK", 100)
    monkeypatch.setattr(forest, "BLOCKS", 9)
    monkeypatch.setattr(forest, "QUERIES", 20)
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(1000)]
    assert recall(found(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)), brute(rows, lambda i: i % 10 == 0)) >= 0.95


def test_awkward_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]),
            (6, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0, 0.0, 0.0]), (8, [0.0, 1.0]), (20, [3.0, 3.0, 3.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({"h": F.lit("own"), "size": F.lit("own"), "rank": F.lit("own")})
    assert found(df) == {q: w for q, w in brute(rows, lambda i: i % 10 == 0).items() if w}
    assert forest.nearest_neighbours(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
