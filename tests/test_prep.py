"""Wide categories and leave-out folds by cut-offs."""

from __future__ import annotations

import hashlib

from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from occgraph.operators import prep as P
from occgraph.operators import splits as S

SCHEMA = "row_id long, color string, size string, number double"


def test_sparse_vectors_hold_each_rows_places(spark):
    fit = [(1, "red", "s", 1.0), (2, "blue", None, 3.0), (3, "red", "m", None), (4, None, "s", 5.0)]
    new = [(5, "green", "m", None), (6, "Unknown", None, 2.0), (7, "blue", "xl", -1.0)]
    frame = spark.createDataFrame(fit + new, SCHEMA)
    prep = P.SparsePrep(["number"], ["color", "size"]).fit(frame.filter("row_id < 5"))
    place = {}
    for c, values in (("color", ["red", "blue", "Unknown"]), ("size", ["s", "m", "Unknown"])):
        place[c] = {v: i for i, v in enumerate(sorted(values, key=lambda v: hashlib.md5(f"{c}|{v}".encode()).hexdigest()))}
    assert prep.width == 7
    rows = prep.transform(frame, ["row_id"]).select("row_id", vector_to_array("features").alias("x")).collect()
    given = {r[0]: r for r in fit + new}
    for r in rows:
        _, color, size, number = given[r["row_id"]]
        want = [3.0 if number is None else number] + [0.0] * 6
        want[1 + place["color"].get(color, place["color"]["Unknown"])] = 1.0
        want[4 + place["size"].get(size, place["size"]["Unknown"])] = 1.0
        assert r["x"] == want
    assert len(rows) == 7


def test_thousands_of_categories_stay_sparse(spark):
    frame = spark.range(20_000).select(F.col("id").alias("row_id"), F.concat(F.lit("v"), F.col("id")).alias("color"), F.lit("s").alias("size"), F.lit(1.0).alias("number"))
    prep = P.SparsePrep(["number"], ["color"]).fit(frame)
    vectors = [r["features"] for r in prep.transform(frame, ["row_id"]).limit(50).collect()]
    assert prep.width == 20_002 and all(v.size == 20_002 and v.numNonzeros() == 2 for v in vectors)


def plain_roles(rows, folds, seeds, ratio):
    out = set()
    for seed in seeds:
        for fold in folds:
            key = lambda i: hashlib.md5(f"{seed}|{fold}|{i}".encode()).hexdigest()  # noqa: E731, B023
            pool = sorted((i for i, home in rows if home != fold), key=lambda i: (key(i), i))
            val = set(pool[: int(len(pool) * ratio)])
            out |= {(seed, fold, i, "test" if home == fold else "val" if i in val else "train") for i, home in rows}
    return out


def test_wide_vectors_are_added_up_where_they_are(spark):
    """A million places: no description of them on the driver, and the sums of places that are set."""
    frame = spark.range(40).selectExpr("id AS row_id", "cast(id AS string) AS color", "cast(id AS double) AS number")
    prep = P.SparsePrep(["number"], ["color"]).fit(frame)
    prep.width = 1_000_000
    made = prep.transform(frame, ["row_id"])
    assert not made.schema["features"].metadata
    sums = {r["place"]: r["total"] for r in P.vector_sums(made, "features").collect()}
    assert sums[0] == sum(range(40)) and sum(sums.values()) == sum(range(40)) + 40 and len(sums) == 41
    dense = spark.createDataFrame([(Vectors.dense([1.0, 0.0, 2.0]),), (Vectors.sparse(3, [1], [5.0]),)], ["v"])
    assert {r["place"]: r["total"] for r in P.vector_sums(dense, "v").collect()} == {0: 1.0, 1: 5.0, 2: 2.0}


def test_cut_offs_equal_ranking_every_fold(spark):
    rows = [(i, ["a", "b", "c", None][min(i % 7, 3)]) for i in range(300)]
    df = spark.createDataFrame(rows, "row_id long, region string")
    for ratio in (0.2, 0.0, 0.003, 1.0):
        got = {tuple(r) for r in S.leave_one_region_out(df, [42, 7], ratio).collect()}
        assert got == plain_roles(rows, "abc", [42, 7], ratio)
    assert S.leave_one_region_out(df.limit(0), [1]).count() == 0
    alone = S.leave_one_region_out(df.filter("region = 'a'"), [1])
    assert alone.filter("role <> 'test'").isEmpty() and alone.count() == df.filter("region = 'a'").count()


def test_rows_without_a_flag_take_no_part(spark):
    df = spark.createDataFrame([(1, 1, 0), (2, 0, None), (3, 0, 1), (4, None, 1)], "row_id long, f int, g int")
    got = {(r["fold"], r["row_id"]): r["role"] for r in S.leave_one_group_out(df, ["f", "g"], [1], 0.5).collect()}
    assert {k for k, v in got.items() if v == "test"} == {("f", 1), ("g", 3), ("g", 4)}
    assert ("f", 4) not in got and ("g", 2) not in got and got["g", 1] == "train" and sorted(got[k] for k in (("f", 2), ("f", 3))) == ["train", "val"]
