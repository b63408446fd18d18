"""Rows that can't meet a join are known before it."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from occgraph.llm import common, suffixes


@pytest.mark.parametrize("most", [1 << 26, 1 << 15])
def test_marked_rows_are_all_wanted_ones_and_few_others(spark, monkeypatch, most):
    monkeypatch.setattr(common, "_MAP", (1 << 15, most))
    rows = spark.range(100_000).select(F.col("id").alias("a"), (-F.col("id")).alias("b"), F.lit("x").alias("text"))
    wanted = spark.range(0, 100_000, 20).select(F.col("id"), -F.col("id"))
    got = common.marked(rows, ["a", "b"], wanted.unionAll(wanted), "hit")
    assert got.columns == ["a", "b", "text", "hit"] and got.count() == 100_000
    assert got.filter("a % 20 = 0 AND NOT hit").count() == 0
    assert got.filter("a % 20 > 0 AND hit").count() < (0.07 if most > 1 << 15 else 0.2) * 100_000


def test_nothing_wanted_and_null_keys(spark):
    rows = spark.createDataFrame([(1, None), (None, "y")], "a long, text string")
    none = common.marked(rows, ["a"], rows.select("a").filter("false"), "hit")
    assert [x["hit"] for x in none.collect()] == [False, False]
    assert common.marked(rows, ["a"], rows.select("a"), "hit").filter("hit").count() == 2


def test_only_texts_with_repeats_are_joined(spark):
    """The join sees few of the texts that have no repeats; those come out unchanged."""
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(70)) + (" " + passage if i < 2 else "")) for i in range(50)], "doc_id long, text string")
    out = suffixes.words_without_repeats(docs, owner="test_common")
    assert out.count() == 50 and out.filter("repeats IS NOT NULL").count() == 2
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = suffixes.words_without_repeats(docs, owner="test_common")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("map_bits") > 0 and "Union" in plan
