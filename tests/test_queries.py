"""Registered queries beside their SQL twins (ORACLE=all runs every one)."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as points
from verify.check import TABLES, compare

QUICK = [
    "knn_join_k5", "knn_graph_degree_by_region", "incoming_edge_stats", "loro_splits", "greedy_block_holdout", "rule_cascade",
    "multilabel_flags", "list_scrub", "roc_auc_grouped", "average_precision_grouped", "reliability_bins", "cluster_bootstrap_auc",
    "flatten_runs_per_region", "shard_coverage", "median_impute", "variogram_fit", "entropy_by_region", "majority_vote",
    "region_logistic_fits", "boosted_stump", "wide_category_places", "row_bootstrap_brier", "large_documents_per_region", "regional_kmeans_blocks",
]
NAMES = list(points.oracle_sql()) if os.environ.get("ORACLE") == "all" else QUICK


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, con, name):
    verdict = compare(con, points.queries()[name](spark, sf), points.oracle_sql()[name])
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    df = points.entry(spark)
    assert df.count() == 5 and "mean_degree" in df.columns


def test_every_sql_belongs_to_a_query():
    assert set(points.oracle_sql()) <= set(points.queries())
