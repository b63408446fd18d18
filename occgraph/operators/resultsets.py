"""Merging and guarding result sets written by separate runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from occgraph.operators.infer import pair_results, paired_tests
from occgraph.operators.metrics import average_over, mean_and_std

CELL = ["condition", "seed", "region"]


def duplicate_cells(rows: DataFrame, keys: list[str] = CELL, source: str = "file") -> DataFrame:
    """Cells delivered by more than one source, with the sources' names."""
    cells = rows.select(*keys, source).distinct()
    return cells.groupBy(*keys).agg(F.count("*").alias("n_sources"), F.array_join(F.array_sort(F.collect_set(source)), ", ").alias("sources")).filter("n_sources > 1")


def require_unique_cells(rows: DataFrame, keys: list[str] = CELL, source: str = "file") -> DataFrame:
    bad = duplicate_cells(rows, keys, source).limit(5).collect()
    if bad:
        raise ValueError(f"cells covered twice: {[tuple(r) for r in bad]}")
    return rows


def missing_cells(rows: DataFrame, expected: dict[str, list]) -> DataFrame:
    """Cells of the full grid of ``expected`` values that ``rows`` lacks."""
    spark, keys = rows.sparkSession, list(expected)
    grid = spark.range(1).select(*[F.array(*[F.lit(v) for v in vs]).alias(k) for k, vs in expected.items()])
    for k in keys:
        grid = grid.withColumn(k, F.explode(k))
    return grid.join(rows.select(*keys).distinct(), keys, "left_anti")


def require_coverage(rows: DataFrame, expected: dict[str, list], allow_partial: bool = False) -> DataFrame:
    absent = missing_cells(rows, expected)
    if not allow_partial:
        first = absent.limit(8).collect()
        if first:
            raise ValueError(f"missing cells: {[tuple(r) for r in first]}")
    return absent


def merge_summary(rows: DataFrame, keys: list[str], seed: str = "seed") -> DataFrame:
    """Mean over regions per seed, then mean and deviation over seeds."""
    return mean_and_std(average_over(rows, [*keys, seed]).filter(F.col("value").isNotNull()), keys)


def condition_differences(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """Paired tests between two conditions per metric, paired on ``keys``."""
    side = lambda c: average_over(rows.filter(F.col("condition") == c), ["metric", *keys])
    return paired_tests(pair_results(side(a), side(b), ["metric", *keys]), ["metric"])


def file_ages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path).select(F.col("_metadata.file_modification_time").alias("written")).agg(F.max("written").alias("written"))


def require_same_age(spark: SparkSession, path: str, companion: str, max_seconds: int = 3600, fmt: str = "parquet") -> None:
    """Refuse to mix a result with one written more than an hour before it."""
    newer, older = file_ages(spark, path, fmt).first()[0], file_ages(spark, companion, fmt).first()[0]
    if newer is not None and older is not None and (newer - older).total_seconds() > max_seconds:
        raise ValueError(f"{companion} is stale: written {newer - older} before {path}")


def with_skipped(expected: DataFrame, rows: DataFrame, keys: list[str], checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Usable rows and a table ``(*keys, reason)`` of what was left out.

    A check names a condition on ``rows`` that makes a key unusable; an
    expected key without rows is reported as missing.
    """
    reason = None
    for name, test in checks.items():
        reason = F.when(test, name) if reason is None else reason.when(test, name)
    judged = rows.withColumn("reason", reason if reason is not None else F.lit(None).cast("string"))
    bad = judged.filter(F.col("reason").isNotNull()).groupBy(*keys).agg(F.min("reason").alias("reason"))
    absent = expected.select(*keys).distinct().join(rows.select(*keys).distinct(), keys, "left_anti").withColumn("reason", F.lit("missing"))
    return judged.drop("reason").join(bad.select(*keys), keys, "left_anti"), bad.unionByName(absent)
