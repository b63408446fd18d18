"""Row and column operators on record tables."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from occgraph.functions import rules as R
from occgraph.functions import text as X
from occgraph.operators.ranking import join_on_keys


def exclude_value(df: DataFrame, column: str, value: str) -> DataFrame:
    """Drop rows equal to ``value``; nulls stay."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(value)))


def exclude_value_and_null(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & (F.col(column) != value))


def drop_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns, ignoring those that are absent."""
    return df.drop(*names)


def label_not_null(column: str, name: str = "label") -> Column:
    return F.col(column).isNotNull().cast("int").alias(name)


def hierarchy_features(df: DataFrame) -> DataFrame:
    """Features read from columns that are dropped later, keyed by ``row_id``."""
    return df.select(
        "row_id", F.col("components").isNotNull().cast("int").alias("is_composite_system"),
        F.col("part_of").isNotNull().cast("int").alias("is_part_of_complex"),
        X.system_class(F.col("dep_type"), F.col("dep_note"), F.col("rec_note")).alias("system_class"),
        F.col("rec_type").alias("rec_type_raw"),
    )


def attach_by_row(df: DataFrame, features: DataFrame) -> DataFrame:
    """One-to-one attachment on ``row_id``; raises when a row has no or two partners."""
    counted = features.groupBy("row_id").agg(F.count("*").alias("copies"))
    problems = df.select("row_id").join(counted, "row_id", "left").filter(F.coalesce("copies", F.lit(0)) != 1)
    if not problems.isEmpty():
        raise ValueError("features do not match the records one to one on row_id")
    return df.join(features, "row_id")


def keep_first(df: DataFrame, key: str, order_by: str = "row_id") -> DataFrame:
    """The first row of every key."""
    first = W.partitionBy(key).orderBy(order_by)
    return df.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")


def missing_ratios(df: DataFrame) -> DataFrame:
    """``(field, missing_ratio)`` per column, in one pass."""
    ratios = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns])
    return ratios.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).alias("missing_ratio")) for c in df.columns
    ])).alias("s")).select("s.*")


def columns_with_prefix(df: DataFrame, prefix: str, but: tuple[str, ...] = ()) -> list[str]:
    return sorted(c for c in df.columns if c.startswith(prefix) and c not in but)


def require_coordinates(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Raise when a coordinate is null or not a number."""
    bad = df.filter(F.col(lat).isNull() | F.col(lon).isNull() | F.isnan(lat) | F.isnan(lon))
    if not bad.isEmpty():
        raise ValueError("records without coordinates cannot be placed")
    return df


def coordinate_report(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("n_missing"))


def to_class(p: Column, threshold: float = 0.5) -> Column:
    return (p >= threshold).cast("int")


def clip01(p: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))


def confusion(y: Column, pred: Column) -> Column:
    return (
        F.when((y == 1) & (pred == 1), "TP").when((y == 0) & (pred == 0), "TN").when((y == 0) & (pred == 1), "FP").otherwise("FN")
    )


def display_names(column: Column, names: dict[str, str]) -> Column:
    """Map spellings to one display name; unknown spellings pass through."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), column), column)


def count_flags(flags: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f) for f in flags])


def groups_of_size(df: DataFrame, keys: list[str], at_least: int, count_where: Column | None = None) -> DataFrame:
    """Rows of groups with enough (matching) rows.

    Counts are aggregated first and joined back, so a huge group is never
    gathered in one window partition.
    """
    matching = F.count_if(count_where) if count_where is not None else F.count("*")
    big = df.groupBy(*keys).agg(matching.alias("group_size")).filter(F.col("group_size") >= at_least)
    return join_on_keys(df, big.drop("group_size"), keys, "left_semi")


def model_frame(df: DataFrame, token_columns: list[str], group_columns: list[str], label: str = "label") -> DataFrame:
    """All fixed-width model inputs as floats, nulls as zero.

    Raises when the label's source column is present or a column is missing.
    """
    if "ree_mins" in df.columns:
        raise ValueError("the column behind the label must be dropped first")
    wanted = (
        ["lat_z", "lon_z", "is_composite_system", "is_part_of_complex"]
        + [f"has_{e}" for e in R.COMMODITIES] + ["commodity_count"]
        + [f"region_{c}" for c in R.REGIONS] + [f"rec_type_{c}" for c in R.RECORD_TYPES]
        + [f"system_{c}" for c in R.SYSTEMS if c != "unknown"] + sorted(token_columns) + sorted(group_columns)
    )
    suspects = leakage_suspects([c for c in wanted if c in df.columns])
    if suspects:
        warnings.warn(f"these inputs may tell the label: {suspects}", stacklevel=2)
    absent = [c for c in wanted if c not in df.columns]
    if absent:
        raise KeyError(f"model inputs are missing: {absent}")
    return df.select("row_id", *[F.coalesce(F.col(f"`{c}`").cast(T.FloatType()), F.lit(0.0)).cast("float").alias(c) for c in wanted], F.col(label).cast("int"))


def leakage_suspects(columns: list[str], word: str = "ree") -> list[str]:
    """Feature names that hint at the label."""
    return [c for c in columns if word in c.lower()]
