"""Descriptive and diagnostic analytics over record and prediction tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from occgraph.operators.metrics import rank_metrics
from occgraph.operators.ranking import average_ranks, grouped_quantiles


def fields_as_rows(df: DataFrame, columns: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """One row per column of a one-row-per-key summary."""
    others = [c for c in df.columns if c not in columns]
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias(value)) for c in columns])
    return df.select(*others, F.explode(pairs).alias("pair")).select(*others, "pair.*")


def concept_rates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Positive rate inside a concept (0/1) and miss rates inside and outside it."""
    inside = F.col("concept") == 1
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("concept").alias("n_concept"),
        F.avg(F.when(inside, F.col("label"))).alias("positive_rate"),
        F.avg(F.when(inside, F.col("miss"))).alias("concept_rate"),
        F.avg(F.when(~inside, F.col("miss"))).alias("other_rate"),
        F.avg(F.when(inside & (F.col("label") == 0), F.col("miss"))).alias("concept_rate_negatives"),
        F.avg(F.when(inside & (F.col("label") == 1), F.col("miss"))).alias("concept_rate_positives"),
        F.try_divide(F.sum(F.when(inside, F.col("miss"))), F.sum("miss")).alias("share_of_misses"),
    )


def median_bucket(df: DataFrame, column: str, high: str = "well_documented", low: str = "poorly_documented", name: str = "bucket") -> DataFrame:
    """Two buckets; strictly above the median is ``high``."""
    middle = grouped_quantiles(df, [], column, {"middle": 0.5})
    return df.join(F.broadcast(middle)).withColumn(  # one row
        name, F.when(F.col(column) > F.col("middle"), high).otherwise(low)
    ).drop("middle")


def percent_rank_score(df: DataFrame, columns: list[str], id_col: str = "row_id", name: str = "score") -> DataFrame:
    """Mean over columns of the tie-averaged rank divided by the row count."""
    long = fields_as_rows(df.select(id_col, *[F.col(c).cast("double").alias(c) for c in columns]), columns)
    ranked = average_ranks(long, ["field"], "value", "place")
    score = ranked.groupBy(id_col).agg(F.avg(F.col("place") / F.col("place_n")).alias(name))
    return df.join(score, id_col)


def quintiles(df: DataFrame, column: str, name: str = "quintile") -> DataFrame:
    """1..5 by linear quantile edges, half open, the top edge included."""
    edges = grouped_quantiles(df, [], column, {f"q{i}": i / 5 for i in range(6)})
    bucket = sum(((F.col(column) >= F.col(f"q{i}")).cast("int") for i in range(1, 5)), F.lit(1))
    return df.join(F.broadcast(edges)).withColumn(name, bucket).drop(*[f"q{i}" for i in range(6)])


def stratified_gap(preds: DataFrame, strata: DataFrame, stratum: str, source_a: str, source_b: str) -> DataFrame:
    """Rank AUC of two sources per stratum; single-class strata are left out."""
    joined = preds.join(strata.select("row_id", stratum), "row_id")
    auc = rank_metrics(joined, [stratum, "source"]).groupBy(stratum).agg(
        F.max(F.when(F.col("source") == source_a, F.col("roc_auc"))).alias("auc_a"),
        F.max(F.when(F.col("source") == source_b, F.col("roc_auc"))).alias("auc_b"),
    )
    counts = joined.filter(F.col("source") == source_a).groupBy(stratum).agg(
        F.count("*").alias("n_predictions"), F.avg(F.col("y_true").cast("double")).alias("prevalence")
    )
    records = strata.groupBy(stratum).agg(F.count("*").alias("n_records"))
    return counts.join(records, stratum).join(auc, stratum).filter(F.col("auc_a").isNotNull()).withColumn(
        "gap", F.col("auc_a") - F.col("auc_b")
    )


def error_decomposition(rows: DataFrame, keys: list[str], flags: list[str], bucket: str, distance: str = "mean_km") -> DataFrame:
    """Confusion counts, errors by flag and bucket, and neighbour distance of
    wrong and right rows. ``rows`` has one row per prediction, joined by row_id."""
    wrong = F.col("y_true") != F.col("y_pred")
    both = lambda a, b: F.count_if((F.col("y_true") == a) & (F.col("y_pred") == b))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_test"), both(1, 1).alias("tp"), both(0, 0).alias("tn"), both(0, 1).alias("fp"), both(1, 0).alias("fn"),
        F.count_if(wrong).alias("n_wrong"),
        *[F.count_if(wrong & (F.col(f) == 1)).alias(f"wrong_{f}") for f in flags],
        F.count_if(wrong & (F.col(bucket) == "well_documented")).alias("wrong_well_documented"),
        F.count_if(wrong & (F.col(bucket) == "poorly_documented")).alias("wrong_poorly_documented"),
        F.avg(F.when(wrong, F.col(distance))).alias("mean_km_wrong"),
        F.avg(F.when(~wrong, F.col(distance))).alias("mean_km_right"),
    )


def record_error_rate(preds: DataFrame, labels: DataFrame) -> DataFrame:
    """Share of runs that misclassify a record; raises on labels that disagree."""
    joined = preds.join(labels.select("row_id", F.col("label").alias("known")), "row_id")
    if not joined.filter(~F.col("known").eqNullSafe(F.col("y_true"))).isEmpty():
        raise ValueError("stored labels differ from the derived labels")
    return joined.groupBy("row_id").agg(
        F.count("*").alias("n_runs"), F.avg((F.col("y_pred") != F.col("y_true")).cast("double")).alias("error_rate")
    )


def flag_entropy(df: DataFrame, keys: list[str], flags: list[str]) -> DataFrame:
    """Shannon entropy in bits over flag counts plus a bucket for unflagged rows."""
    none = F.count_if(reduce(lambda a, b: a + b, [F.col(f) for f in flags]) == 0)
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(f).alias(f) for f in flags], none.alias("none"))
    cells = [F.col(f).cast("double") for f in (*flags, "none")]
    total = reduce(lambda a, b: a + b, cells)
    part = lambda c: F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0)
    return counts.select(*keys, "n", F.when(total > 0, reduce(lambda a, b: a + b, [part(c) for c in cells])).otherwise(0.0).alias("entropy"))


def contingency(df: DataFrame, key: str, flags: list[str]) -> DataFrame:
    """Record count per (key, flag) cell."""
    return fields_as_rows(df.groupBy(key).agg(*[F.sum(f).alias(f) for f in flags]), flags, "flag", "n")


def contingency_summary(df: DataFrame, key: str, flags: list[str], limits: tuple[int, ...] = (30, 10)) -> DataFrame:
    """Numbers of cells, of small cells, and of multi- and unflagged records."""
    cells = contingency(df.filter(F.col(key).isNotNull()), key, flags).agg(
        F.count("*").alias("n_cells"), *[F.count_if(F.col("n") < t).alias(f"n_cells_below_{t}") for t in limits]
    )
    n = reduce(lambda a, b: a + b, [F.col(f) for f in flags])
    records = df.agg(F.count_if(n > 1).alias("n_multi_label"), F.count_if(n == 0).alias("n_unflagged"))
    return cells.join(F.broadcast(records))  # one row each


def fill_rates(df: DataFrame, fields: list[str]) -> DataFrame:
    return fields_as_rows(df.agg(*[F.avg(F.col(f).isNotNull().cast("double")).alias(f) for f in fields]), fields, "field", "fill_rate")


def majority_value(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent trimmed value per key, ties by value."""
    votes = df.select(F.trim(F.col(key)).alias(key), F.trim(F.col(value)).alias(value)).dropna().groupBy(key, value).agg(F.count("*").alias("n"))
    return votes.groupBy(key).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), F.col(value).alias("v"))).alias(value))


def flag_prevalence(df: DataFrame, flags: list[str], skip: list[str], n: int) -> DataFrame:
    """The ``n`` most frequent flags outside a skip list."""
    kept = [f for f in flags if f not in skip]
    rates = fields_as_rows(df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in kept]), kept, "flag", "prevalence")
    return rates.orderBy(F.desc("prevalence"), "flag").limit(n)


def group_centres(df: DataFrame, keys: list[str]) -> DataFrame:
    """Median latitude and longitude per group."""
    lat = grouped_quantiles(df, keys, "lat", {"centre_lat": 0.5})
    return lat.join(grouped_quantiles(df, keys, "lon", {"centre_lon": 0.5}), keys)


def sample_per_group(df: DataFrame, group: str, n: int, order: Column) -> DataFrame:
    """At most ``n`` rows per group in hash order (a sampling operator)."""
    place = W.partitionBy(group).orderBy(order, "row_id")
    return df.withColumn("nth", F.row_number().over(place)).filter(F.col("nth") <= n).drop("nth")
