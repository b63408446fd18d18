"""Nested run documents (JSON) flattened to long prediction and metric tables.

Input is a table with one document per row in a text column. Blocks that do
not have the expected shape come out as nulls and are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_PRED = "struct<y_true:array<int>,y_prob:array<double>,y_pred:array<int>>"
LAYOUTS = ("per_region", "model_first", "per_model")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole JSON files of a folder: ``(file, doc)``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc"))


def runs_of(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per run: ``(seed, run)`` from ``runs`` given as list or as map by seed."""
    others = [c for c in docs.columns if c != doc]
    parsed = docs.select(
        *others, F.from_json(F.col(doc), "runs map<string,string>").alias("m"), F.from_json(F.col(doc), "runs array<string>").alias("l"),
        F.get_json_object(doc, "$.runs").alias("raw"))
    is_list = F.ltrim("raw").startswith("[")
    by_seed = parsed.filter(~is_list).select(*others, F.explode("m.runs").alias("seed", "run"))
    listed = parsed.filter(is_list).select(*others, F.explode("l.runs").alias("run")).withColumn("seed", F.get_json_object("run", "$.seed"))
    return by_seed.unionByName(listed).withColumn("seed", F.expr("try_cast(seed AS int)"))


def _pred_rows(df: DataFrame, keys: list[str], block: Column) -> DataFrame:
    """One row per prediction; arrays of unequal length are dropped whole."""
    b = df.select(*keys, block.alias("b"))
    fits = F.col("b.y_prob").isNotNull() & (F.size("b.y_true") == F.size("b.y_prob"))
    return b.filter(fits).select(*keys, F.posexplode(F.arrays_zip("b.y_true", "b.y_prob")).alias("pos", "v")).select(
        *keys, "pos", F.col("v.y_true").alias("y_true"), F.col("v.y_prob").alias("y_prob"))


def flatten_predictions(docs: DataFrame, layout: str, doc: str = "doc") -> DataFrame:
    """``(..., seed, region, model, pos, y_true, y_prob)`` from any layout."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {LAYOUTS}, got {layout!r}")
    runs = runs_of(docs, doc)
    base = [c for c in runs.columns if c != "run"]
    keys = [*base, "region", "model"]
    if layout == "per_region":
        schema = f"per_region map<string,struct<predictions:map<string,{_PRED}>>>"
        regions = runs.select(*base, F.explode(F.from_json("run", schema)["per_region"]).alias("region", "r"))
        models = regions.select(*base, "region", F.explode("r.predictions").alias("model", "p"))
        return _pred_rows(models, keys, F.col("p"))
    if layout == "per_model":
        schema = "per_region map<string,struct<y_true:array<int>,per_model:map<string,struct<y_prob:array<double>>>>>"
        regions = runs.select(*base, F.explode(F.from_json("run", schema)["per_region"]).alias("region", "r"))
        models = regions.select(*base, "region", F.col("r.y_true").alias("y_true"), F.explode("r.per_model").alias("model", "p"))
        return _pred_rows(models, keys, F.struct(F.col("y_true"), F.col("p.y_prob").alias("y_prob")))
    blocks = runs.select(*base, F.explode(F.from_json("run", "map<string,string>")).alias("model", "block"))
    graph = blocks.filter(~F.col("model").isin("seed", "baselines")).select(
        *base, "model", F.explode(F.from_json("block", f"per_region map<string,struct<predictions:{_PRED}>>")["per_region"]).alias("region", "r"))
    schema = f"predictions_per_region map<string,map<string,{_PRED}>>"
    tables = blocks.filter(F.col("model") == "baselines").select(
        *base, F.explode(F.from_json("block", schema)["predictions_per_region"]).alias("region", "r")).select(*base, "region", F.explode("r").alias("model", "p"))
    return _pred_rows(graph, keys, F.col("r.predictions")).unionByName(_pred_rows(tables, keys, F.col("p")))


def flatten_metrics(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """``(..., seed, region, model, metric, value)`` from the four metric layouts.

    Region rows come from ``test_metrics`` or ``metrics`` blocks, run averages
    (region NULL) from ``avg_metrics`` or ``aggregated_metrics``. Values that
    are not numbers are ignored.
    """
    runs = runs_of(docs, doc)
    base = [c for c in runs.columns if c != "run"]
    table = "map<string,map<string,string>>"
    run = F.from_json("run", f"avg_metrics {table}, aggregated_metrics {table}, per_region map<string,struct<test_metrics:{table},per_model:{table}>>")
    parsed = runs.select(*base, run.alias("r"))
    whole = [
        parsed.select(*base, F.lit(None).cast("string").alias("region"), F.explode(f"r.{b}").alias("model", "m"))
        for b in ("avg_metrics", "aggregated_metrics")
    ]
    regions = parsed.select(*base, F.explode("r.per_region").alias("region", "x"))
    parts = [regions.select(*base, "region", F.explode(f"x.{b}").alias("model", "m")) for b in ("test_metrics", "per_model")]
    rows = None
    for part in whole + parts:
        one = part.select(*base, "region", "model", F.explode("m").alias("metric", "text")).withColumn("value", F.expr("try_cast(text AS double)"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.filter(F.col("value").isNotNull() & ~F.isnan("value")).drop("text")


def flatten_shards(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """``(..., condition, seed, region, n_test, metric, value)`` from shard documents."""
    fold = "struct<n_test:int,best_val_f1:double,metrics:map<string,string>,test_metrics:map<string,string>>"
    others = [c for c in docs.columns if c != doc]
    conditions = docs.select(*others, F.explode(F.from_json(doc, f"results map<string,struct<runs:map<string,struct<per_region:map<string,{fold}>>>>>")["results"]).alias("condition", "c"))
    seeds = conditions.select(*others, "condition", F.explode("c.runs").alias("seed", "s"))
    folds = seeds.select(*others, "condition", F.col("seed").cast("int").alias("seed"), F.explode("s.per_region").alias("region", "f"))
    metrics = F.coalesce("f.metrics", "f.test_metrics")
    return folds.select(*others, "condition", "seed", "region", F.col("f.n_test").alias("n_test"), F.explode(metrics).alias("metric", "text")).withColumn(
        "value", F.expr("try_cast(text AS double)")).drop("text")


def nest_predictions(preds: DataFrame, layout: str, doc_keys: list[str]) -> DataFrame:
    """Documents of one layout, one per ``doc_keys``: the inverse of the flattener."""
    pred = F.struct("y_true", "y_prob")
    arrays = preds.groupBy(*doc_keys, "seed", "region", "model").agg(F.array_sort(F.collect_list(F.struct("row_id", pred.alias("v")))).alias("l")).select(
        *doc_keys, "seed", "region", "model", F.col("l.v.y_true").alias("y_true"), F.col("l.v.y_prob").alias("y_prob"))
    to_map = lambda k, v: F.map_from_entries(F.collect_list(F.struct(F.col(k), v)))
    block = F.struct("y_true", "y_prob")
    if layout == "per_region":
        regions = arrays.groupBy(*doc_keys, "seed", "region").agg(to_map("model", block).alias("predictions"))
        runs = regions.groupBy(*doc_keys, "seed").agg(to_map("region", F.struct("predictions")).alias("per_region"))
        docs = runs.groupBy(*doc_keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("seed").cast("string"), F.struct("per_region")))).alias("runs"))
    elif layout == "per_model":
        regions = arrays.groupBy(*doc_keys, "seed", "region").agg(
            F.first("y_true").alias("y_true"), to_map("model", F.struct("y_prob")).alias("per_model"))
        runs = regions.groupBy(*doc_keys, "seed").agg(to_map("region", F.struct("y_true", "per_model")).alias("per_region"))
        docs = runs.groupBy(*doc_keys).agg(F.collect_list(F.struct("seed", "per_region")).alias("runs"))
    else:
        first = arrays.filter(F.col("model") == "m1").groupBy(*doc_keys, "seed").agg(
            to_map("region", F.struct(block.alias("predictions"))).alias("per_region")).select(*doc_keys, "seed", F.struct("per_region").alias("m1"))
        rest = arrays.filter(F.col("model") != "m1").groupBy(*doc_keys, "seed", "region").agg(to_map("model", block).alias("b")).groupBy(*doc_keys, "seed").agg(
            F.map_from_entries(F.collect_list(F.struct("region", "b"))).alias("predictions_per_region"))
        runs = first.join(rest, [*doc_keys, "seed"], "full_outer").select(*doc_keys, "seed", "m1", F.struct("predictions_per_region").alias("baselines"))
        docs = runs.groupBy(*doc_keys).agg(F.collect_list(F.struct("seed", "m1", "baselines")).alias("runs"))
    return docs.select(*doc_keys, F.to_json(F.struct("runs")).alias("doc"))
