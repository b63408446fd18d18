"""Reading and writing tables: explicit schemas, pruned scans, keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = ["Name", "Region", "Country", "State_Prov", "Status", "Dep_Type", "Host_Lith", "Sig_Mins", "REE_Mins", "Commods",
         "Components", "Part_of", "Rec_Type", "Dep_Note", "Rec_Note", "Comments", "Loc_Note", "Ref_List", "Stat_Note",
         "Expl_Note", "P_Note", "Alteration", "Assoc_Rock", "Host_Age"]
RAW_SCHEMA = T.StructType(
    [T.StructField("ID_No", T.DoubleType()), T.StructField("Latitude", T.DoubleType()), T.StructField("Longitude", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in _TEXT]
)
PREDICTION_SCHEMA = "exp string, model string, seed int, region string, row_id bigint, y_true int, y_prob double, y_pred int"
METRIC_SCHEMA = "exp string, model string, seed int, region string, metric string, value double"
FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json", ".orc": "orc"}


def scan(spark: SparkSession, path: str, *, schema: T.StructType | str | None = None, columns: list[str] | None = None, fmt: str | None = None, **options) -> DataFrame:
    """Read a file or folder by its suffix; ``columns`` prunes the scan."""
    if fmt is None:
        fmt = next((f for suffix, f in FORMATS.items() if path.rstrip("/").endswith(suffix)), "parquet")
    if fmt == "csv":
        options = {"header": "true", "escape": '"', **options}
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    return df.select(*columns) if columns else df


def with_row_id(df: DataFrame) -> DataFrame:
    """Give every record a fixed id once, at ingest; write the result before use."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def write_table(df: DataFrame, path: str, *, fmt: str = "parquet", partition_by: list[str] = (), mode: str = "overwrite") -> None:
    df.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node and edge tables of one graph, side by side."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def replace_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Overwrite only the partitions present in ``df`` (a partial re-run)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old rows with the same key; other old rows stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """As ``upsert`` for one row per key, by source rank."""
    both = old.withColumn("source", F.lit(0)).unionByName(new.withColumn("source", F.lit(1)))
    latest = W.partitionBy(*keys).orderBy(F.desc("source"))
    return both.withColumn("nth", F.row_number().over(latest)).filter("nth = 1").drop("nth", "source")


def with_provenance(df: DataFrame, source: str) -> DataFrame:
    """Name the source of each exported row."""
    return df.withColumn("source", F.lit(source))
