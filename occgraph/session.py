"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "occgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators were planned for.

    Nothing here fixes a cluster's size: executors, memory and shuffle
    partitions come from the submit configuration unless passed in ``conf``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


LOCAL_COPIES = "/tmp/checkpoints/occgraph"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder.

    It must be named on a cluster. Only a local master, whose driver and
    executors are one process, gets a folder of this library when it is unset.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    spark.sparkContext.setCheckpointDir(LOCAL_COPIES)
    return spark.sparkContext.getCheckpointDir()


def _own_folder(spark: SparkSession, owner: str | None = None) -> str:
    folder = f"{shared_dir(spark)}/occgraph/{spark.sparkContext.applicationId}"
    return f"{folder}/{owner}" if owner else folder


def clear_materialized(spark: SparkSession, owner: str | None = None) -> None:
    """Delete this application's copies, or those of one owner, once no result built on them is needed."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_folder(spark, owner))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: The owner of copies made without one, by thread: a stream's batches have their own.
_OWNER: ContextVar[str | None] = ContextVar("owner", default=None)


@contextmanager
def owned_copies(spark: SparkSession, name: str) -> Iterator[None]:
    """Copies made inside without an owner of their own are deleted at the end."""
    owner = f"{name}-{uuid.uuid4().hex}"
    before = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(before)
        clear_materialized(spark, owner)


def materialize(df: DataFrame, owner: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a plan is read several times or a loop would grow its lineage.
    The copy outlives lost executors, keeps column pruning, and gives the
    planner real sizes, so it never has to guess whether a side is small.
    ``owner`` names the copies that ``clear_materialized`` deletes together.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark, owner or _OWNER.get())}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a side that a join may send whole through the driver to every task.
FEW_ROWS = 100_000


def row_sized(df: DataFrame) -> DataFrame:
    """``df``; if it has more than ``FEW_ROWS`` rows, one that joins deal out by key and never broadcast.

    The planner goes by the bytes of a table's files, and compressed columns are
    a small part of what the rows take on the driver. ``df`` is counted: it
    should be a copy, or cheap to read without its columns.
    """
    return df.hint("merge") if df.count() > FEW_ROWS else df


def small_values(df: DataFrame, column: str, limit: int = 1000) -> list:
    """Distinct non-null values, sorted; raises beyond ``limit``.

    For driver loops and literal lists over folds, regions or seeds.
    """
    found = [r[0] for r in df.select(column).dropna().distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} values")
    return sorted(found)
