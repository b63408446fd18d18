"""Arriving records scored against a stored graph by Structured Streaming.

Every micro-batch goes through the same function as a batch run, and records
never see each other, so the stream's output equals the batch output whatever
the batching. No state is kept and no watermark is needed.

A batch is in the sink exactly once. Its rows are written to a folder of their
own, and an entry of the sink's journal, put in place by one rename, says that
this folder is the batch. Readers go through the journal: a folder that was half
written when its driver was lost belongs to no batch, and a batch that runs
again replaces its entry, then deletes the folder it had.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from occgraph.session import owned_copies


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def journal(spark: SparkSession, sink: str) -> dict[int, str]:
    """The folder of each batch that is whole."""
    files, where = _files(spark, f"{sink}/journal")
    if not files.exists(where):
        return {}
    names = [s.getPath().getName() for s in files.listStatus(where)]
    entries = [n.split("=") for n in names if n.count("=") == 2 and n.startswith("batch=")]
    return {int(number.split("-")[0]): f"{sink}/data/{folder}" for _, number, folder in entries}


def commit(spark: SparkSession, sink: str, number: int, folder: str) -> None:
    """Make ``folder`` the batch; what the batch was before goes."""
    files, where = _files(spark, f"{sink}/journal")
    files.mkdirs(where)
    before = [s.getPath() for s in files.listStatus(where) if s.getPath().getName().startswith(f"batch={number}-folder=")]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    if before:  # one rename takes the entry from the old folder to the new one
        files.rename(before[0], path(where, f"batch={number}-folder={folder}"))
        for old in before:
            files.delete(path(f"{sink}/data/{old.getName().split('=')[2]}"), True)
    else:
        files.create(path(where, f"batch={number}-folder={folder}"), True).close()


def scored_rows(spark: SparkSession, sink: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of all whole batches, each once; ``schema`` is needed for a sink without any."""
    folders = journal(spark, sink)
    if not folders:
        return spark.createDataFrame([], schema)
    read = spark.read.schema(schema) if schema else spark.read
    return read.parquet(*[folders[n] for n in sorted(folders)])


def write_batch(score: Callable[[DataFrame], DataFrame], batch: DataFrame, number: int, sink: str) -> None:
    """Score one batch into the sink; copies made on the way are deleted when its rows are written."""
    spark, folder = batch.sparkSession, uuid.uuid4().hex
    with owned_copies(spark, "batch"):
        score(batch).write.parquet(f"{sink}/data/{folder}")
    commit(spark, sink, number, folder)


def score_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType | str,
    score: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    *,
    fmt: str = "parquet",
    max_files: int = 100,
) -> StreamingQuery:
    """Score files as they arrive; read the result with ``scored_rows``."""
    stream = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files).load(source)
    writer = stream.writeStream.foreachBatch(lambda batch, number: write_batch(score, batch, number, sink))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
