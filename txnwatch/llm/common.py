"""Shared pieces: written tables, values kept in a worker, row keys, prefix sums over partitions."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnwatch.session import fresh_dir


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage and survives lost executors.

    The shuffle files of the job go when the table stands, not only when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.work_path = path
    return table


def release(*tables: DataFrame) -> None:
    """Remove tables that :func:`materialize` wrote. Only for tables that no plan still to be run reads.

    What their jobs left in the driver (plans, broadcasts) goes too, where a quarter of its memory is in use: Spark
    itself asks for that every half hour only, and the heap of a driver that runs hundreds of jobs grows meanwhile.
    """
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.work_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    runtime = context._jvm.java.lang.Runtime.getRuntime()
    if 4 * (runtime.totalMemory() - runtime.freeMemory()) > runtime.maxMemory():
        context._jvm.System.gc()


def kept_in_worker(name: str, make: Callable[[], Any]) -> Any:
    """An object that outlives the tasks of a Python process, until one of another name is asked for.

    So the memory of an operator goes when the next operator's tasks run in the process.
    """
    held = sys.__dict__.setdefault("_txnwatch_llm", {})
    if name not in held:
        held.clear()
        held[name] = make()
    return held[name]


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Identifies a row by id and content. A struct compares nulls as equal, so rows without id or text match too."""
    return F.struct(F.col(doc_id).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("content"))


def text_slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in short slices, so that the Python objects of few texts exist at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside give Python batches of so many rows: an executor and its workers hold whole ones, texts and all."""
    before = spark.conf.get(_ARROW_ROWS)
    spark.conf.set(_ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_ARROW_ROWS, before)


def partition_bases(parts: DataFrame, part: str, total: str, by: list[str] | None = None) -> DataFrame:
    """Second pass of a two-pass prefix sum: what precedes each partition, per key in ``by``.

    The result has a row per (key, partition): as many as there were input splits, whatever number of rows they hold.
    That bounds it (16 MB for the splits of 100 TB), so it may be broadcast.
    """
    order = Window.partitionBy(*[F.col(c) for c in by or []]).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*(by or []), part).agg(F.sum(total).alias("_total"))
    return sums.select(*(by or []), part, F.coalesce(F.sum("_total").over(order), F.lit(0)).alias("base"))
