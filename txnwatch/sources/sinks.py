"""Writers: partitions, JDBC, and idempotent micro-batch sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import AtomicType

from txnwatch.functions.columns import utc_day
from txnwatch.operators.normalize import rejected_rows, valid_rows


def overwrite_day(df: DataFrame, path: str, day: str) -> None:
    """Replaces one day, also by nothing: a rerun without rows leaves no old rows behind."""
    df.drop("dt").write.mode("overwrite").parquet(f"{path}/dt={day}")


def side_by_side(df: DataFrame, by: list[str]) -> DataFrame:
    """Small partitions share a task, a large one is cut into many, so that a write makes few files.

    Spark rebalances by the partition columns with adaptive execution only, and ignores the hint without; stateful
    streams turn it off in their batches. There the rows are dealt by ranges, inside a partition by their hash.
    """
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        return df.hint("rebalance", *by)
    return df.repartitionByRange(*by, F.xxhash64(*[f.name for f in df.schema if isinstance(f.dataType, AtomicType)]))


def overwrite_partitions(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replaces only the partitions present in ``df``; columns are matched by name.

    A partition that has no rows any more isn't known here and stays; where a day can become empty, use
    :func:`overwrite_day`.
    """
    by = by or ["dt"]
    (side_by_side(df, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path))


def sorted_store(df: DataFrame, path: str, order: list[str], month_of: str) -> None:
    """Month partitions, sorted inside each task so that files can be skipped by their value ranges."""
    month = F.date_format(month_of, "yyyyMM")
    (df.withColumn("month", month).repartitionByRange("month", *order).sortWithinPartitions("month", *order)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path))


def expired(df: DataFrame, column: str, now, keep_days: int) -> DataFrame:
    """Rows past their retention."""
    return df.filter(F.col(column) < now - F.make_interval(days=F.lit(keep_days)))


def append_jdbc(df: DataFrame, url: str, dbtable: str, properties: dict[str, str] | None = None) -> None:
    df.write.jdbc(url, dbtable, mode="append", properties=properties or {})


def archive(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Dated copy of a table, by ``dt`` and transaction type. Micro-batches use ``versioned.archive_batch``."""
    dated = df.withColumn("dt", utc_day(F.col(ts)))
    overwrite_partitions(dated, path, ["dt", "txn_type"])


def batch_partition_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each batch owns one folder, so a repeated batch replaces itself, also by nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def valid_and_rejected_writer(valid_path: str, rejected_path: str, transform: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """One read of the batch feeds both the accepted rows and the dead letters."""
    to_valid, to_rejected = batch_partition_writer(valid_path), batch_partition_writer(rejected_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            to_valid(transform(valid_rows(kept)), batch_id)
            to_rejected(rejected_rows(kept), batch_id)
        finally:
            kept.unpersist()
    return write


def start(writer: DataStreamWriter, checkpoint: str, once: bool):
    """Starts with its own checkpoint; ``once`` drains what is there and stops."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
