"""Row numbers that no single task has to count.

A plain ``row_number`` sends a whole partition (or the whole table, without one) through one task.
Here the order is cut into buckets that agree with it; rows are numbered inside their bucket and the
bucket sizes, a small aggregate, supply the offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.session import cut_lineage


def scaled_row_number(df: DataFrame, partition: list[str], bucket: list[Column], order: list[Column],
                      name: str = "rank", limit: int | None = None) -> DataFrame:
    """Exact ``row_number() over (partition by … order by bucket…, order…)`` as a bigint.

    ``bucket`` must be ascending-sortable and must come first in the wanted order. With a ``limit``, buckets
    that begin past it are dropped before anything is ranked.
    """
    cuts = [f"cut{i}" for i in range(len(bucket))]
    parts = [F.col(c).alias(f"part{i}") for i, c in enumerate(partition)]
    # One struct as group key: equal nulls match, and join and window agree on the partitioning.
    keyed = df.withColumn("__g", F.struct(*parts, *[b.alias(c) for b, c in zip(bucket, cuts)]))
    before = Window.partitionBy(*[f"__o.part{i}" for i in range(len(parts))]).orderBy(*[f"__o.{c}" for c in cuts])
    offsets = keyed.groupBy(F.col("__g").alias("__o")).count().select(
        "__o", F.coalesce(F.sum("count").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    joined = keyed.join(offsets, F.col("__g") == F.col("__o"))
    if limit is not None:
        joined = joined.filter(F.col("__before") < limit)
    place = F.row_number().over(Window.partitionBy("__g").orderBy(*order)) + F.col("__before")
    ranked = joined.select(*df.columns, place.cast("bigint").alias(name))
    return ranked if limit is None else ranked.filter(F.col(name) <= limit)


def range_row_number(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Exact ``row_number() over (order by order…)`` as a bigint, whatever values repeat in the first columns.

    Rows are dealt to ranges of the whole order by sampled quantiles and written with their range, so that both
    passes see the same ranges; a range is numbered by itself, and the sizes of the ranges before it are added.
    ``order`` should end in a unique column: equal rows can't be told apart and share a range.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    before = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy(F.col("__range").alias("__of")).count()  # a row per range
    offsets = sizes.select("__of", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) + F.col("__before")
    return ranged.join(offsets, F.col("__range") == F.col("__of")).select(*df.columns, place.cast("bigint").alias(name))


def top_n(df: DataFrame, partition: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """Rows ranked at most ``n`` per group, for a modest ``n``.

    Spark keeps only ``n`` rows per group before the shuffle (WindowGroupLimit), so a hot group reaches
    its task as ``n`` rows per input split, not as all its rows.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    return ranked.filter(F.col(name) <= n).withColumn(name, F.col(name).cast("bigint"))


def newest_n(df: DataFrame, key: str, ts: str, n: int, tie: str, seconds: int = 60) -> DataFrame:
    """Newest ``n`` rows per key for a large ``n``: whole time buckets are kept or dropped by their
    counts, only the bucket in which the limit falls needs ranks."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    bucket = -F.floor(micros / F.lit(seconds * 1_000_000))
    return scaled_row_number(df, [key], [bucket], [F.col(ts).desc(), F.col(tie).desc()], "recency", n)
