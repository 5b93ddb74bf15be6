"""Tables that micro-batches change, readable at any time, and dated archives that replays replace.

A versioned table is cut into slots. A batch writes the slots it touches anew, merged by key with what they held, under
its own number, and then a manifest that names the version of every slot. Readers take the newest finished manifest, so
they see a batch as a whole or not at all; versions that neither of the last two manifests names are removed. A batch
that is run again starts from the manifest before it and replaces what it wrote.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.functions.columns import utc_day
from txnwatch.sources.sinks import side_by_side


def _fs(spark: SparkSession, path: str):
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()), where


def _remove(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def _numbered(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished ``batch=N`` folders below ``path``, ascending."""
    fs, where = _fs(spark, path)
    if not fs.exists(where):
        return []
    done = [s.getPath() for s in fs.listStatus(where) if s.isDirectory()]
    jvm = spark.sparkContext._jvm
    return sorted(int(p.getName().removeprefix("batch=")) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def _manifest(spark: SparkSession, path: str, batch_id: int | None) -> DataFrame:
    if batch_id is None:
        return spark.createDataFrame([], "slot string, version long")
    return spark.read.schema("slot string, version long").parquet(f"{path}/manifest/batch={batch_id}")


def _slots(spark: SparkSession, path: str, schema, manifest: DataFrame) -> DataFrame:
    """Rows of the slots and versions that a manifest names; others are not read."""
    stored = spark.read.schema(schema).parquet(f"{path}/data")
    return stored.join(F.broadcast(manifest), ["slot", "version"], "left_semi")


def merge_batch(changed: DataFrame, path: str, keys: list[str], slot: Column, batch_id: int) -> None:
    """Puts the rows of ``changed`` in the place of those with the same ``keys`` (null-safe); both lie in the same slot.

    ``slot`` must follow from the keys. A batch touches few slots, so few are written anew; the manifest has a row per slot.
    """
    spark = changed.sparkSession
    fresh = changed.withColumn("slot", slot).persist()
    try:
        # what an earlier run of this batch left; readers go back to the manifest before it meanwhile
        _remove(spark, f"{path}/manifest/batch={batch_id}")
        _remove(spark, f"{path}/data/version={batch_id}")
        before = [n for n in _numbered(spark, f"{path}/manifest") if n < batch_id]
        known = _manifest(spark, path, before[-1] if before else None)
        touched = fresh.select("slot").distinct()
        key = F.struct(*keys)
        stay = known.join(touched, "slot", "left_anti")
        merged = fresh
        if before:
            schema = spark.createDataFrame([], fresh.schema).withColumn("version", F.lit(0).cast("long")).schema
            held = _slots(spark, path, schema, known.join(touched, "slot", "left_semi"))
            gone = fresh.select(key.alias("__k"))
            merged = held.join(gone, key == F.col("__k"), "left_anti").select(*fresh.columns).unionByName(fresh)
        side_by_side(merged.withColumn("version", F.lit(batch_id).cast("long")), ["slot"]).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("version", "slot").parquet(f"{path}/data")
        named = stay.unionByName(touched.select("slot", F.lit(batch_id).cast("long").alias("version"))).coalesce(1)
        named.write.mode("overwrite").parquet(f"{path}/manifest/batch={batch_id}")
        _clean(spark, path, before, batch_id)
    finally:
        fresh.unpersist()


def _clean(spark: SparkSession, path: str, before: list[int], batch_id: int) -> None:
    """Removes manifests older than the last two, and slots of versions that these no longer name."""
    if len(before) < 2:
        return
    last, now = _manifest(spark, path, before[-1]), _manifest(spark, path, batch_id)
    old = _manifest(spark, path, before[-2])
    # bounded by the slots that two batches touched
    gone = old.join(last.union(now), ["slot", "version"], "left_anti").collect()
    for row in gone:
        _remove(spark, f"{path}/data/version={row['version']}/slot={_escaped(spark, row['slot'])}")
    for number in before[:-1]:
        _remove(spark, f"{path}/manifest/batch={number}")


def read_merged(spark: SparkSession, path: str, schema) -> DataFrame:
    """The table as of the newest finished batch; empty before the first one."""
    done = _numbered(spark, f"{path}/manifest")
    if not done:
        return spark.createDataFrame([], schema)
    whole = spark.createDataFrame([], schema).withColumns({"version": F.lit(0).cast("long"), "slot": F.lit("")}).schema
    return _slots(spark, path, whole, _manifest(spark, path, done[-1])).select(*schema.names)


def _escaped(spark: SparkSession, value: str) -> str:
    """A partition value as Spark writes it in a folder's name."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


NO_DAY, NO_TYPE = "none", "UNKNOWN"


def archive_batch(rows: DataFrame, path: str, batch_id: int, ts: str = "ts") -> None:
    """Adds a micro-batch to an archive by day, transaction type and batch.

    A note beside the data says which days and types the batch is about to write. When a batch is run again, folders
    that an earlier run wrote and this one doesn't are removed, also if it has no rows at all. Rows without a time or
    type go to ``dt=none`` and ``txn_type=UNKNOWN``. Filters on ``dt`` and ``txn_type`` prune folders.
    """
    spark = rows.sparkSession
    dated = rows.withColumns({"dt": F.coalesce(utc_day(F.col(ts)), F.lit(NO_DAY)), "txn_type": F.coalesce("txn_type", F.lit(NO_TYPE)), "batch": F.lit(batch_id)})
    notes = f"{path}/_batches/batch={batch_id}"
    fs, where = _fs(spark, notes)
    earlier = spark.read.schema("dt string, txn_type string").parquet(f"{notes}/*").distinct().collect() if fs.exists(where) else []
    attempts = [s.getPath() for s in fs.listStatus(where)] if earlier else []
    # days and types of one batch: a short list
    mine = dated.select("dt", "txn_type").distinct().coalesce(1)
    note = f"{notes}/attempt={uuid.uuid4().hex}"
    mine.write.parquet(note)
    now = {(r["dt"], r["txn_type"]) for r in spark.read.schema("dt string, txn_type string").parquet(note).collect()}
    if now:
        by = ["dt", "txn_type", "batch"]
        side_by_side(dated, by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    for row in earlier:
        if (row["dt"], row["txn_type"]) not in now:
            _remove(spark, f"{path}/dt={_escaped(spark, row['dt'])}/txn_type={_escaped(spark, row['txn_type'])}/batch={batch_id}")
    for old in attempts:
        fs.delete(old, True)
