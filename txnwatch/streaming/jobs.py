"""The streaming layers: normalize, enrich, detect, aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.operators.dedup import dedup_tumbling
from txnwatch.operators.normalize import BYPASS, normalize
from txnwatch.operators.rolling import hourly_sketches, lookup_features, merged_windows, rolling_transactions
from txnwatch.operators.rules import all_alerts, collect_rules
from txnwatch.operators.sanctions import sanction_alerts, screen
from txnwatch.sources.lists import read_rules
from txnwatch.sources.sinks import batch_partition_writer, overwrite_partitions, start, valid_and_rejected_writer
from txnwatch.sources.versioned import archive_batch, merge_batch
from txnwatch.streaming.anchored import dedup_anchored_stream
from txnwatch.streaming.state import rolling_stream

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _archived(write, path: str, archive: str | None):
    """``write``, and where ``archive`` names one, the batch's rows in a dated archive, from the files just written."""
    if archive is None:
        return write

    def both(batch: DataFrame, batch_id: int) -> None:
        write(batch, batch_id)
        archive_batch(batch.sparkSession.read.parquet(f"{path}/batch_id={batch_id}"), archive, batch_id)
    return both


def normalize_job(rows: DataFrame, valid_path: str, rejected_path: str, checkpoint: str, once: bool = False, archive: str | None = None):
    """Valid rows normalized, the rest as dead letters; the source is read once. ``archive`` keeps the valid rows by day and type."""
    write = valid_and_rejected_writer(valid_path, rejected_path, lambda df: normalize(df))
    return start(rows.writeStream.foreachBatch(_archived(write, valid_path, archive)), checkpoint, once)


def enrich_job(txn: DataFrame, path: str, checkpoint: str, once: bool = False, features: DataFrame | None = None, archive: str | None = None):
    """Main lane: all columns of the rows, rolling features from keyed state (needs the RocksDB state store, see
    ``STATE_STORE``) and, where ``features`` is given, customer features as they are when a batch is written.
    Late rows whose window can't be known any more have null features and ``late`` set. ``archive`` as in layer 1."""
    write = _archived(batch_partition_writer(path), path, archive)

    def process(batch: DataFrame, batch_id: int) -> None:
        write(batch if features is None else lookup_features(batch, features, BYPASS), batch_id)

    return start(rolling_stream(txn).writeStream.foreachBatch(process).outputMode("append"), checkpoint, once)


def enrich_hot_lane(txn: DataFrame, history_path: str, path: str, checkpoint: str, once: bool = False, grain: int = 3600):
    """Hot lane: each micro-batch is added to a dated history, and the batch operator runs on it with the
    day before. A customer of any size is spread over time buckets; repeated batches replace themselves.
    Rows without an event time go around the history and have null features, as in ``rolling_transactions``."""
    write = batch_partition_writer(path)

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept = batch.persist()  # its span, its customers, the history and the rows without time read the same rows
        try:
            timed = kept.filter(F.col("ts").isNotNull())
            dated = timed.withColumns({"dt": F.date_format("ts", "yyyy-MM-dd"), "batch": F.lit(batch_id)})
            # a batch without any time has nothing to write to the history, which may not exist yet
            lo, hi = timed.select(F.date_sub(F.to_date(F.min("ts")), 1).cast("string"), F.to_date(F.max("ts")).cast("string")).head()
            if lo is None:
                write(rolling_transactions(kept, grain=grain), batch_id)
                return
            overwrite_partitions(dated, history_path, ["dt", "batch"])
            history = spark.read.schema(dated.schema).parquet(history_path)
            near = history.filter((F.col("dt") >= lo) & (F.col("dt") <= hi) & (F.col("batch") <= batch_id))
            # only customers of the batch, and of each only from a day before its first row to its last one
            spans = timed.groupBy(F.struct("customer_id").alias("__who")).agg((F.min("ts") - F.expr("INTERVAL 1 DAY")).alias("__from"), F.max("ts").alias("__to"))
            own = (F.struct("customer_id") == F.col("__who")) & (F.col("ts") >= F.col("__from")) & (F.col("ts") <= F.col("__to"))
            rolled = rolling_transactions(near.join(spans, own, "left_semi"), grain=grain).filter(F.col("batch") == batch_id).drop("dt", "batch")
            measures = [F.lit(None).cast(rolled.schema[c].dataType).alias(c) for c in rolled.columns if c not in batch.columns]
            write(rolled.unionByName(kept.filter(F.col("ts").isNull()).select("*", *measures)), batch_id)
        finally:
            kept.unpersist()

    return start(txn.writeStream.foreachBatch(process), checkpoint, once)


def detect_job(spark: SparkSession, enriched: DataFrame, rules_path: str, path: str, checkpoint: str,
               sanctions: DataFrame | None = None, screen_column: str = "counterparty_id", once: bool = False):
    """Bypass, rule and sanction alerts per micro-batch. The small rule table is read anew for every batch,
    so changed rules take effect without a restart."""
    write = batch_partition_writer(path)

    def process(batch: DataFrame, batch_id: int) -> None:
        rules = collect_rules(read_rules(batch.sparkSession, rules_path))
        kept = batch.persist()  # rules and screening read the same rows
        try:
            hits = None if sanctions is None else sanction_alerts(screen(kept, sanctions, screen_column))
            write(all_alerts(kept, rules, hits), batch_id)
        finally:
            kept.unpersist()

    return start(enriched.writeStream.foreachBatch(process), checkpoint, once)


def aggregate_job(alerts: DataFrame, path: str, checkpoint: str, minutes: int = 30, watermark: str = "30 minutes", once: bool = False):
    """One alert per customer, rule and window, written when the watermark has passed the window."""
    timed = alerts.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", watermark)
    merged = dedup_tumbling(timed, minutes)
    return start(merged.writeStream.foreachBatch(batch_partition_writer(path)).outputMode("append"), checkpoint, once)


def aggregate_updates_job(alerts: DataFrame, path: str, checkpoint: str, minutes: int = 30, watermark: str = "30 minutes", once: bool = False):
    """One alert per customer, rule and window as it stands after every batch: groups that a batch changed replace
    their earlier rows in a versioned table (:func:`txnwatch.sources.versioned.read_merged`), by hours of the window."""
    timed = alerts.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", watermark)
    hour = F.date_format("window_start", "yyyy-MM-dd-HH")

    def process(batch: DataFrame, batch_id: int) -> None:
        merge_batch(batch, path, ["customer_id", "rule_id", "window_start"], hour, batch_id)

    return start(dedup_tumbling(timed, minutes).writeStream.foreachBatch(process).outputMode("update"), checkpoint, once)


def anchored_job(alerts: DataFrame, path: str, checkpoint: str, minutes: int = 30, watermark: str = "30 minutes", once: bool = False):
    """One alert per group that starts at its first alert, written when the watermark has passed its end; late alerts
    each for itself. Needs the RocksDB state store."""
    groups = dedup_anchored_stream(alerts, minutes, watermark)
    return start(groups.writeStream.foreachBatch(batch_partition_writer(path)).outputMode("append"), checkpoint, once)


def tumbling_job(txn: DataFrame, path: str, checkpoint: str, length: str = "24 hours", watermark: str = "1 hour", once: bool = False):
    """Fixed windows per customer, merged from hourly sketches in the same query, written when the watermark has passed them."""
    timed = txn.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    merged = merged_windows(hourly_sketches(timed), length)
    return start(merged.writeStream.foreachBatch(batch_partition_writer(path)).outputMode("append"), checkpoint, once)
