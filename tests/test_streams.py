"""Streams in several micro-batches give what the batch operators give."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from txnwatch.operators import dedup, packs, rolling, rules
from txnwatch.operators import normalize as norm
from txnwatch.plans.mapping import table
from txnwatch.schemas import TXN_JSON
from txnwatch.sources.streams import parse_json, read_messages, to_messages
from txnwatch.streaming import jobs


@pytest.fixture
def in_order(spark, sf_dir, tmp_path):
    """The transactions as four files, each later than the one before, read one per micro-batch."""
    path = str(tmp_path / "in")
    txn = table(spark, sf_dir, "txn").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").toPandas()
    for i, part in enumerate(pd.DataFrame(txn).groupby(lambda r: r * 4 // len(txn))):
        spark.createDataFrame(part[1]).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


def _rows(df, columns):
    return sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect())


def test_keyed_state_equals_batch(spark, in_order, tmp_path):
    stream, batch = in_order
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    jobs.enrich_job(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    columns = ["txn_id", *[f"{m}_{w}" for w in ("1h", "24h") for m in ("txn_count", "total_amount", "max_amount", "unique_counterparties")]]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.select("batch_id").distinct().count() >= 4
    assert _rows(out, columns) == _rows(rolling.rolling_transactions(batch), columns)


def test_hot_lane_equals_batch(spark, in_order, tmp_path):
    stream, batch = in_order
    jobs.enrich_hot_lane(stream, str(tmp_path / "h"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    columns = ["txn_id", "txn_count_24h", "total_amount_24h", "max_amount_1h", "unique_counterparties_24h"]
    assert _rows(spark.read.parquet(str(tmp_path / "out")), columns) == _rows(rolling.rolling_transactions(batch), columns)


def test_hot_lane_keeps_rows_without_time(spark, in_order, tmp_path):
    """Rows without an event time, among others and as a whole micro-batch (the first and the last)."""
    _, batch = in_order
    path = str(tmp_path / "untimed")
    some = batch.orderBy("ts").limit(40).toPandas()
    parts = [some[:5].assign(ts=pd.NaT), some[5:30], some[30:35].assign(ts=pd.NaT), some[35:40].assign(ts=[*some["ts"][35:38], pd.NaT, pd.NaT])]
    for part in parts:
        spark.createDataFrame(part, batch.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.enrich_hot_lane(stream, str(tmp_path / "h"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    columns = ["txn_id", "ts", "txn_count_24h", "total_amount_24h", "max_amount_1h", "unique_counterparties_24h"]
    assert _rows(out, columns) == _rows(rolling.rolling_transactions(spark.read.parquet(path)), columns)
    assert out.filter("ts IS NULL AND txn_count_24h IS NULL").count() == 12 and out.count() == 40


def test_rules_are_read_for_every_batch(spark, in_order, tmp_path):
    stream, batch = in_order
    pack = [r for r in packs.lowered_pack() if r["rule_id"] == "SAR-003"]
    rules.rule_frame(spark, pack).coalesce(1).write.json(str(tmp_path / "rules"))
    jobs.detect_job(spark, norm.normalize(stream), str(tmp_path / "rules"), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    want = rules.all_alerts(norm.normalize(batch), rules.collect_rules(rules.rule_frame(spark, pack)))
    columns = ["alert_id", "rule_id", "rule_desc", "customer_id"]
    assert _rows(spark.read.parquet(str(tmp_path / "out")), columns) == _rows(want, columns)


def test_dedup_stream_closes_windows(spark, in_order, tmp_path):
    stream, batch = in_order

    def as_alerts(df):
        return df.select(F.col("txn_id").alias("alert_id"), "txn_id", "customer_id", F.lit("R").alias("rule_id"), F.lit("RULE").alias("alert_type"),
                         F.lit("HIGH").alias("severity"), F.col("ts").alias("created_at"))

    jobs.aggregate_job(as_alerts(stream), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    want = dedup.dedup_tumbling(as_alerts(batch))
    closed = batch.select((F.max("ts") - F.expr("interval 30 minutes"))).first()[0]
    columns = ["customer_id", "window_start", "alert_id", "alert_count"]
    assert _rows(spark.read.parquet(str(tmp_path / "out")), columns) == _rows(want.filter(F.col("window_end") <= F.lit(closed)), columns)


def test_replayed_batch_replaces_itself(spark, tmp_path):
    from txnwatch.sources.sinks import batch_partition_writer

    write = batch_partition_writer(str(tmp_path / "t"))
    write(spark.range(5), 0)
    write(spark.range(3), 1)
    write(spark.range(5), 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 8


def test_text_messages_through_json(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"txnId":"T1","amount":5,"extra":1}\nbroken\n')
    raw = read_messages(spark, "text", {}, str(tmp_path / "in"))
    parsed = norm.to_canonical(parse_json(raw, TXN_JSON))
    jobs.normalize_job(parsed.withColumn("customer_id", F.lit("C")), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp"), once=True).awaitTermination()
    assert [r.txn_id for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["T1"]
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert bad[0].raw_value == "broken" and bad[0].reject_reasons == ["txn_id", "amount"]
    assert to_messages(spark.range(1), topic="t").first().value == '{"id":0}'
