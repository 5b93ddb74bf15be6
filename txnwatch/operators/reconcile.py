"""Nightly recomputation of alerts and its comparison with the streamed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["txn_id", "alert_type"]
ALERT_ABOVE = 0.001


def batch_alerts(txn: DataFrame, day: str | None = None, ctr_from: int = 10_000, sar_count: int = 5, sar_total: int = 40_000) -> DataFrame:
    """CTR-001 and SAR-001 recomputed on calendar days; CTR wins when both hold.

    The day aggregate is reduced before its shuffle and only customers that meet the SAR limits are joined
    back, so the large side meets a small one.
    """
    dated = txn.withColumn("report_date", F.to_date("ts"))
    if day is not None:
        dated = dated.filter(F.col("report_date") == F.lit(day).cast("date"))
    busy = dated.groupBy(F.col("customer_id").alias("__cid"), F.col("report_date").alias("__day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("amount_usd").alias("top"), F.sum("amount_usd").alias("total"),
    ).filter((F.col("n") >= sar_count) & (F.col("top") < ctr_from) & (F.col("total") >= sar_total)).select("__cid", "__day")
    joined = dated.join(busy, (F.col("customer_id") == F.col("__cid")) & (F.col("report_date") == F.col("__day")), "left")
    ctr = (F.col("amount_usd") >= ctr_from) & F.col("channel").isin("ATM", "BRANCH")
    kind = F.when(ctr, F.lit("CTR")).when(F.col("__cid").isNotNull(), F.lit("SAR"))
    return (joined.withColumn("alert_type", kind).filter(F.col("alert_type").isNotNull())
            .select("txn_id", "alert_type", F.concat("alert_type", F.lit("-001")).alias("rule_id"), F.col("ts").alias("created_at"), "report_date"))


def compared(batch: DataFrame, realtime: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Distinct keys of both sides with flags, from one shuffle of a tagged union."""
    keys = (by or []) + KEYS
    tagged = (batch.select(*keys, F.lit(1).alias("b"), F.lit(0).alias("r"))
              .unionByName(realtime.select(*keys, F.lit(0).alias("b"), F.lit(1).alias("r"))))
    return tagged.groupBy(*keys).agg(F.max("b").alias("in_batch"), F.max("r").alias("in_realtime"))


def reconcile(batch: DataFrame, realtime: DataFrame, by: list[str] | None = None, rules: list[str] | None = None) -> DataFrame:
    """Counts, missing, extra and the difference rate; ``rules`` limits both sides to rules both know."""
    if rules is not None:
        batch, realtime = batch.filter(F.col("rule_id").isin(rules)), realtime.filter(F.col("rule_id").isin(rules))
    b, r = F.col("in_batch"), F.col("in_realtime")
    sums = compared(batch, realtime, by).groupBy(*(by or [])).agg(
        F.coalesce(F.sum(b), F.lit(0)).alias("batch_alerts"), F.coalesce(F.sum(r), F.lit(0)).alias("realtime_alerts"),
        F.coalesce(F.sum(b * (1 - r)), F.lit(0)).alias("missing_in_realtime"),
        F.coalesce(F.sum(r * (1 - b)), F.lit(0)).alias("extra_in_realtime"))
    rate = F.when(F.col("batch_alerts") > 0, F.col("missing_in_realtime") / F.col("batch_alerts")).otherwise(F.lit(0.0))
    return sums.withColumn("diff_rate", F.round(rate, 6)).withColumn("exceeds", rate > ALERT_ABOVE)


def missing_in_realtime(batch: DataFrame, realtime: DataFrame) -> DataFrame:
    return compared(batch, realtime).filter("in_realtime = 0").select(*KEYS)


def extra_in_realtime(batch: DataFrame, realtime: DataFrame) -> DataFrame:
    return compared(batch, realtime).filter("in_batch = 0").select(*KEYS)
