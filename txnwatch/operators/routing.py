"""Lanes against skew: busy customers and batch deposits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_PER_DAY = 1_000
BYPASS_HOT = "BYPASS_HOT"


def hot_customers(txn: DataFrame, per_day: int = HOT_PER_DAY) -> DataFrame:
    """Customers and days with more than ``per_day`` transactions."""
    return txn.groupBy("customer_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("txn_count")).filter(
        F.col("txn_count") > per_day)


def tag_hot(txn: DataFrame, hot: DataFrame) -> DataFrame:
    """Main-lane rows of a hot customer and day go to the hot lane."""
    keys = hot.select(F.col("customer_id").alias("__cid"), F.col("day").alias("__day")).distinct()
    joined = txn.join(keys, (F.col("customer_id") == F.col("__cid")) & (F.to_date("ts") == F.col("__day")), "left")
    busy = F.col("__cid").isNotNull() & (F.col("route_tag") == "MAIN")
    return joined.withColumn("route_tag", F.when(busy, F.lit(BYPASS_HOT)).otherwise(F.col("route_tag"))).drop("__cid", "__day")


def batch_deposits(txn: DataFrame, more_than: int = 3) -> DataFrame:
    """Deposits of one customer from one counterparty on one day, as one batch when there are many.

    Grouped on all three keys with partial sums; a batch carries its id, size and total.
    """
    day = F.to_date("ts")
    grouped = txn.groupBy("customer_id", "counterparty_id", day.alias("day")).agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum("amount_usd").cast("decimal(18,2)").alias("total_amount"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).filter(F.col("txn_count") > more_than)
    return grouped.withColumn("batch_id", F.concat_ws("|", "customer_id", "counterparty_id", F.col("day").cast("string")))
