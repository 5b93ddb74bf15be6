"""Customer risk: both scoring models, the 30-day profile, features and entity snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.columns import mapped

# Country weights of the factor model, weights and limits of both models.
COUNTRY_WEIGHTS = {"IR": 1.0, "KP": 1.0, "SY": 0.9, "CU": 0.8, "US": 0.1, "GB": 0.1, "DE": 0.1, "FR": 0.1}
FACTOR_WEIGHTS = {"country_risk": 0.3, "product_risk": 0.25, "customer_type_risk": 0.25, "pattern_risk": 0.2}
HIGH_FROM, MEDIUM_FROM = 0.7, 0.4


def factor_score(country: Column, product: Column, customer_type: Column, pattern: Column) -> Column:
    """Weighted sum of four factors, held within 0 and 1."""
    w = FACTOR_WEIGHTS
    total = (country * w["country_risk"] + product * w["product_risk"]
             + customer_type * w["customer_type_risk"] + pattern * w["pattern_risk"])
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))


def risk_level(score: Column) -> Column:
    return F.when(score >= HIGH_FROM, F.lit("HIGH")).when(score >= MEDIUM_FROM, F.lit("MEDIUM")).otherwise(F.lit("LOW"))


def country_weight(country: Column, other: float = 0.5) -> Column:
    return mapped(country, COUNTRY_WEIGHTS, other)


def profile_score(nationality: Column, txn_count_30d: Column) -> Column:
    """The nightly two-part score: where the customer is from, how busy the last 30 days were."""
    country = F.when(nationality.isin("IR", "KP", "SY"), 1.0).when(nationality.isin("US", "GB", "DE"), 0.1).otherwise(0.5)
    pattern = F.when(txn_count_30d > 100, 0.8).when(txn_count_30d > 50, 0.5).otherwise(0.2)
    return country * 0.3 + pattern * 0.7


def customer_profile(txn: DataFrame, as_of: str, days: int = 30, recent: int = 7) -> DataFrame:
    """Per customer count, sum, mean, maximum and distinct counterparties of the days before ``as_of``.

    Spark counts the distinct parties by (customer, party) first, so a hot customer is spread.
    """
    end = F.lit(as_of).cast("date")
    since = F.date_sub(end, days).cast(txn.schema["ts"].dataType)
    recent_row = F.col("ts") >= F.date_sub(end, recent).cast(txn.schema["ts"].dataType)
    until = F.date_add(end, 1).cast(txn.schema["ts"].dataType)
    amount = F.col("amount_usd")
    return txn.filter((F.col("ts") >= since) & (F.col("ts") < until)).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("txn_count_30d"),
        F.sum(amount).cast("decimal(18,2)").alias("total_amount_30d"),
        F.round(F.sum(amount).cast("double") / F.count(amount), 6).alias("avg_amount"),
        F.max(amount).alias("max_amount"),
        F.count_distinct("counterparty_id").alias("unique_counterparties_30d"),
        F.count_if(recent_row).alias("txn_count_7d"),
        F.sum(F.when(recent_row, amount).otherwise(0)).cast("decimal(18,2)").alias("total_amount_7d"))


def build_customer_features(txn: DataFrame, entity: DataFrame, as_of: str, alerts: DataFrame | None = None) -> DataFrame:
    """Entity rows with their profile (zeros when quiet), risk score and level, and alert counts."""
    profile = customer_profile(txn, as_of)
    out = entity.join(profile.withColumnRenamed("customer_id", "__cid"), F.col("customer_id") == F.col("__cid"), "left").drop("__cid")
    money = F.lit(0).cast("decimal(18,2)")
    zeros = {"txn_count_30d": F.lit(0), "txn_count_7d": F.lit(0), "unique_counterparties_30d": F.lit(0), "avg_amount": F.lit(0.0),
             "total_amount_30d": money, "total_amount_7d": money, "max_amount": money}
    out = out.withColumns({name: F.coalesce(F.col(name), zero) for name, zero in zeros.items()})
    if alerts is None:
        out = out.withColumns({"alert_count_total": F.lit(0).cast("bigint"), "open_alert_count": F.lit(0)})
    else:
        still_open = ~F.col("status").isin("CLOSED", "REPORTED")
        counts = alerts.groupBy(F.col("customer_id").alias("__cid")).agg(
            F.count(F.lit(1)).alias("a"), F.count_if(still_open).alias("o"))
        out = out.join(counts, F.col("customer_id") == F.col("__cid"), "left").withColumns({
            "alert_count_total": F.coalesce("a", F.lit(0)), "open_alert_count": F.coalesce("o", F.lit(0)).cast("int")}).drop("__cid", "a", "o")
    out = out.withColumn("risk_score", F.round(profile_score(F.col("nationality"), F.col("txn_count_30d")), 6))
    kyc = F.col("kyc_level") if "kyc_level" in entity.columns else F.lit("UNKNOWN")
    return out.withColumns({"risk_level": risk_level(F.col("risk_score")), "kyc_status": kyc, "dt": F.lit(as_of)})


_FEATURES = ["risk_level", "risk_score", "txn_count_7d", "txn_count_30d", "total_amount_7d", "total_amount_30d",
             "avg_amount", "max_amount", "unique_counterparties_30d", "alert_count_total", "open_alert_count"]


def build_entity_snapshot(entity: DataFrame, features: DataFrame, date: str) -> DataFrame:
    """The latest snapshot before ``date`` joined with that day's features, filled for quiet customers."""
    earlier = entity.filter(F.col("dt") < date)
    latest = earlier.filter(F.col("dt") == earlier.agg(F.max("dt")).scalar()).drop("dt")
    today = features.filter(F.col("dt") == date).select(F.col("customer_id").alias("__cid"), *_FEATURES)
    base = latest.select(*[c for c in latest.columns if c not in _FEATURES])
    return (base.join(today, F.col("customer_id") == F.col("__cid"), "left").drop("__cid")
            .na.fill(0, ["txn_count_7d", "txn_count_30d", "alert_count_total", "open_alert_count"])
            .na.fill(0.0, ["risk_score"]).na.fill("UNKNOWN", ["risk_level"])
            .withColumn("dt", F.lit(date)))
