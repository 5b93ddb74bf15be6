"""KYC review schedule and profile changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.operators.ranking import range_row_number

# Months until the next review by risk level; other levels and no level.
REVIEW_MONTHS = {"HIGH": 3, "PROHIBITED": 3, "MEDIUM": 12}
OTHER_MONTHS, NO_LEVEL_MONTHS = 24, 12
DUE_DAYS = 30


def next_review(risk_level: Column, now: Column) -> Column:
    """Review date counted from ``now``, keeping its time of day."""
    months = F.when(risk_level.isNull(), F.lit(NO_LEVEL_MONTHS))
    for level, n in REVIEW_MONTHS.items():
        months = months.when(risk_level == level, F.lit(n))
    return now + F.make_interval(months=months.otherwise(F.lit(OTHER_MONTHS)))


def review_status(next_review_date: Column, now: Column) -> Column:
    soon = now + F.make_interval(days=F.lit(DUE_DAYS))
    return (F.when(next_review_date.isNull(), F.lit("DUE")).when(now > next_review_date, F.lit("OVERDUE"))
            .when(soon > next_review_date, F.lit("DUE")).otherwise(F.lit("CURRENT")))


def overdue_reviews(profiles: DataFrame, now: Column) -> DataFrame:
    """Reviews that have fallen due but are not marked OVERDUE yet."""
    return profiles.filter((F.col("next_review_date") <= now) & (F.col("review_status") != "OVERDUE"))


def high_risk(profiles: DataFrame, score: str = "risk_points") -> DataFrame:
    """HIGH customers by score, highest first."""
    chosen = profiles.filter(F.col("risk_level") == "HIGH")
    return range_row_number(chosen, [F.col(score).desc_nulls_last(), F.col("customer_id")])


def apply_changes(profiles: DataFrame, changes: DataFrame, score: str = "risk_points") -> DataFrame:
    """Profiles after a batch of ordered changes: UPSERT, RISK (new level and score) and REVIEW (completed).

    Risk changes and reviews restart the schedule from their own time; an upsert schedules only a profile
    that has no date. Only a review sets the date of the last review. Every field keeps its last given value, so
    no ordered list of changes is collected. Risk changes and reviews of unknown customers make no profile: see
    :func:`unknown_customers`. ``review_status`` is worked out again where ``profiles`` has it.
    """
    made = changes.where("change = 'UPSERT'").select(F.col("customer_id").alias("__made")).distinct()
    known = profiles.select(F.col("customer_id").alias("__made")).union(made).distinct()
    changes = changes.join(known, F.col("customer_id") == F.col("__made"), "left_semi")
    restarts = F.col("change").isin("RISK", "REVIEW")
    given = F.when(F.col("risk_level").isNotNull(), F.col("seq"))
    last = changes.groupBy(F.col("customer_id").alias("__cid")).agg(
        F.max_by("risk_level", given).alias("__level"),
        F.max_by(score, F.when(F.col(score).isNotNull(), F.col("seq"))).alias("__score"),
        F.max_by(F.struct("change", "change_at", "seq"), F.when(restarts, F.col("seq"))).alias("__restart"),
        F.min_by(F.struct("change_at", "risk_level"), F.when(F.col("change") == "UPSERT", F.col("seq"))).alias("__upsert"),
        F.max_by("change_at", F.when(F.col("change") == "REVIEW", F.col("seq"))).alias("__reviewed"),
        F.max_by("change_at", "seq").alias("__at"))
    # Level in force at the last restart: the last one given up to it, else the stored one.
    marks = last.filter(F.col("__restart").isNotNull()).select("__cid", F.col("__restart.seq").alias("__until"))
    then = (changes.join(marks, (F.col("customer_id") == F.col("__cid")) & (F.col("seq") <= F.col("__until")))
            .groupBy(F.col("__cid").alias("__tid")).agg(F.max_by("risk_level", given).alias("__level_then")))
    last = last.join(then, F.col("__cid") == F.col("__tid"), "left").drop("__tid")
    joined = profiles.join(last, F.col("customer_id") == F.col("__cid"), "full")
    restart, upsert = F.col("__restart"), F.col("__upsert")
    level_then = F.coalesce("__level_then", "risk_level")
    dated = F.coalesce(
        F.when(restart.isNotNull(), next_review(level_then, restart["change_at"])), F.col("next_review_date"),
        F.when(upsert.isNotNull(), next_review(F.coalesce(upsert["risk_level"], F.col("risk_level")), upsert["change_at"])))
    stored = [F.col("last_review_date")] if "last_review_date" in profiles.columns else []
    reviewed = F.coalesce("__reviewed", *stored)
    status = [review_status(dated, F.col("__at"))] if "review_status" in profiles.columns else []
    out = joined.select(
        F.coalesce("customer_id", "__cid").alias("customer_id"),
        F.coalesce("__level", "risk_level").alias("risk_level"), F.coalesce("__score", score).alias(score),
        dated.alias("next_review_date"), reviewed.alias("last_review_date"), F.col("__at").alias("updated_at"),
        *[F.when(F.col("__at").isNull(), F.col("review_status")).otherwise(s).alias("review_status") for s in status])
    return out


def unknown_customers(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Risk changes and reviews of customers that have no profile and get none by an upsert in the same batch."""
    made = changes.where("change = 'UPSERT'").select(F.col("customer_id").alias("__made"))
    known = profiles.select(F.col("customer_id").alias("__made")).union(made).distinct()
    return changes.where("change <> 'UPSERT'").join(known, F.col("customer_id") == F.col("__made"), "left_anti")


def pattern_changes(features: DataFrame, factor: float = 2.0) -> DataFrame:
    """Customers whose last seven days ran at ``factor`` times their 30-day daily rate or more."""
    weekly, monthly = F.col("txn_count_7d") / F.lit(7.0), F.col("txn_count_30d") / F.lit(30.0)
    return features.filter((F.col("txn_count_30d") > 0) & (weekly >= monthly * F.lit(factor)))
