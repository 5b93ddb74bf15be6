"""Investigation cases as a fold of events, their queue and linked alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.columns import queue_order
from txnwatch.operators.ranking import range_row_number

OPEN_STATES = ["OPEN", "INVESTIGATING"]


def fold_cases(events: DataFrame) -> DataFrame:
    """Current state of each case from CREATE, ASSIGN, UPDATE and ESCALATE events.

    Each field is the last value an event gave it, so the fold is a plain aggregate with partial sums.
    """
    event, seq = F.col("event"), F.col("seq")
    status = (F.when(event == "CREATE", F.lit("OPEN")).when(event == "ASSIGN", F.lit("INVESTIGATING"))
              .when(event == "ESCALATE", F.lit("ESCALATED")).when(F.col("resolution").isNotNull(), F.lit("CLOSED"))
              .otherwise(F.col("status")))
    notes = F.when(event == "ESCALATE", F.concat(F.lit("ESCALATED: "), F.coalesce("notes", F.lit("")))).otherwise(F.col("notes"))
    solved = (event == "UPDATE") & F.col("resolution").isNotNull()

    def last(value: Column, given: Column | None = None) -> Column:
        return F.max_by(value, F.when(value.isNotNull() if given is None else given, seq))

    created = event == "CREATE"
    return events.groupBy("case_id").agg(
        last(F.col("customer_id")).alias("customer_id"), last(F.col("priority")).alias("priority"),
        last(status).alias("status"), last(F.col("actor"), event == "ASSIGN").alias("assigned_to"),
        last(F.col("actor"), created).alias("created_by"), last(notes).alias("notes"),
        last(F.col("resolution")).alias("resolution"), last(F.col("linked_alert_ids")).alias("linked_alert_ids"),
        last(F.col("event_at"), created).alias("created_at"), F.max_by("event_at", "seq").alias("updated_at"),
        last(F.col("event_at"), solved).alias("closed_at"))


def case_queue(cases: DataFrame) -> DataFrame:
    """Open cases by priority, then age."""
    waiting = cases.filter(F.col("status").isin(OPEN_STATES))
    return range_row_number(waiting, [queue_order(F.col("priority")), F.col("created_at"), F.col("case_id")])


def select_cases(cases: DataFrame, status: str | None = None, customer_id: str | None = None, assigned_to: str | None = None) -> DataFrame:
    for name, value in {"status": status, "customer_id": customer_id, "assigned_to": assigned_to}.items():
        if value is not None:
            cases = cases.filter(F.col(name) == value)
    return cases


def linked_alerts(cases: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per case and alert named in its comma-separated list."""
    listed = cases.filter(F.col("linked_alert_ids").isNotNull()).select(
        "case_id", F.explode(F.split("linked_alert_ids", ",")).alias("x")).select("case_id", F.trim("x").alias("__aid"))
    return listed.filter(F.col("__aid") != "").join(alerts, F.col("__aid") == F.col("alert_id")).drop("__aid")
