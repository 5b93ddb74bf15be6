"""Regulatory extracts, documents, daily volumes and report status."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.columns import utc_day, xml_text
from txnwatch.operators.ranking import scaled_row_number

PENDING, SUBMITTED = "PENDING_SUBMISSION", "SUBMITTED"


def ctr_extract(alerts: DataFrame, day: str | None = None) -> DataFrame:
    """All CTR alerts, of one day or with their day as ``dt``."""
    return _of_day(alerts.filter(F.col("alert_type") == "CTR"), day)


def sar_extract(alerts: DataFrame, day: str | None = None) -> DataFrame:
    """SAR alerts that have been reported."""
    return _of_day(alerts.filter((F.col("alert_type") == "SAR") & (F.col("status") == "REPORTED")), day)


def _of_day(alerts: DataFrame, day: str | None) -> DataFrame:
    if day is not None:  # a range of the column itself, so that it reaches the scan
        start = F.lit(day).cast("timestamp")
        alerts = alerts.filter((F.col("created_at") >= start) & (F.col("created_at") < start + F.expr("INTERVAL 1 DAY")))
    return alerts.withColumn("dt", utc_day(F.col("created_at")))


def with_txn_details(extract: DataFrame, txn: DataFrame, columns: list[str]) -> DataFrame:
    """Adds transaction columns (amount, currency, channel) to an extract."""
    wanted = txn.select(F.col("txn_id").alias("__tid"), *columns)
    return extract.join(wanted, F.col("txn_id") == F.col("__tid"), "left").drop("__tid")


def daily_summary(txn: DataFrame, alerts: DataFrame, day: str | None = None) -> DataFrame:
    """Transactions, total, distinct customers and alert counts per day.

    Volumes come from the transactions alone; CTR and SAR count the distinct alerts of that day's
    transactions, so several alerts on one transaction do not multiply its amount.
    """
    dated = txn.withColumn("report_date", F.to_date("ts"))
    if day is not None:
        dated = dated.filter(F.col("report_date") == F.lit(day).cast("date"))
    volumes = dated.groupBy("report_date").agg(
        F.count(F.lit(1)).alias("total_transactions"), F.sum("amount_usd").cast("decimal(18,2)").alias("total_amount"),
        F.count_distinct("customer_id").alias("unique_customers"))
    counted = alerts.filter(F.col("alert_type").isin("CTR", "SAR")).select("alert_id", "alert_type", F.col("txn_id").alias("__tid")).distinct()
    hits = dated.select("txn_id", "report_date").join(counted, F.col("txn_id") == F.col("__tid")).groupBy(
        F.col("report_date").alias("__day")).agg(
        F.count_if(F.col("alert_type") == "CTR").alias("ctr_count"), F.count_if(F.col("alert_type") == "SAR").alias("sar_count"))
    return volumes.join(hits, F.col("report_date") == F.col("__day"), "left").drop("__day").na.fill(0, ["ctr_count", "sar_count"])


# Fixed value: the regulator's document layout; the detail line is one of the two below it.
DOCUMENT = """<?xml version="1.0" encoding="UTF-8"?>
<FATFReport xmlns="urn:fatf:report:1.0">
  <ReportHeader>
    <ReportType>{report_type}</ReportType>
    <ReportId>{report_id}</ReportId>
    <SubmissionDate>{submission_date}</SubmissionDate>
  </ReportHeader>
  <ReportBody>
    <Subject>
      <CustomerId>{customer_id}</CustomerId>
    </Subject>
    <Transaction>
      <Amount currency="{currency}">{amount}</Amount>
      <DETAIL/>
    </Transaction>
  </ReportBody>
</FATFReport>"""
DETAILS = {"channel": "<Channel>{channel}</Channel>", "date": "<Date>{txn_date}</Date>"}


def report_xml(rows: DataFrame, report_type: Column, submission_date: Column, layout: str = "channel") -> DataFrame:
    """Adds ``content``: the document with ``<Channel>`` or with ``<Date>``; all values are escaped."""
    given = {"report_type": report_type, "submission_date": submission_date}
    pieces = re.split(r"\{(\w+)\}", DOCUMENT.replace("<DETAIL/>", DETAILS[layout]))
    parts = [xml_text(given.get(piece, F.col(piece))) if i % 2 else F.lit(piece) for i, piece in enumerate(pieces)]
    return rows.withColumn("content", F.concat(*parts))


def summary_json(rows: DataFrame, chunk: int = 1000) -> DataFrame:
    """The summary document of each day, in numbered parts of ``chunk`` reports.

    Joining the parts in order gives the whole document; no task ever holds all reports of a day.
    ``rows`` has report_date, report_id, customer_id, amount and created_at.
    """
    totals = rows.groupBy(F.col("report_date").alias("__day")).agg(F.count(F.lit(1)).alias("total"))
    ranked = scaled_row_number(rows, ["report_date"], [F.date_trunc("minute", "created_at")],
                               [F.col("created_at"), F.col("report_id")])
    item = F.to_json(F.struct(F.col("report_id").alias("id"), F.col("customer_id").alias("customer"), F.col("amount").alias("amount")))
    part = F.floor((F.col("rank") - 1) / F.lit(chunk)).cast("bigint")
    parts = ranked.groupBy("report_date", part.alias("part")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank"), item.alias("item")))).alias("items"))
    parts = parts.join(totals, F.col("report_date") == F.col("__day"))
    last = F.col("part") == F.floor((F.col("total") - 1) / F.lit(chunk))
    head = F.concat(F.lit('{"report_type":"SUMMARY","generated_at":"'), F.col("report_date").cast("string"),
                    F.lit('","total_count":'), F.col("total").cast("string"), F.lit(',"reports":['))
    body = F.concat_ws(",", F.transform("items", lambda x: x["item"]))
    content = F.concat(F.when(F.col("part") == 0, head).otherwise(F.lit(",")), body, F.when(last, F.lit("]}")).otherwise(F.lit("")))
    return parts.select("report_date", "part", F.size("items").cast("bigint").alias("reports"), content.alias("content"))


def fold_reports(events: DataFrame) -> DataFrame:
    """Current report state from GENERATE, SUBMIT and UPDATE events."""
    event, seq = F.col("event"), F.col("seq")
    status = (F.when(event == "GENERATE", F.lit(PENDING)).when(event == "SUBMIT", F.lit(SUBMITTED)).otherwise(F.col("status")))

    def last(value: Column, given: Column) -> Column:
        return F.max_by(value, F.when(given, seq))

    made, sent = event == "GENERATE", event == "SUBMIT"
    return events.groupBy("report_id").agg(
        last(F.col("report_type"), made).alias("report_type"), last(F.col("customer_id"), made).alias("customer_id"),
        last(status, status.isNotNull()).alias("status"),
        last(F.col("submission_id"), F.col("submission_id").isNotNull()).alias("submission_id"),
        last(F.col("actor"), sent).alias("submitted_by"), last(F.col("event_at"), sent).alias("submitted_at"),
        last(F.col("event_at"), made).alias("generated_at"))


def select_reports(reports: DataFrame, report_type: str | None = None, status: str | None = None, customer_id: str | None = None) -> DataFrame:
    for name, value in {"report_type": report_type, "status": status, "customer_id": customer_id}.items():
        if value is not None:
            reports = reports.filter(F.col(name) == value)
    return reports


def pending_submissions(reports: DataFrame) -> DataFrame:
    return select_reports(reports, status=PENDING)


def ctr_events(alerts: DataFrame, txn: DataFrame) -> DataFrame:
    """CTR alerts as events carrying the transaction's amount, currency and channel."""
    ctr = alerts.filter(F.col("alert_type") == "CTR").select("alert_id", "txn_id", "customer_id", "created_at")
    return with_txn_details(ctr, txn, ["amount", "currency", "channel"]).withColumnRenamed("alert_id", "ctr_id")
