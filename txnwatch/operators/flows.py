"""Deposits and withdrawals of a customer, matched first in, first out.

Money that comes in lines up on an axis of cents, and so does money that goes out: each withdrawal takes the oldest
deposits that are still there. What a withdrawal takes beyond all deposits so far is other money and matches nothing,
so the matched outflow is ``W + min(0, min(D - W))`` of the cumulative deposits ``D`` and withdrawals ``W`` up to it.
Both sides then tile the axis without gaps, and every stretch between two neighbouring cuts is one deposit's money in
one withdrawal: as many rows as there are cuts.

Running values over a customer's whole history are worked out in ranges of the order: a range needs only sums, the
lowest balance and the last cut of the ranges before it. So a customer with a third of all rows is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.operators.rolling import DAY, _cents, _money
from txnwatch.session import cut_lineage

_US = 1_000_000
_FIRST, _HERE = Window.unboundedPreceding, Window.currentRow


def _in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` (k, …) dealt to ranges of (k, order…), with the number of the range as ``part``; written, so that it stays."""
    return cut_lineage(df.repartitionByRange("k", *order).withColumn("part", F.spark_partition_id()))


def _before(order: str = "part"):
    return Window.partitionBy("k").orderBy(order).rowsBetween(_FIRST, -1)


def _or_zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0))


def _cuts(rows: DataFrame) -> DataFrame:
    """(k, pos, kind, end, txn_id, t, cents): what each deposit (kind 0) and each withdrawal (kind 1) covers of the axis."""
    placed = _in_ranges(rows, ["t", "kind", "txn_id"])
    inner = Window.partitionBy("k", "part").orderBy("t", "kind", "txn_id")
    came, left = (_or_zero(F.when(F.col("kind") == k, F.col("cents"))) for k in (0, 1))
    run = placed.withColumns({"d": F.sum(came).over(inner.rowsBetween(_FIRST, _HERE)), "w": F.sum(left).over(inner.rowsBetween(_FIRST, _HERE))})
    net = F.col("d") - F.col("w")
    run = run.withColumns({"low": F.min(net).over(inner.rowsBetween(_FIRST, _HERE)), "low_before": F.min(net).over(inner.rowsBetween(_FIRST, -1))})
    parts = run.groupBy("k", "part").agg(F.sum(came).alias("came"), F.sum(left).alias("left"), F.min("low").alias("lowest"))
    parts = parts.withColumns({"d0": _or_zero(F.sum("came").over(_before())), "w0": _or_zero(F.sum("left").over(_before()))})
    parts = parts.withColumn("low0", F.min(F.col("d0") - F.col("w0") + F.col("lowest")).over(_before()))
    whole = run.join(parts.select("k", "part", "d0", "w0", "low0"), ["k", "part"])

    def matched(low: str, own: Column) -> Column:
        floor = F.least(F.lit(0), F.col("low0"), F.col("d0") - F.col("w0") + F.col(low))  # nulls are skipped
        return F.col("w0") + F.col("w") - own + floor
    ends = F.when(F.col("kind") == 0, F.col("d0") + F.col("d")).otherwise(matched("low", F.lit(0)))
    starts = F.when(F.col("kind") == 0, F.col("d0") + F.col("d") - F.col("cents")).otherwise(matched("low_before", F.col("cents")))
    return whole.select("k", starts.alias("pos"), "kind", ends.alias("end"), "txn_id", "t", "cents").filter(F.col("end") > F.col("pos"))


def match_flows(txn: DataFrame) -> DataFrame:
    """(customer_id, deposit_id, deposit_at, deposit_amount, withdrawal_id, withdrawal_at, amount): money in and out again.

    Rows of both directions with a time and a positive ``amount_usd`` take part. At one instant deposits come before
    withdrawals, then smaller ids first. ``amount`` is the part of the deposit that the withdrawal takes. Customers
    without an id are one customer, as in the rolling operators.
    """
    kind = F.when(F.col("direction") == "INBOUND", 0).when(F.col("direction") == "OUTBOUND", 1)
    rows = txn.select(F.struct("customer_id").alias("k"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), kind.alias("kind"), "txn_id",
                      _cents(F.col("amount_usd")).alias("cents")).filter("t IS NOT NULL AND kind IS NOT NULL AND cents > 0")
    cuts = _in_ranges(_cuts(rows), ["pos", "kind"])
    side = {k: F.when(F.col("kind") == k, F.struct("pos", "end", "txn_id", "t", "cents")) for k in (0, 1)}
    inner = Window.partitionBy("k", "part").orderBy("pos", "kind").rowsBetween(_FIRST, _HERE)
    last = {f"last{k}": F.last(side[k], ignorenulls=True).over(inner) for k in (0, 1)}
    # intervals of a side follow each other, so the last one before a range is the one that starts last
    parts = cuts.groupBy("k", "part").agg(*[F.max(side[k]).alias(f"most{k}") for k in (0, 1)])
    parts = parts.select("k", "part", *[F.max(f"most{k}").over(_before()).alias(f"past{k}") for k in (0, 1)])
    met = cuts.withColumns(last).join(parts, ["k", "part"]).select(
        "k", "pos", F.coalesce("last0", "past0").alias("i"), F.coalesce("last1", "past1").alias("o"))
    shared = F.least("i.end", "o.end") - F.col("pos")
    return met.filter(F.col("i").isNotNull() & F.col("o").isNotNull() & (shared > 0)).select(
        F.col("k.customer_id").alias("customer_id"), F.col("i.txn_id").alias("deposit_id"), F.timestamp_micros("i.t").alias("deposit_at"),
        _money(F.col("i.cents")).alias("deposit_amount"), F.col("o.txn_id").alias("withdrawal_id"), F.timestamp_micros("o.t").alias("withdrawal_at"),
        _money(shared).alias("amount"))


def deposit_retention(matches: DataFrame, seconds: int = DAY) -> DataFrame:
    """Per deposit of ``matches``: (customer_id, deposit_id, kept): what is still there ``seconds`` after it came in."""
    soon = F.unix_micros("withdrawal_at") < F.unix_micros("deposit_at") + seconds * _US
    gone = F.coalesce(F.sum(F.when(soon, F.col("amount"))), F.lit(0))
    return matches.groupBy("customer_id", "deposit_id").agg((F.max("deposit_amount") - gone).cast("decimal(18,2)").alias("kept"))


def rapid_flows(txn: DataFrame, seconds: int = DAY, keep_below: float = 0.1) -> DataFrame:
    """The rows of :func:`match_flows` with ``kept``, what stays of the deposit within ``seconds``, and ``rapid``: less
    than the share ``keep_below`` of it, in withdrawals that name their deposits."""
    matches = cut_lineage(match_flows(txn))
    kept = deposit_retention(matches, seconds).select(F.struct("customer_id", "deposit_id").alias("__d"), "kept")
    joined = matches.join(kept, F.struct("customer_id", "deposit_id") == F.col("__d"))
    return joined.select(*matches.columns, "kept", (F.col("kept") < F.col("deposit_amount") * F.lit(keep_below)).alias("rapid"))
