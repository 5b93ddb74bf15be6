"""Anchored deduplication on a stream: the twin of ``dedup_anchored``.

A group starts at its first alert and takes those of at most so many whole minutes later, so its members are known only
when no earlier alert can come any more. Per (customer, rule) the state holds the open group, into which everything
before the watermark has been merged, and the alerts not yet before the watermark: one of them that comes late may
still stand before the others and become the anchor. A timer closes the group when the watermark has passed its end.

Keys are dealt to buckets, and the state is kept, read and written by bucket: every call to the state and every frame
costs as much as hundreds of alerts do, and most keys have few. A batch writes the buckets anew that it touches.

An alert that comes behind the watermark is not dropped: it is given out as a group of its own, with ``late`` set, for
its place in the groups has been decided. Spark would filter such rows; so the operator sees the event time as a plain
number, and only the watermark itself comes from Spark.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from txnwatch.functions.columns import severity_name, severity_rank
from txnwatch.operators.dedup import KEYS

_MINUTE = 60_000_000
#: What is kept of an alert, in the order in which the first of equal times is found.
FIELDS = ["t", "alert_id", "txn_id", "alert_type", "rule_desc", "severity_rank", "score"]
#: Into how many buckets the keys are dealt. A checkpoint goes on with the number it began with only.
BUCKETS = 1024
#: Alerts and groups in one value of the state.
ROWS_AT_ONCE = 10_000
_ALERT = T.StructType([T.StructField("t", T.LongType()), *(T.StructField(c, T.StringType()) for c in FIELDS[1:5]),
                       T.StructField("severity_rank", T.IntegerType()), T.StructField("score", T.DoubleType())])
_HELD = T.StructType([T.StructField("part", T.BinaryType())])
_OUT = T.StructType([*(T.StructField(k, T.StringType()) for k in KEYS), *_ALERT.fields, T.StructField("alert_count", T.LongType()), T.StructField("late", T.BooleanType())])


def _highest(a, b):
    return b if a is None else a if b is None else max(a, b)


def _order(row: tuple) -> tuple:
    """By time, then id, null ids first as in Spark's order of structs."""
    return row[0], row[1] is not None, row[1] or ""


def settle(group: tuple | None, pending: list[tuple], before: int, span: int) -> tuple[list[tuple], tuple | None, list[tuple]]:
    """Merges the pending alerts before the time ``before`` in order: (closed groups, open group, still pending).

    A group is an alert's fields and the number of its alerts: those of the first one, with the worst severity and the
    highest score of all.
    """
    pending, closed = sorted(pending, key=_order), []
    rest = [r for r in pending if r[0] >= before]
    for row in pending[:len(pending) - len(rest)]:
        if group is not None and row[0] < group[0] + span:
            group = (*group[:5], _highest(group[5], row[5]), _highest(group[6], row[6]), group[7] + 1)
        else:
            closed += [group] if group is not None else []
            group = (*row, 1)
    if group is not None and before >= group[0] + span:
        return [*closed, group], None, rest
    return closed, group, rest


def _tuples(part: pd.DataFrame) -> Iterator[tuple[tuple, tuple]]:
    """((customer, rule), alert) per row, nulls as None."""
    def values(name: str, as_int: bool = False) -> list:
        return [None if x is None or x != x else int(x) if as_int else x for x in part[name].tolist()]
    return zip(zip(*map(values, KEYS), strict=True), zip(*(values(c, c in ("t", "severity_rank")) for c in FIELDS), strict=True), strict=True)


class AnchoredState(StatefulProcessor):
    def __init__(self, span: int) -> None:
        self.span = span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # lists of (key, open group, pending alerts), as bytes
        self.held = handle.getListState("held", _HELD)

    def _advance(self, fresh: dict[tuple, list[tuple]], watermark_ms: int) -> pd.DataFrame:
        before, span = watermark_ms * 1000, self.span
        held = self._read()
        rows, now, begins = [], [], []
        known = {key for key, _, _ in held}
        for key, group, pending in [*held, *[(key, None, []) for key in fresh if key not in known]]:
            more = fresh.get(key, ())
            rows += [(*key, *r, 1, True) for r in more if r[0] < before]
            closed, group, rest = settle(group, pending + [r for r in more if r[0] >= before], before, span)
            rows += [(*key, *g, False) for g in closed]
            if group is not None or rest:
                now.append((key, group, rest))
                begins.append((group or rest[0])[0])
        if now != held:
            if now:
                self.held.put([(pickle.dumps(part, pickle.HIGHEST_PROTOCOL),) for part in self._parts(now)])
            else:
                self.held.clear()
        # the first time at which something can close: the end of an open group, or of the one the next alert of a key starts
        wanted = (min(begins) + span) // 1000 + 1 if begins else None
        timers = [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]
        for old in timers:
            if old != wanted:
                self.handle.deleteTimer(old)
        if wanted is not None and wanted not in timers:
            self.handle.registerTimer(wanted)
        return pd.DataFrame(rows, columns=_OUT.names)

    def _read(self) -> list[tuple]:
        held: list[tuple] = []
        for (part,) in self.held.get():
            for key, group, pending in pickle.loads(part):
                if held and held[-1][0] == key:  # a key with many alerts goes on in the next value
                    held[-1][2].extend(pending)
                else:
                    held.append((key, group, pending))
        return held

    @staticmethod
    def _parts(entries: list[tuple]) -> Iterator[list[tuple]]:
        """The entries in lists of about so many rows as one value of the state holds; those of a key may be cut."""
        part, rows = [], 0
        for key, group, pending in entries:
            for at in range(0, max(len(pending), 1), ROWS_AT_ONCE):
                piece = pending[at:at + ROWS_AT_ONCE]
                part.append((key, None if at else group, piece))
                rows += 1 + len(piece)
                if rows >= ROWS_AT_ONCE:
                    yield part
                    part, rows = [], 0
        if part:
            yield part

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[tuple, list[tuple]] = {}
        for part in rows:
            for name, alert in _tuples(part):
                fresh.setdefault(name, []).append(alert)
        if fresh:
            yield self._advance(fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance({}, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def dedup_anchored_stream(alerts: DataFrame, minutes: int = 30, watermark: str = "30 minutes", buckets: int = BUCKETS) -> DataFrame:
    """The groups of ``dedup_anchored`` as the watermark passes their ends, and late alerts each for itself (``late``).

    The same for any split into batches and any order within the watermark. Alerts without a creation time take no
    part, as in the batch operator; null customers and rules are keys like others. Needs the RocksDB state store.
    """
    timed = alerts.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", watermark)
    told = "rule_desc" in alerts.columns
    rows = timed.filter(F.col("created_at").isNotNull()).select(
        *[F.col(k).cast("string").alias(k) for k in KEYS], F.unix_micros("created_at").alias("t"), "alert_id", "txn_id", "alert_type",
        (F.col("rule_desc") if told else F.lit(None).cast("string")).alias("rule_desc"), severity_rank(F.col("severity")).cast("int").alias("severity_rank"),
        (F.col("score") if told else F.lit(None)).cast("double").alias("score"))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*KEYS), F.lit(buckets)))
    found = dealt.groupBy("bucket").transformWithStateInPandas(AnchoredState((minutes + 1) * _MINUTE), _OUT, "Append", "EventTime")
    score = [F.col("score").cast(alerts.schema["score"].dataType).alias("score")] if told else []
    return found.select(
        *KEYS, "alert_id", "txn_id", "alert_type", *(["rule_desc"] if told else []), severity_name(F.col("severity_rank")).alias("severity"), *score,
        F.lit("NEW").alias("status"), F.timestamp_micros("t").alias("created_at"), "alert_count", "late")
