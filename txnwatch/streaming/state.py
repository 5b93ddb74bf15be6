"""Rolling features per customer on a stream, kept in keyed state.

Each customer's state is the rows of the last 48 hours: a row may come 24 hours late, and its own window reaches
back another 24. So values equal the batch operator's for all rows that had arrived. A row that comes later than that
is still given out: with its features where the state holds its whole window, else with null features and ``late`` set.
Spark would filter rows behind the watermark, so the operator sees the event time as a plain column and only the
watermark comes from Spark. Rows without a time have no features, as in the batch operator. Very busy customers do not belong here: route them to the micro-batch
lane (:func:`txnwatch.streaming.jobs.enrich_hot_lane`), where time buckets spread one customer over tasks.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_US = 1_000_000
KEEP_SECONDS, IDLE_MS = 2 * 86_400, 48 * 3_600_000
_NEVER = -(2**62)
STATE = T.StructType([
    T.StructField("t", T.LongType()), T.StructField("cents", T.LongType()), T.StructField("party", T.StringType())])


def trailing(t: np.ndarray, cents: np.ndarray, party: np.ndarray, at: np.ndarray, seconds: int) -> dict[str, np.ndarray]:
    """Count, sum, maximum and distinct parties of the rows in ``(x - seconds, x]`` for every ``x`` of ``at``.

    ``t`` is ascending. One walk: rows enter and leave once, the maximum stands at the head of a falling queue.
    """
    order = np.argsort(at, kind="stable")
    lo = np.searchsorted(t, at - seconds * _US, side="right")
    hi = np.searchsorted(t, at, side="right")
    total = np.concatenate([[0], np.cumsum(cents)])
    top, parties = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    falling: deque[int] = deque()
    inside: Counter = Counter()
    begin = end = 0
    for i in order.tolist():
        while end < hi[i]:
            while falling and cents[falling[-1]] <= cents[end]:
                falling.pop()
            falling.append(end)
            if party[end] is not None:
                inside[party[end]] += 1
            end += 1
        while begin < lo[i]:
            if party[begin] is not None:
                inside[party[begin]] -= 1
                if not inside[party[begin]]:
                    del inside[party[begin]]
            begin += 1
        while falling and falling[0] < begin:
            falling.popleft()
        top[i] = cents[falling[0]] if falling else 0
        parties[i] = len(inside)
    return {"txn_count": hi - lo, "total_amount": total[hi] - total[lo], "max_amount": top, "unique_counterparties": parties}


class RollingState(StatefulProcessor):
    """One enriched row per input row; idle customers are dropped by an event-time timer."""

    windows = {"1h": 3600, "24h": 86_400}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", STATE)
        #: Rows up to this time may be gone.
        self.horizon = handle.getValueState("horizon", T.StructType([T.StructField("t", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows), ignore_index=True)
        if fresh.empty:
            return
        if self.horizon.exists():
            gone = self.horizon.get()[0]
        else:  # a new customer, or one whose idle state was dropped: nobody knows which
            watermark = timerValues.getCurrentWatermarkInMs() * 1000
            gone = watermark - KEEP_SECONDS * _US if watermark > 0 else _NEVER
        held = list(self.rows.get()) if self.rows.exists() else []
        own = pd.DataFrame({"t": fresh["t"], "cents": fresh["cents"], "party": fresh["counterparty_id"]})
        past = pd.DataFrame(held, columns=["t", "cents", "party"])
        buffer = (pd.concat([past, own]) if len(past) else own).sort_values("t", kind="stable")
        t, cents = buffer["t"].to_numpy(np.int64), buffer["cents"].to_numpy(np.int64)
        party = buffer["party"].astype(object).where(buffer["party"].notna(), None).to_numpy()
        out = fresh.drop(columns=["t", "cents"])
        at = fresh["t"].to_numpy(np.int64)
        late = at - max(self.windows.values()) * _US < gone
        for label, seconds in self.windows.items():
            for name, values in trailing(t, cents, party, at, seconds).items():
                out[f"{name}_{label}"] = pd.array(values, dtype="Int64")
                out.loc[late, f"{name}_{label}"] = pd.NA
        out["late"] = late
        ends = t[-1] - KEEP_SECONDS * _US
        first = int(np.argmax(t > ends))
        self.rows.put([(int(a), int(b), c) for a, b, c in zip(t[first:], cents[first:], party[first:])])
        self.horizon.update((int(max(gone, ends)),))
        wanted = int(t[-1]) // 1000 + IDLE_MS
        timers = [old[0] if isinstance(old, tuple) else old for old in self.handle.listTimers()]
        for old in timers:
            if old != wanted:
                self.handle.deleteTimer(old)
        if wanted not in timers:
            self.handle.registerTimer(wanted)
        yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.rows.clear()
        self.horizon.clear()
        return iter([])

    def close(self) -> None:
        pass


def rolling_stream(txn: DataFrame, watermark: str = "24 hours") -> DataFrame:
    """The streaming twin of ``rolling_transactions``: every column of the rows, their rolling features, and ``late``.

    Rows without an event time or a customer go around the state and have null features. No row is left out: one that
    comes too late for its window to be known has null features and ``late`` true.
    """
    from pyspark.sql import functions as F

    timed = txn.withColumn("ts", F.col("ts").cast("timestamp"))
    known = F.col("ts").isNotNull() & F.col("customer_id").isNotNull()
    wide = timed.filter(known).withColumns({
        "t": F.unix_micros("ts"), "cents": F.coalesce((F.col("amount_usd") * 100).cast("bigint"), F.lit(0).cast("bigint"))})
    measures = [f"{m}_{w}" for w in RollingState.windows for m in ("txn_count", "total_amount", "max_amount", "unique_counterparties")]
    fields = [*(T.StructField(f.name, f.dataType) for f in timed.schema), *(T.StructField(m, T.LongType()) for m in measures), T.StructField("late", T.BooleanType())]
    # a column that is worked out carries no watermark, so Spark filters nothing by it
    plain = [F.timestamp_micros("t").alias("ts") if c == "ts" else F.col(c) for c in wide.columns]
    rolled = wide.withWatermark("ts", watermark).select(*plain).groupBy("customer_id").transformWithStateInPandas(
        RollingState(), T.StructType(fields), "Append", "EventTime")
    money = [m for m in measures if "amount" in m]
    rolled = rolled.withColumns({c: (F.col(c) / 100).cast("decimal(18,2)") for c in money})
    rest = timed.filter(~known).select("*", *[F.lit(None).cast(rolled.schema[m].dataType).alias(m) for m in measures], F.lit(False).alias("late"))
    return rolled.unionByName(rest)
