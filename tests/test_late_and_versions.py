"""Late rows, anchored groups on a stream, tables that batches change, flows and baselines against brute force, rules of their time."""

from __future__ import annotations

import datetime as dt
import random
from collections import Counter, defaultdict, deque
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from txnwatch.operators import dedup, flows, rolling, rules, versions
from txnwatch.sources import versioned
from txnwatch.streaming import anchored, jobs

START = dt.datetime(2024, 1, 1)
ALERTS = "alert_id string, txn_id string, customer_id string, rule_id string, alert_type string, severity string, rule_desc string, score double, created_at timestamp"
MINUTE = 60_000_000


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def minutes(n: float) -> dt.datetime:
    return START + dt.timedelta(minutes=n)


def alert(i: int, key: str | None, at: float, severity: str = "LOW", score: float | None = 0.5) -> tuple:
    return f"A{i:04d}", f"T{i}", key, "R", "SAR", severity, f"seen {i}", score, minutes(at)


def as_files(spark, parts: list[list[tuple]], schema: str, path: str):
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    known = spark.read.parquet(path).schema
    return spark.readStream.schema(known).option("maxFilesPerTrigger", 1).parquet(path), spark.read.parquet(path)


# --- anchored groups ---


def test_settle_equals_one_fold_for_any_split():
    rng, span = random.Random(1), 31 * MINUTE
    for _ in range(200):
        rows = [(rng.randrange(0, 400) * MINUTE // 2, f"A{i}", "T", "SAR", "d", rng.randrange(4), rng.choice([None, 0.1, 0.9])) for i in range(rng.randint(1, 30))]
        expected, rest = [], sorted(rows, key=lambda r: r[:2])
        while rest:
            own = [r for r in rest if r[0] < rest[0][0] + span]
            expected.append((rest[0][1], max(r[5] for r in own), max((r[6] for r in own if r[6] is not None), default=None), len(own)))
            rest = rest[len(own):]
        # arrival in an order that the watermark allows: each row at most 60 minutes behind the newest before it
        order = sorted(rows, key=lambda r: r[0] + rng.randrange(0, 60) * MINUTE)
        group, pending, closed, before, newest = None, [], [], 0, 0
        while order:
            n = rng.randint(1, 5)
            batch, order = order[:n], order[n:]
            assert all(r[0] >= before for r in batch)
            found, group, pending = anchored.settle(group, pending + batch, before, span)
            closed += found
            newest = max(newest, *(r[0] for r in batch))
            before = max(before, newest - 60 * MINUTE)
        closed += anchored.settle(group, pending, 10**15, span)[0]
        assert [(g[1], g[5], g[6], g[7]) for g in closed] == expected


def test_anchored_stream_equals_batch(spark, tmp_path, rocks):
    rng = random.Random(2)
    rows = [alert(i, rng.choice(["hot", "hot", "hot", "b", "c", None]), rng.randrange(0, 3000) / 5, rng.choice(["LOW", "HIGH", "CRITICAL", "odd"]), rng.choice([None, 0.2, 0.7]))
            for i in range(400)]
    rows.sort(key=lambda r: r[8] + dt.timedelta(minutes=rng.randrange(0, 29)))
    rows += [(*alert(900, "b", 0)[:8], None)]
    parts = [rows[i::1][:0] or rows[i:i + 61] for i in range(0, len(rows), 61)] + [[alert(999, "end", 5000)], [alert(998, "end", 9000)]]
    stream, batch = as_files(spark, parts, ALERTS, str(tmp_path / "in"))
    jobs.anchored_job(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert found.filter("late").count() == 0 and found.select("batch_id").distinct().count() > 3
    want = dedup.dedup_anchored(batch).filter("alert_id <> 'A0998'")
    assert Counter(map(str, found.select(*want.columns).collect())) == Counter(map(str, want.collect()))


def test_a_late_alert_is_given_out_for_itself(spark, tmp_path, rocks):
    parts = [[alert(1, "a", 100), alert(2, "a", 110)], [alert(3, "a", 200)], [alert(4, "a", 105), alert(5, "new", 20, "HIGH"), alert(6, "a", 190)], [alert(7, "z", 500)], [alert(8, "z", 900)]]
    stream, _ = as_files(spark, parts, ALERTS, str(tmp_path / "in"))
    jobs.anchored_job(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    found = {(r.alert_id, r.alert_count, r.late) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # the alert of minute 190 comes behind that of minute 200 but before the watermark: it is the anchor
    assert found == {("A0001", 2, False), ("A0004", 1, True), ("A0005", 1, True), ("A0006", 2, False), ("A0007", 1, False)}


# --- rows later than the watermark ---

TXN = "txn_id string, customer_id string, counterparty_id string, ts timestamp, amount_usd decimal(18,2)"


def test_no_row_leaves_the_rolling_stream(spark, tmp_path, rocks):
    def txn(i, customer, hour, amount="10.00"):
        return f"T{i}", customer, f"P{i % 3}", START + dt.timedelta(hours=hour), Decimal(amount)
    parts = [[txn(1, "a", 100), txn(2, "a", 90), txn(3, "b", 100)], [txn(4, "a", 101)],
             [txn(5, "a", 70, "9000.00"), txn(6, "a", 80), txn(7, "new", 60), txn(13, "newer", 40), txn(8, "a", 10), txn(9, None, 5)], [txn(10, "c", 300)], [txn(11, "a", 299), txn(12, "a", 200)]]
    stream, _ = as_files(spark, parts, TXN, str(tmp_path / "in"))
    jobs.enrich_job(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    found = {r.txn_id: (r.late, r.txn_count_24h) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    # all of the third batch come behind the watermark of hour 77. The state of "a" reaches back to hour 53: enough for the window of 6,
    # not for those of 5 and 8. Customers without a state may have had one with rows up to hour 29: enough for 7, not for 13
    assert found == {"T1": (False, 2), "T2": (False, 1), "T3": (False, 1), "T4": (False, 3), "T5": (True, None), "T6": (False, 2), "T7": (False, 1), "T8": (True, None),
                     "T9": (False, None), "T10": (False, 1), "T11": (False, 1), "T12": (False, 1), "T13": (True, None)}


def test_state_is_dropped_when_idle(spark, tmp_path, rocks):
    def txn(i, customer, hour):
        return f"T{i}", customer, "P", START + dt.timedelta(hours=hour), Decimal("1.00")
    parts = [[txn(1, "a", 0)], [txn(2, "b", 200)], [txn(3, "b", 201)], [txn(4, "a", 201)], [txn(5, "a", 178)]]
    stream, _ = as_files(spark, parts, TXN, str(tmp_path / "in"))
    jobs.enrich_job(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    found = {r.txn_id: (r.late, r.txn_count_24h) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found["T4"] == (False, 1) and found["T5"] == (False, 1)
    held = spark.read.format("statestore").option("stateVarName", "rows").load(str(tmp_path / "cp"))
    assert {r[0] for r in held.select("key.customer_id").collect()} == {"a", "b"}
    times = {r[0] for r in held.select("list_element.t" if "list_element" in held.columns else "value.t").collect()}
    assert int((START - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000 not in times


# --- tables that batches change ---


def test_an_hour_of_updates_is_not_cut_by_every_task(spark, tmp_path):
    rows = [alert(i, f"c{i % 50}", 60 * (i % 40)) for i in range(2000)]
    stream, batch = as_files(spark, [rows], ALERTS, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    jobs.aggregate_updates_job(stream, out, str(tmp_path / "cp"), once=True).awaitTermination()
    hours, tasks = len(list((tmp_path / "out" / "data").glob("*/slot=*"))), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert hours == 40 and len(list((tmp_path / "out" / "data").rglob("*.parquet"))) <= hours + tasks
    want = dedup.dedup_tumbling(batch)
    found = versioned.read_merged(spark, out, want.schema)
    assert Counter(map(str, found.collect())) == Counter(map(str, want.select(*found.columns).collect()))


def test_updates_are_readable_after_every_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [alert(i, rng.choice(["a", "b"]), rng.randrange(0, 200)) for i in range(120)]
    rows.sort(key=lambda r: r[8] + dt.timedelta(minutes=rng.randrange(0, 29)))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = dedup.dedup_tumbling(spark.createDataFrame([], ALERTS)).schema
    assert versioned.read_merged(spark, out, schema).count() == 0
    for at in range(0, 120, 40):
        stream, batch = as_files(spark, [rows[at:at + 40]], ALERTS, path)
        jobs.aggregate_updates_job(stream, out, str(tmp_path / "cp"), once=True).awaitTermination()
        found, want = versioned.read_merged(spark, out, schema), dedup.dedup_tumbling(batch)
        assert Counter(map(str, found.collect())) == Counter(map(str, want.select(*found.columns).collect()))
    kept = {p.name for p in (tmp_path / "out" / "manifest").iterdir()}
    assert len(kept) == 2


def test_a_repeated_batch_replaces_what_it_wrote(spark, tmp_path):
    path = str(tmp_path / "t")

    def put(rows, batch_id):
        frame = spark.createDataFrame(rows, "k string, day string, n long")
        versioned.merge_batch(frame, path, ["k"], F.col("day"), batch_id)

    def held():
        return {(r.k, r.n) for r in versioned.read_merged(spark, path, spark.createDataFrame([], "k string, day string, n long").schema).collect()}
    put([("a", "d1", 1), ("b", "d/2", 1), (None, "d1", 1)], 0)
    put([("a", "d1", 2), ("c", "d3", 2)], 1)
    assert held() == {("a", 2), ("b", 1), ("c", 2), (None, 1)}
    put([(None, "d1", 3)], 1)
    assert held() == {("a", 1), ("b", 1), (None, 3)}
    for n in range(2, 6):
        put([("b", "d/2", n)], n)
        assert held() == {("a", 1), ("b", n), (None, 3)}
    stored = [p for p in (tmp_path / "t" / "data").glob("version=*/slot=*")]
    assert len(stored) <= 4, stored


def test_archive_of_a_repeated_batch(spark, tmp_path):
    path = str(tmp_path / "archive")

    def put(rows, batch_id):
        versioned.archive_batch(spark.createDataFrame(rows, "txn_id string, txn_type string, ts timestamp"), path, batch_id)

    def held(where="true"):
        found = spark.read.schema("txn_id string, ts timestamp, dt string, txn_type string, batch int").parquet(path).filter(where)
        return sorted((r.txn_id, r.dt, r.txn_type, r.batch) for r in found.collect())
    day = [START + dt.timedelta(days=i) for i in range(4)]
    put([("a", "CARD", day[0]), ("b", "CARD", day[1]), ("c", None, None), ("d", "W/T", day[1])], 0)
    put([("e", "CARD", day[0])], 1)
    assert held() == [("a", "2024-01-01", "CARD", 0), ("b", "2024-01-02", "CARD", 0), ("c", "none", "UNKNOWN", 0), ("d", "2024-01-02", "W/T", 0), ("e", "2024-01-01", "CARD", 1)]
    put([("a", "CARD", day[0]), ("f", "FOREX", day[3])], 0)
    assert held() == [("a", "2024-01-01", "CARD", 0), ("e", "2024-01-01", "CARD", 1), ("f", "2024-01-04", "FOREX", 0)]
    put([], 0)
    assert held() == [("e", "2024-01-01", "CARD", 1)] and held("dt = '2024-01-02'") == []
    plan = spark.read.schema("txn_id string, dt string, txn_type string").parquet(path).filter("dt = '2024-01-01'")
    assert "PartitionFilters: [isnotnull(dt" in plan._jdf.queryExecution().toString()


# --- flows ---


def plain_flows(rows):
    """A queue of deposits per customer."""
    found, queues = [], defaultdict(deque)
    for txn_id, customer, t, direction, amount in sorted((r for r in rows if r[2] is not None and r[4] is not None and r[4] > 0 and r[3] in ("INBOUND", "OUTBOUND")),
                                                         key=lambda r: (r[2], r[3] == "OUTBOUND", r[0])):
        queue = queues[customer]
        if direction == "INBOUND":
            queue.append([txn_id, t, amount, amount])
            continue
        while amount > 0 and queue:
            part = min(amount, queue[0][3])
            found.append((customer, queue[0][0], queue[0][1], queue[0][2], txn_id, t, part))
            amount -= part
            queue[0][3] -= part
            if not queue[0][3]:
                queue.popleft()
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_flows_equal_a_queue(spark, seed):
    rng = random.Random(seed)
    rows = [(f"T{i:04d}", rng.choice(["hot"] * 6 + ["b", "c", None]), None if i % 90 == 7 else minutes(rng.randrange(0, 4000)),
             rng.choice(["INBOUND", "OUTBOUND", "OUTBOUND" if seed == 2 else "INBOUND", "SIDEWAYS", None][:3 if i % 20 else 5]),
             rng.choice([Decimal("1.00"), Decimal("0.01"), Decimal(rng.randrange(1, 99999)) / 100, Decimal("-3.00") if i % 50 == 0 else Decimal("7.50"), None if i % 70 == 0 else Decimal("20.00")]))
            for i in range(600)]
    frame = spark.createDataFrame(rows, "txn_id string, customer_id string, ts timestamp, direction string, amount_usd decimal(18,2)")
    found = flows.rapid_flows(frame)
    expected = plain_flows(rows)
    soon = Counter()
    for m in expected:
        if m[5] < m[2] + dt.timedelta(days=1):
            soon[m[1]] += m[6]
    want = Counter((m[0], m[1], m[3], m[4], m[6], m[3] - soon[m[1]], (m[3] - soon[m[1]]) < Decimal("0.1") * m[3]) for m in expected)
    assert Counter(tuple(r) for r in found.select("customer_id", "deposit_id", "deposit_amount", "withdrawal_id", "amount", "kept", "rapid").collect()) == want
    assert flows.rapid_flows(frame.limit(0)).count() == 0


# --- baseline ---


def test_baseline_equals_brute_force(spark):
    rng = random.Random(6)
    hours = [rng.choice([rng.randrange(0, 30), rng.randrange(0, 1600)]) for _ in range(300)]
    rows = [(f"T{i}", rng.choice(["a", "a", "b", None]), START + dt.timedelta(hours=h, minutes=rng.randrange(60))) for i, h in enumerate(hours)]
    rows += [("new1", "new", minutes(5)), *((f"burst{i}", "burst", minutes(i)) for i in range(6)), ("untimed", "a", None)]
    frame = spark.createDataFrame(rows, "txn_id string, customer_id string, ts timestamp")
    counted = rolling.rolling_features(frame, "customer_id", "ts", {"1h": rolling.HOUR})
    found = {r.txn_id: r.mean_hourly for r in rules.frequency_anomaly(counted, rules.hourly_baseline(frame)).collect()}
    want = {}
    for txn_id, customer, ts in rows:
        if ts is None:
            continue
        own = [r[2] for r in rows if r[1] == customer and r[2] is not None]
        hour = [int((t - START).total_seconds() // 3600) for t in own]
        at = int((ts - START).total_seconds() // 3600)
        past = sum(at - 721 <= h <= at - 2 for h in hour)
        mean = past / min(720, at - 1 - min(hour)) if past else None
        if sum(ts - dt.timedelta(hours=1) < t <= ts for t in own) >= 5 * (1.0 if mean is None else mean):
            want[txn_id] = mean
    assert found.keys() == want.keys() and all((found[k] is None) == (want[k] is None) and (want[k] is None or abs(found[k] - want[k]) < 1e-12) for k in want)
    assert want["burst4"] is None and "burst3" not in want and "new1" not in want


# --- rules of their time ---


def test_validity_equals_a_look_at_every_day():
    rng = random.Random(9)
    for _ in range(300):
        events = [{"version_id": f"V{i}", "event": "CREATE", "at": rng.randrange(30), "effective_from": rng.randrange(30)} for i in range(rng.randint(0, 6))]
        events += [{"version_id": f"V{rng.randrange(7)}", "event": "DEPRECATE", "at": rng.randrange(30), "effective_from": None} for _ in range(rng.randint(0, 4))]
        spans = versions.validity(events)
        gone = defaultdict(lambda: 99)
        for e in events:
            if e["event"] == "DEPRECATE":
                gone[e["version_id"]] = min(gone[e["version_id"]], e["at"])
        for day in range(32):
            live = [(e["effective_from"], e["version_id"]) for e in events if e["event"] == "CREATE" and e["effective_from"] <= day < gone[e["version_id"]]]
            assert [v for v, a, b in spans if a <= day and (b is None or day < b)] == ([max(live)[1]] if live else [])


def test_rows_meet_the_pack_of_their_time(spark):
    def pack(limit):
        return rules.collect_rules(rules.rule_frame(spark, [{"rule_id": "R", "name": "R", "type": "SAR", "severity": "LOW", "window": None, "logic": None,
                                                              "conditions": [rules.condition("amount", "GTE", limit)], "actions": [{"type": "ALERT", "template": "${amount} ${meta.device}", "priority": None}]}]))
    rows = [(f"T{i}", "c", tag, i * 10, {"device": "d"} if i % 2 else None, START + dt.timedelta(days=i) if i != 5 else None) for i, tag in enumerate(["MAIN"] * 7 + ["BYPASS_CTR"])]
    frame = spark.createDataFrame(rows, "txn_id string, customer_id string, route_tag string, amount int, meta map<string,string>, ts timestamp").withColumn("amount_usd", F.col("amount"))
    found = rules.alerts_of_their_time(frame, [("V1", "2024-01-02", "2024-01-04", pack(0)), ("V2", "2024-01-05", None, pack(60))]).collect()
    assert {(r.txn_id, r.version_id, r.rule_desc) for r in found} == {("T1", "V1", "10 d"), ("T2", "V1", "20 ${meta.device}"), ("T6", "V2", "60 ${meta.device}"),
                                                                     ("T7", None, "Auto-CTR: Large transaction 70 bypass lane")}


def test_anchored_state_is_called_by_bucket(monkeypatch):
    """As many calls to the state for 500 keys as for one, however its values are cut."""
    from types import SimpleNamespace

    import pandas as pd

    from txnwatch.streaming import anchored

    class Handle:
        calls, kept, timers = 0, [], []

        def getListState(self, name, schema):
            return self

        def get(self):
            self.calls += 1
            return iter(self.kept)

        def put(self, values):
            self.calls += 1
            self.kept = values

        def clear(self):
            self.put([])

        def listTimers(self):
            self.calls += 1
            return iter(self.timers)

        def deleteTimer(self, at):
            self.calls += 1
            self.timers = [t for t in self.timers if t != at]

        def registerTimer(self, at):
            self.calls += 1
            self.timers = [*self.timers, at]

    monkeypatch.setattr(anchored, "ROWS_AT_ONCE", 2)

    def at(watermark):
        return SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark)
    handle, state, minute = Handle(), anchored.AnchoredState(31 * 60_000_000), 60_000_000
    state.init(handle)
    rows = [(f"C{i % 500}" if i % 500 else None, "R", (100 + i // 500 * 20) * minute, f"A{i:04d}", None, "SAR", None, 1 if i % 3 else None, 0.5 if i % 2 else None) for i in range(1500)]
    frame = pd.DataFrame(rows, columns=[*anchored.KEYS, *anchored.FIELDS])
    assert sum(map(len, state.handleInputRows((7,), iter([frame[:700], frame[700:]]), at(0)))) == 0
    assert handle.calls <= 4 and len(handle.timers) == 1
    (closed,) = state.handleExpiredTimer((7,), at(131 * 60_000), None)
    # the alerts of minutes 100 and 120 are a group that is over; that of minute 140 waits
    assert len(closed) == 500 and set(closed["alert_count"]) == {2} and set(closed["t"]) == {100 * minute} and handle.timers == [171 * 60_000 + 1]
    (closed,) = state.handleExpiredTimer((7,), at(200 * 60_000), None)
    assert len(closed) == 500 and set(closed["alert_count"]) == {1} and handle.kept == [] and handle.timers == []
