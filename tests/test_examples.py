"""Literal examples: validation, windows, rules, screening, deduplication, workflow."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from txnwatch.functions.columns import normalize_name, severity_name, severity_rank, xml_text
from txnwatch.operators import alerts as al
from txnwatch.operators import cases, dedup, kyc, packs, reconcile, reports, risk, rolling, rules, sanctions, versions
from txnwatch.operators import normalize as norm
from txnwatch.schemas import TXN_JSON
from txnwatch.sources.lists import read_rules, read_sanctions, rules_of_version
from txnwatch.sources.sinks import archive, overwrite_partitions
from txnwatch.sources.streams import parse_json
from txnwatch.sources.tables import latest_before, read_dated, read_sample_transactions

T0 = dt.datetime(2024, 5, 9, 9, 15)


def _payment(n: int, kind: str, amount: float, to: str, channel: str, country: str) -> dict:
    at = int(T0.replace(tzinfo=dt.UTC).timestamp() * 1000) + 60_000 * n
    return dict(txnId=f"PAY-{n}", txnType=kind, timestamp=at, amount=amount, currency="USD", amountUsd=amount, direction="OUTBOUND", customerId="PAYER",
                counterpartyId=to, channel=channel, countrySrc="US", countryDst=country, metadata={}, rawPayload="")


FEED = [_payment(1, "TRANSFER", 4200.0, "SHOP", "ONLINE", "DE"), _payment(2, "CARD", 12300.0, "HOTEL", "ATM", "US"),
        _payment(3, "TRANSFER", 8100.0, "TRADER", "ONLINE", "IR")]


@pytest.fixture
def feed(spark, tmp_path):
    path = tmp_path / "feed.json"
    path.write_text(json.dumps(FEED, indent=2))
    return read_sample_transactions(spark, str(path))


def test_feed_parses_routes_and_alerts(spark, feed):
    rows = {r.txn_id: r for r in norm.normalize(norm.valid_rows(feed)).collect()}
    assert rows["PAY-2"].route_tag == "BYPASS_CTR" and rows["PAY-1"].route_tag == "MAIN"
    assert rows["PAY-1"].topic == "txn.bank" and rows["PAY-2"].topic == "txn.card"
    enriched = rolling.rolling_transactions(norm.normalize(feed)).withColumn("risk_level", F.lit("UNKNOWN"))
    found = rules.all_alerts(enriched, rules.collect_rules(rules.rule_frame(spark, packs.SHIPPED))).collect()
    assert {(a.txn_id, a.rule_id) for a in found} == {("PAY-2", "CTR-001"), ("PAY-3", "SAR-003")}
    text = {a.rule_id: a.rule_desc for a in found}
    assert text["SAR-003"] == "SAR: High-risk country transfer $8100.00 to $IR"
    assert text["CTR-001"] == "Auto-CTR: Large transaction 12300.00 bypass lane"


def test_json_message_ignores_unknown_and_nulls_missing(spark):
    raw = spark.createDataFrame([('{"txnId":"PAY-1","txnType":"TRANSFER","amount":12.5,"other":1}',), ("not json",)], "value string")
    rows = norm.to_canonical(parse_json(raw, TXN_JSON)).collect()
    assert rows[0].txn_id == "PAY-1" and float(rows[0].amount) == 12.5 and rows[0].customer_id is None
    assert rows[1].txn_id is None and rows[1].raw_value == "not json"


def _txn(spark, **over):
    row = dict(txn_id="T", amount=100.0, customer_id="C", counterparty_id="P", currency="usd", ts=T0) | over
    return spark.createDataFrame([row], "txn_id string, amount double, customer_id string, counterparty_id string, currency string, ts timestamp")


@pytest.mark.parametrize("over,ok", [({}, True), ({"txn_id": ""}, False), ({"amount": -100.0}, False), ({"currency": "INVALID"}, False),
                                     ({"amount": None}, False), ({"counterparty_id": None}, False)])
def test_strict_validator(spark, over, ok):
    df = _txn(spark, **over)
    assert norm.valid_rows(df, norm.strict_checks()).count() == int(ok)
    assert norm.rejected_rows(df, norm.strict_checks()).count() == int(not ok)


def test_reject_reasons(spark):
    bad = norm.rejected_rows(_txn(spark, txn_id="", amount=None)).first()
    assert bad.reject_reasons == ["txn_id", "amount"]


def test_window_stats(spark):
    amounts = [1000, 2000, 3000, 500, 1500]
    df = spark.createDataFrame([("a", float(x)) for x in amounts] + [("b", 15000.0), ("c", None)], "k string, amount double")
    got = {r.k: r for r in rolling.window_stats(df, ["k"], F.col("amount"), 10000).collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.txn_count, float(a.total_amount), float(a.max_amount), a.avg_amount, a.exceeds_threshold) == (5, 8000, 3000, 1600, False)
    assert b.exceeds_threshold and (c.txn_count, float(c.total_amount), c.exceeds_threshold) == (0, 0, False)


def _shipped(spark, df):
    return {r.rule_id for r in rules.evaluate_rules(df, rules.collect_rules(rules.rule_frame(spark, packs.SHIPPED))).collect()}


def test_shipped_rules_on_literals(spark):
    base = dict(txn_id="T", customer_id="C", ts=T0, amount_usd=100.0, channel="ONLINE", txn_type_normalized="TRANSFER", country_dst="US",
                txn_count_24h=1, max_amount_24h=100.0, total_amount_24h=100.0, txn_count_1h=1, unique_counterparties_24h=5, risk_level="LOW")
    schema = ("txn_id string, customer_id string, ts timestamp, amount_usd double, channel string, txn_type_normalized string, country_dst string,"
              "txn_count_24h long, max_amount_24h double, total_amount_24h double, txn_count_1h long, unique_counterparties_24h long, risk_level string")

    def hit(**over):
        return _shipped(spark, spark.createDataFrame([base | over], schema))

    assert hit(amount_usd=15000.0, channel="ATM") == {"CTR-001"}
    assert hit(amount_usd=8000.0, txn_count_24h=6, total_amount_24h=48000.0, max_amount_24h=8000.0) == {"SAR-001"}
    assert hit() == set()
    assert hit(txn_count_1h=20) == {"SAR-002"}
    assert hit(txn_count_24h=3, unique_counterparties_24h=2, risk_level="PROHIBITED") == {"SAR-004"}
    assert hit(amount_usd=5000.0, risk_level="HIGH") == {"RISK-001"}


@pytest.mark.parametrize("op,value,cell,want", [
    ("GTE", 10, "10", True), ("GT", 10, "10", False), ("LT", "b", "a", True), ("GTE", 9, "10", True), ("GTE", "9", "x", True),
    ("EQ", 10000, "10000.00", False), ("EQ", "A", "A", True), ("NEQ", "A", None, False), ("NOT_IN", ["A"], None, False), ("NOT_IN", "A", "A", True),
    ("IN", "A", "A", False), ("IN", ["A", "B"], "B", True), ("LIKE", "A", "A", False)])
def test_condition_semantics(spark, op, value, cell, want):
    df = spark.createDataFrame([(cell,)], "f string")
    test = rules.compile_condition(rules.condition("f", op, value), {"f"})
    assert df.select(test.alias("x")).first().x is want


def test_missing_field_and_empty_rule(spark):
    df = spark.createDataFrame([("T", "C", T0)], "txn_id string, customer_id string, ts timestamp")
    pack = [r for r in packs.ops_matrix() if r["rule_id"] in ("OP-MISSING", "OP-EMPTY")]
    found = rules.evaluate_rules(df, rules.collect_rules(rules.rule_frame(spark, pack))).collect()
    assert [(a.rule_id, a.rule_desc, round(a.score, 1)) for a in found] == [("OP-EMPTY", "Rule OP-EMPTY triggered", 0.3)]


def test_template_keeps_dollar_and_unknown_placeholders(spark):
    df = spark.createDataFrame([("T", None)], "txn_id string, x string")
    rule = {"rule_id": "R", "actions": [{"template": "a $${txn_id} ${x} ${y} {txn_id}"}]}
    assert df.select(rules.rule_message(rule, {"txn_id", "x"}).alias("m")).first().m == "a $T ${x} ${y} {txn_id}"


def test_rules_file_and_versions(spark, tmp_path):
    path = str(tmp_path / "rules")
    rules.rule_frame(spark, packs.SHIPPED).coalesce(1).write.json(path)
    assert [r.rule_id for r in rules.collect_rules(read_rules(spark, path))] == [r["rule_id"] for r in packs.SHIPPED]
    v = spark.createDataFrame([("V1", T0, json.dumps(packs.SHIPPED), "ACTIVE")], "version_id string, effective_from timestamp, rules_json string, status string")
    assert rules_of_version(v).count() == 6
    later = versions.create_versions(v, v.select(F.lit("V2").alias("version_id"), (F.col("effective_from") + F.expr("interval 1 day")).alias("effective_from"),
                                                 "rules_json"), F.lit(T0))
    assert [r.version_id for r in versions.active_versions(later).collect()] == ["V2", "V1"]
    assert versions.effective_version(later, F.lit(T0)).first().version_id == "V1"
    gone = versions.deprecate(later, spark.createDataFrame([("V2",)], "version_id string"))
    assert [r.version_id for r in versions.active_versions(gone).collect()] == ["V1"]


LISTED = ["AL QAIDA", "ISIS", "TALIBAN", "HEZBOLLAH", "HAMAS", "BANK SEPAH", "KOREA KWANGSON BANKING"]


def _listed(spark, names=LISTED):
    return spark.createDataFrame([(i, n, "L") for i, n in enumerate(names)], "pos bigint, name string, list_source string")


def test_screening_examples(spark):
    names = ["AL QAIDA", "al qaeda", "Taleban", "Microsoft Corporation", "", "IBM", "BANK SEPAH"]
    got = {r.name: r for r in sanctions.best_matches(spark.createDataFrame([(n,) for n in names], "name string"), _listed(spark)).collect()}
    assert set(got) == {"AL QAIDA", "al qaeda", "Taleban", "BANK SEPAH"}
    assert got["AL QAIDA"].similarity == 1.0 and got["al qaeda"].similarity == pytest.approx(0.95)
    assert got["Taleban"].matched_name == "TALIBAN" and got["Taleban"].similarity == pytest.approx(0.9333, abs=1e-4)


def test_name_normalization(spark):
    df = spark.createDataFrame([("  O'Neil-Smith\t& Co. !",)], "n string")
    assert df.select(normalize_name(F.col("n")).alias("x")).first().x == "oneilsmith co "


def test_sanctions_file(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text("# comment\n\nAL QAIDA\n  ISIS  \n# more\nTALIBAN\n")
    rows = read_sanctions(spark, str(path), "L").orderBy("pos").collect()
    assert [r.name for r in rows] == ["AL QAIDA", "ISIS", "TALIBAN"]
    with pytest.raises(Exception):
        read_sanctions(spark, str(tmp_path / "absent.csv"), "L").count()


def _alerts(spark, rows):
    return spark.createDataFrame(
        [(i, "T" + i, c, "R1", sev, "RULE", T0 + dt.timedelta(seconds=s)) for i, c, sev, s in rows],
        "alert_id string, txn_id string, customer_id string, rule_id string, severity string, alert_type string, created_at timestamp")


def test_anchored_dedup_examples(spark):
    out = dedup.dedup_anchored(_alerts(spark, [("A1", "C1", "MEDIUM", 0), ("A2", "C1", "CRITICAL", 10), ("A3", "C2", "LOW", 0)])).collect()
    assert {(r.alert_id, r.severity, r.alert_count) for r in out} == {("A1", "CRITICAL", 2), ("A3", "LOW", 1)}


def test_anchored_dedup_minutes_are_whole(spark):
    rows = [("A1", "C", "LOW", 0), ("A2", "C", "LOW", 30 * 60 + 59), ("A3", "C", "LOW", 31 * 60), ("A4", "C", "LOW", 61 * 60)]
    out = dedup.dedup_anchored(_alerts(spark, rows)).collect()
    assert {(r.alert_id, r.alert_count) for r in out} == {("A1", 2), ("A3", 2)}


def test_dedup_is_idempotent(spark):
    rows = [(f"A{i}", f"C{i % 3}", "HIGH", i * 400) for i in range(60)]
    once = dedup.dedup_anchored(_alerts(spark, rows))
    again = dedup.dedup_anchored(once)
    assert {(r.alert_id, r.created_at) for r in once.collect()} == {(r.alert_id, r.created_at) for r in again.collect()}


def test_severity_round_trip(spark):
    df = spark.createDataFrame([(s,) for s in ("LOW", "MEDIUM", "HIGH", "CRITICAL", "odd", None)], "s string")
    got = [(r.n, r.t) for r in df.select(severity_rank(F.col("s")).alias("n"), severity_name(severity_rank(F.col("s"))).alias("t")).collect()]
    assert got == [(0, "LOW"), (1, "MEDIUM"), (2, "HIGH"), (3, "CRITICAL"), (-1, "LOW"), (-1, "LOW")]


def test_risk_models(spark):
    row = spark.range(1).select(
        risk.factor_score(F.lit(0.7), F.lit(0.5), F.lit(0.3), F.lit(0.8)).alias("s"), risk.factor_score(*[F.lit(9.0)] * 4).alias("top"),
        *[risk.risk_level(F.lit(x)).alias(f"l{i}") for i, x in enumerate((0.9, 0.6, 0.3))]).first()
    assert row.s == pytest.approx(0.57) and row.top == 1.0 and (row.l0, row.l1, row.l2) == ("HIGH", "MEDIUM", "LOW")


def test_alert_actions(spark):
    alerts = _alerts(spark, [(f"A{i}", "C", "HIGH", 0) for i in range(4)]).withColumn("status", F.lit("NEW"))
    acts = [("A0", 1, "r", "CONFIRM", "n"), ("A1", 1, "r", "CLOSE", "n"), ("A2", 1, "r", "INVALID", "n"), ("A9", 1, "r", "CLOSE", "n"), ("A3", 1, None, "REPORT", None)]
    actions = spark.createDataFrame([(*a, T0) for a in acts], "alert_id string, seq long, reviewer_id string, action string, notes string, action_at timestamp")
    got = {r.alert_id: r.status for r in al.apply_actions(alerts, actions).collect()}
    assert got == {"A0": "ESCALATED", "A1": "CLOSED", "A2": "NEW", "A3": "REPORTED"}
    good, bad = al.split_actions(actions, alerts)
    assert good.count() == 3 and {(r.alert_id, r.reason) for r in bad.collect()} == {("A2", "UNKNOWN_ACTION"), ("A9", "UNKNOWN_ALERT")}


def test_sla_limits_are_strict(spark):
    rows = [("A", "C", "CRITICAL", 0), ("B", "C", "CRITICAL", -60), ("C", "C", "HIGH", -3600), ("D", "C", "MEDIUM", -500 * 60), ("E", "C", "LOW", -99999 * 60)]
    alerts = _alerts(spark, rows).withColumn("status", F.lit("NEW"))
    got = {r.alert_id: r for r in al.sla_actions(alerts, F.lit(T0 + dt.timedelta(minutes=30))).collect()}
    assert {k: v.sla_action for k, v in got.items()} == {"A": "REMIND", "B": "ESCALATE", "C": "REMIND", "D": "REMIND"}
    assert got["B"].sla_note == "Auto-escalated by SLA timer: CRITICAL alert overdue by 1 minutes"


def test_case_events(spark):
    ev = [("K", 1, "CREATE", None, None, None), ("K", 2, "ASSIGN", None, None, None), ("L", 1, "CREATE", None, None, None),
          ("L", 2, "UPDATE", None, None, "CONFIRMED_SAR"), ("M", 1, "CREATE", None, None, None), ("M", 2, "ESCALATE", None, "Complex pattern", None)]
    events = spark.createDataFrame(
        [(c, s, e, "CUST", "HIGH", "ann", st, n, r, None, T0 + dt.timedelta(hours=s)) for c, s, e, st, n, r in ev],
        "case_id string, seq long, event string, customer_id string, priority string, actor string, status string, notes string, resolution string,"
        "linked_alert_ids string, event_at timestamp")
    got = {r.case_id: r for r in cases.fold_cases(events).collect()}
    assert got["K"].status == "INVESTIGATING" and got["K"].assigned_to == "ann" and got["K"].closed_at is None
    assert got["L"].status == "CLOSED" and got["L"].closed_at is not None and got["L"].resolution == "CONFIRMED_SAR"
    assert got["M"].status == "ESCALATED" and "Complex pattern" in got["M"].notes


def test_kyc_schedule(spark):
    now = F.lit(T0)
    levels = spark.createDataFrame([("HIGH",), ("PROHIBITED",), ("MEDIUM",), ("LOW",), (None,)], "l string")
    got = [r.n for r in levels.select(kyc.next_review(F.col("l"), now).alias("n")).collect()]
    assert [(g.year, g.month) for g in got] == [(2024, 8), (2024, 8), (2025, 5), (2026, 5), (2025, 5)]
    dates = spark.createDataFrame([(None,), (T0 - dt.timedelta(days=1),), (T0 + dt.timedelta(days=29),), (T0 + dt.timedelta(days=31),)], "d timestamp")
    assert [r.s for r in dates.select(kyc.review_status(F.col("d"), now).alias("s")).collect()] == ["DUE", "OVERDUE", "DUE", "CURRENT"]


def test_xml_escape(spark):
    df = spark.createDataFrame([("<a b='c' d=\"e\">&",), (None,)], "x string")
    assert [r.y for r in df.select(xml_text(F.col("x")).alias("y")).collect()] == ["&lt;a b=&apos;c&apos; d=&quot;e&quot;&gt;&amp;", ""]


def test_summary_parts_join_to_one_document(spark):
    rows = spark.createDataFrame([(dt.date(2024, 1, 1), f"R{i:03}", "C", float(i), T0 + dt.timedelta(seconds=i * 50)) for i in range(57)],
                                 "report_date date, report_id string, customer_id string, amount double, created_at timestamp")
    parts = reports.summary_json(rows, 10).orderBy("part").collect()
    doc = json.loads("".join(p.content for p in parts))
    assert len(parts) == 6 and doc["total_count"] == 57 and [r["id"] for r in doc["reports"]] == [f"R{i:03}" for i in range(57)]


def test_reconcile_equal_sides(spark):
    keys = spark.createDataFrame([("T1", "CTR", "CTR-001"), ("T1", "CTR", "CTR-001"), ("T2", "SAR", "SAR-001")], "txn_id string, alert_type string, rule_id string")
    row = reconcile.reconcile(keys, keys).first()
    assert (row.batch_alerts, row.realtime_alerts, row.missing_in_realtime, row.extra_in_realtime, row.diff_rate, row.exceeds) == (2, 2, 0, 0, 0.0, False)
    none = reconcile.reconcile(keys.limit(0), keys).first()
    assert (none.batch_alerts, none.extra_in_realtime, none.diff_rate) == (0, 2, 0.0)
    lost = reconcile.reconcile(keys, keys.filter("txn_id = 'T1'")).first()
    assert (lost.missing_in_realtime, lost.diff_rate, lost.exceeds) == (1, 0.5, True)


def test_partition_overwrite_keeps_other_days(spark, tmp_path):
    path = str(tmp_path / "t")
    day = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-02")], "x int, dt string")
    overwrite_partitions(day, path)
    overwrite_partitions(spark.createDataFrame([(3, "2024-01-02")], "x int, dt string"), path)
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [1, 3]
    table = read_dated(spark, path, since="2024-01-02")
    assert [r.x for r in table.collect()] == [3]
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dt" in plan
    assert [r.x for r in latest_before(read_dated(spark, path), "2024-01-02").collect()] == [1]


def test_archive_by_day_and_type(spark, feed, tmp_path):
    path = str(tmp_path / "a")
    archive(feed, path)
    assert spark.read.parquet(path).filter("dt = '2024-05-09' AND txn_type = 'CARD'").count() == 1


def test_boolean_rule_values(spark):
    df = spark.createDataFrame([("T1", "C", T0, True), ("T2", "C", T0, False)], "txn_id string, customer_id string, ts timestamp, flagged boolean")
    pack = [dict(rule_id=r, name=r, type="SAR", severity="LOW", conditions=[rules.condition("flagged", op, v)], actions=[], logic=None)
            for r, op, v in (("EQ", "EQ", True), ("IN", "IN", [False]))]
    found = rules.evaluate_rules(df, pack)
    assert {(a.txn_id, a.rule_id) for a in found.collect()} == {("T1", "EQ"), ("T2", "IN")}


def test_many_rules_are_evaluated_in_slices(spark, monkeypatch):
    monkeypatch.setattr(rules, "RULES_PER_ARRAY", 3)
    df = spark.createDataFrame([("T1", "C", T0, 5)], "txn_id string, customer_id string, ts timestamp, n int")
    pack = [dict(rule_id=f"R{i}", name="", type="SAR", severity="LOW", conditions=[rules.condition("n", "GTE", i)], actions=[], logic=None) for i in range(10)]
    found = rules.evaluate_rules(df, pack)
    assert {a.rule_id for a in found.collect()} == {f"R{i}" for i in range(6)}


def test_names_of_other_scripts(spark):
    from txnwatch.operators import sanctions
    listed = spark.createDataFrame([(0, "Иван", "L"), (1, "محمد", "L"), (2, "!!", "L"), (3, "Li Wei", "L")], "pos long, name string, list_source string")
    names = spark.createDataFrame([("王",), ("ИВАН ",), ("??",), ("li wei!",)], "name string")
    assert {r.name for r in sanctions.exact_matches(names, listed).collect()} == {"ИВАН ", "li wei!"}
    assert {(r.name, r.matched_name) for r in sanctions.close_spellings(names, listed, 1).collect()} >= {("ИВАН ", "Иван"), ("li wei!", "Li Wei")}
    assert not [r for r in sanctions.close_spellings(names, listed, 1).collect() if r.name in ("??",)]
    assert sanctions.merge_lists(listed).count() == 4


def test_review_date_outlives_a_risk_change(spark):
    from txnwatch.operators import kyc
    profiles = spark.createDataFrame([("A", "LOW", 1.0, None, None), ("B", "LOW", 1.0, None, T0)],
                                     "customer_id string, risk_level string, risk_points double, next_review_date timestamp, last_review_date timestamp")
    changes = spark.createDataFrame([("A", 1, "REVIEW", None, None, T0), ("A", 2, "RISK", "HIGH", 5.0, T0 + dt.timedelta(days=1)), ("B", 1, "RISK", "HIGH", 5.0, T0),
                                     ("X", 1, "RISK", "HIGH", 5.0, T0), ("Y", 1, "UPSERT", "LOW", 1.0, T0)],
                                    "customer_id string, seq int, change string, risk_level string, risk_points double, change_at timestamp")
    got = {r.customer_id: r for r in kyc.apply_changes(profiles, changes).collect()}
    assert set(got) == {"A", "B", "Y"} and got["A"].last_review_date == T0 and got["B"].last_review_date == T0
    assert [r.customer_id for r in kyc.unknown_customers(profiles, changes).collect()] == ["X"]


def test_empty_rerun_leaves_nothing_behind(spark, tmp_path):
    from txnwatch.sources.sinks import batch_partition_writer, overwrite_day
    rows = spark.createDataFrame([("T1", "2024-01-01")], "txn_id string, dt string")
    overwrite_day(rows, f"{tmp_path}/days", "2024-01-01")
    overwrite_day(rows.limit(0), f"{tmp_path}/days", "2024-01-01")
    write = batch_partition_writer(f"{tmp_path}/batches")
    write(rows, 0)
    write(rows.limit(0), 0)
    assert spark.read.schema(rows.schema).parquet(f"{tmp_path}/days").count() == spark.read.schema(rows.schema).parquet(f"{tmp_path}/batches").count() == 0


def test_trailing_equals_slices():
    import numpy as np

    from txnwatch.streaming.state import trailing
    rng = np.random.default_rng(0)
    t = np.sort(rng.integers(0, 20_000, 300)) * 1_000_000
    cents, party = rng.integers(-50, 500, 300), np.array([None if x == 0 else str(x) for x in rng.integers(0, 9, 300)], object)
    at = rng.permutation(t)
    got = trailing(t, cents, party, at, 3600)
    for i, x in enumerate(at):
        inside = (t > x - 3600 * 1_000_000) & (t <= x)
        assert got["max_amount"][i] == cents[inside].max() and got["unique_counterparties"][i] == len({p for p in party[inside] if p is not None})


def test_cut_traces_say_so(spark):
    from txnwatch.operators import trace
    edges = spark.createDataFrame([("A", f"P{i}", f"T{i}", float(i)) for i in range(5)] + [("P4", "Q", "T9", 1.0)], "customer_id string, counterparty_id string, txn_id string, amount_usd double")
    found = {(r.hop, r.party): r.truncated for r in trace.trace(edges.select("customer_id").where("customer_id = 'A'"), edges, 2, edges_per_hop=3).collect()}
    assert found == {(1, "P4"): True, (1, "P3"): True, (1, "P2"): True, (2, "Q"): False}
