"""Registered queries: each runs an operator over the whole supplied tables, next to its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnwatch.operators import alerts as al
from txnwatch.operators import cases, dedup, flows, kyc, packs, ranking, reconcile, reports, risk, rolling, routing, rules, sanctions, trace, versions
from txnwatch.operators import normalize as norm
from txnwatch.plans import oracle as sql
from txnwatch.plans.mapping import table
from txnwatch.session import fresh_dir
from txnwatch.sources.streams import parse_json, to_messages
from txnwatch.sources.versioned import archive_batch, read_merged
from txnwatch.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

NOW, AS_OF = sql.NOW, sql.AS_OF


def query(name: str, twin: str | None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if twin is not None:
            ORACLE[name] = twin
        return fn
    return register


def _instant(text: str):
    return F.lit(text).cast("timestamp_ntz")


# --- Layer 1 ---------------------------------------------------------------------------------------------

_L1 = ["txn_id", "customer_id", "amount", "currency", "txn_type_normalized", "direction_normalized", "is_large_txn", "route_tag"]


@query("l1_valid", sql.L1_VALID)
def l1_valid(spark, sf):
    return norm.normalize(norm.valid_rows(table(spark, sf, "raw_txn"))).select(*_L1)


@query("l1_rejects", sql.L1_REJECTS)
def l1_rejects(spark, sf):
    bad = norm.rejected_rows(table(spark, sf, "raw_txn"))
    return bad.select("txn_id", "customer_id", "amount", F.concat_ws(",", "reject_reasons").alias("reject_reasons"))


@query("l1_strict_valid", sql.L1_STRICT)
def l1_strict_valid(spark, sf):
    return norm.valid_rows(table(spark, sf, "raw_txn"), norm.strict_checks()).select("txn_id", "customer_id", "counterparty_id", "currency")


@query("l1_route_counts", sql.L1_ROUTES)
def l1_route_counts(spark, sf):
    return al.count_by(norm.normalize(norm.valid_rows(table(spark, sf, "raw_txn"))), "route_tag", "txn_type_normalized")


# --- Rolling features ------------------------------------------------------------------------------------

@query("rolling_1h_24h", sql.ROLLING)
def rolling_1h_24h(spark, sf):
    txn = table(spark, sf, "txn").select("txn_id", "customer_id", "ts", "amount_usd")
    return rolling.rolling_amounts(txn).drop("ts", "amount_usd")


@query("rolling_distinct_cp", sql.ROLLING_DISTINCT)
def rolling_distinct_cp(spark, sf):
    txn = table(spark, sf, "txn").select("txn_id", "customer_id", "counterparty_id", "ts")
    out = rolling.rolling_features(txn, "customer_id", "ts", distinct=("unique_counterparties", F.col("counterparty_id")), count=None)
    return out.select("txn_id", "customer_id", "unique_counterparties_1h", "unique_counterparties_24h")


@query("rolling_7d", sql.ROLLING_7D)
def rolling_7d(spark, sf):
    txn = table(spark, sf, "txn").select("txn_id", "customer_id", "counterparty_id", "ts", "amount_usd")
    return rolling.rolling_transactions(txn, {"7d": 7 * rolling.DAY}, grain=6 * rolling.HOUR).drop("ts", "counterparty_id", "amount_usd")


@query("tumbling_1h", sql.tumbling("1 hour"))
def tumbling_1h(spark, sf):
    return _ntz(rolling.tumbling_stats(table(spark, sf, "txn"), "1 hour"), "window_start", "window_end")


@query("tumbling_24h", sql.tumbling("24 hours"))
def tumbling_24h(spark, sf):
    return _ntz(rolling.tumbling_stats(table(spark, sf, "txn"), "24 hours"), "window_start", "window_end")


def _ntz(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("newest_n_per_customer", sql.NEWEST)
def newest_n_per_customer(spark, sf):
    txn = table(spark, sf, "txn").select("txn_id", "customer_id", "ts")
    return ranking.newest_n(txn, "customer_id", "ts", 50, "txn_id")


@query("top_edges", sql.TOP_EDGES)
def top_edges(spark, sf):
    edges = trace.strongest_edges(table(spark, sf, "txn")).select("node", F.explode("edges").alias("e"))
    return edges.select(F.col("node").alias("customer_id"), "e.party", "e.txn_id", "e.amount_usd", "e.rank")


def _features(spark, sf):
    return risk.build_customer_features(table(spark, sf, "txn"), table(spark, sf, "customer_entity"), AS_OF, table(spark, sf, "alert_seed"))


def _canonical(spark, sf):
    return norm.normalize(norm.valid_rows(table(spark, sf, "raw_txn")))


@query("enriched_profile", sql.ENRICHED_PROFILE)
def enriched_profile(spark, sf):
    out = rolling.lookup_features(_canonical(spark, sf), _features(spark, sf), norm.BYPASS)
    return out.select("txn_id", "customer_id", "route_tag", "risk_level", "risk_score", "kyc_status", "alert_count_total",
                      F.col("open_alert_count").cast("bigint").alias("open_alert_count"))


@query("window_stats", sql.WINDOW_STATS)
def window_stats(spark, sf):
    return rolling.window_stats(table(spark, sf, "raw_txn"), ["customer_id"], F.col("amount"), 10_000)


# --- Rules -----------------------------------------------------------------------------------------------

_ALERT = ["alert_id", "txn_id", "customer_id", "alert_type", "severity", "rule_id", "rule_desc", "score", "status", "created_at"]


def _pack(spark, *ids: str):
    pack = packs.lowered_pack()
    return rules.collect_rules(rules.rule_frame(spark, [r for r in pack if not ids or r["rule_id"] in ids]))


def _enriched(spark, sf):
    return rolling.enrich(_canonical(spark, sf), _features(spark, sf))


@query("rule_alerts", sql.RULE_ALERTS)
def rule_alerts(spark, sf):
    return rules.all_alerts(_enriched(spark, sf), _pack(spark)).select(*_ALERT)


def _named(spark, sf, rows: DataFrame) -> DataFrame:
    """Transactions with the names of their counterparties."""
    names = table(spark, sf, "txn_party").select(F.col("txn_id").alias("__txn"), "counterparty_name")
    return rows.join(names, F.col("txn_id") == F.col("__txn"), "left").drop("__txn")


@query("all_alerts", sql.ALL_ALERTS)
def all_alerts(spark, sf):
    """Bypass, rule and sanction alerts as one table."""
    rows = _named(spark, sf, _enriched(spark, sf))
    # screening reads its rows twice and needs no rolling features: these are worked out once, for the rules
    plain = _named(spark, sf, rolling.lookup_features(_canonical(spark, sf), _features(spark, sf), norm.BYPASS))
    hits = sanctions.sanction_alerts(sanctions.screen(plain, table(spark, sf, "sanction_name"), "counterparty_name"))
    return rules.all_alerts(rows, _pack(spark), hits).select(*_ALERT).withColumn("score", F.round("score", 4))


def _rule(name: str, rule_id: str, prepare: Callable[[SparkSession, str], DataFrame]) -> None:
    @query(name, sql.one_rule(rule_id))
    def run(spark, sf):
        return rules.evaluate_rules(prepare(spark, sf), _pack(spark, rule_id)).select(*_ALERT)


def _rolled_amounts(spark, sf):
    return rolling.rolling_amounts(_canonical(spark, sf), {"24h": rolling.DAY})


def _rolled_count(spark, sf):
    return rolling.rolling_features(_canonical(spark, sf), "customer_id", "ts", {"1h": rolling.HOUR})


def _with_risk(spark, sf):
    return rolling.lookup_features(_canonical(spark, sf), _features(spark, sf), norm.BYPASS)


_rule("rule_ctr001", "CTR-001", _canonical)
_rule("rule_sar001", "SAR-001", _rolled_amounts)
_rule("rule_sar002", "SAR-002", _rolled_count)
_rule("rule_sar003", "SAR-003", _canonical)
_rule("rule_sar004", "SAR-004", _enriched)
_rule("rule_risk001", "RISK-001", _with_risk)


@query("rule_ops_matrix", sql.OPS_MATRIX)
def rule_ops_matrix(spark, sf):
    given = F.map_from_entries(F.array_compact(F.array(
        F.when(F.col("event_id") % 3 > 0, F.struct(F.lit("device"), F.when(F.col("event_id") % 3 == 1, "mobile").otherwise("desktop"))),
        F.when(F.col("event_id") % 2 == 0, F.struct(F.lit("attempts"), (F.col("event_id") % 5).cast("string"))))))
    txn = table(spark, sf, "txn").withColumns({
        "counterparty_opt": F.when(~F.col("counterparty_id").endswith("7"), F.col("counterparty_id")), "metadata": given})
    found = rules.evaluate_rules(txn, rules.collect_rules(rules.rule_frame(spark, packs.ops_matrix())))
    return found.select("txn_id", "rule_id", "rule_desc")


@query("rule_alerts_versioned", sql.RULE_ALERTS_VERSIONED)
def rule_alerts_versioned(spark, sf):
    """Three packs: the second replaces the first, the third comes and is deprecated again."""
    changes = [("V1", "CREATE", "2024-01-01", "2024-01-01"), ("V2", "CREATE", "2024-01-02", "2024-01-10"), ("V3", "CREATE", "2024-01-14", "2024-01-15"),
               ("V3", "DEPRECATE", "2024-01-20", None)]
    given = spark.createDataFrame(changes, "version_id string, event string, at string, effective_from string").collect()
    own = {"V1": packs.lowered_pack(), "V2": packs.stricter_pack("SAR-003", "amount_usd", 7000), "V3": packs.stricter_pack("CTR-001", "amount_usd", 9000)}
    in_force = [(name, begin, until, rules.collect_rules(rules.rule_frame(spark, own[name]))) for name, begin, until in versions.validity(given)]
    return rules.alerts_of_their_time(_enriched(spark, sf), in_force).select(*_ALERT, "version_id")


@query("rule_nested", sql.NESTED)
def rule_nested(spark, sf):
    found = rules.evaluate_rules(table(spark, sf, "txn"), rules.collect_rules(rules.rule_frame(spark, packs.NESTED)))
    return found.select("txn_id", "customer_id", "rule_id", "severity", "rule_desc", "score")


@query("bypass_ctr_alerts", sql.BYPASS)
def bypass_ctr_alerts(spark, sf):
    return rules.bypass_alerts(_canonical(spark, sf)).select(*_ALERT)


@query("sar002_historical", sql.SAR002_HISTORICAL)
def sar002_historical(spark, sf):
    txn = table(spark, sf, "txn").select("txn_id", "customer_id", "ts")
    counted = rolling.rolling_features(txn, "customer_id", "ts", {"1h": rolling.HOUR})
    found = rules.frequency_anomaly(counted, rules.hourly_baseline(txn))
    return found.select("txn_id", "customer_id", "txn_count_1h", F.round("mean_hourly", 6).alias("mean_hourly"))


@query("sar004_retention", sql.SAR004_RETENTION)
def sar004_retention(spark, sf):
    txn = table(spark, sf, "txn").select("txn_id", "customer_id", "ts", "direction", "amount_usd")
    flow = {f"{side}_": F.when(F.col("direction") == name, F.col("amount_usd")) for side, name in (("in", "INBOUND"), ("out", "OUTBOUND"))}
    rolled = rolling.rolling_amounts(txn, {"24h": rolling.DAY}, amounts=flow, maxes=False)
    return rules.rapid_in_out(rolled).select("txn_id", "customer_id", F.col("in_total_amount_24h").alias("in_amount_24h"),
                                             F.col("out_total_amount_24h").alias("out_amount_24h"))


@query("sar004_flow", sql.SAR004_FLOW)
def sar004_flow(spark, sf):
    txn = table(spark, sf, "txn").select("txn_id", "customer_id", "ts", "direction", "amount_usd")
    return flows.rapid_flows(txn).select("customer_id", "deposit_id", "withdrawal_id", "deposit_amount", "amount", "kept", "rapid")


@query("rules_effective_asof", sql.VERSION_ASOF)
def rules_effective_asof(spark, sf):
    return versions.with_effective_version(table(spark, sf, "txn").select("txn_id", "ts"), table(spark, sf, "rule_version")).select("txn_id", "version_id")


# --- Sanctions -------------------------------------------------------------------------------------------

@query("sanction_candidates", sql.SANCTION_CANDIDATES)
def sanction_candidates(spark, sf):
    names = table(spark, sf, "screen_name").unionByName(table(spark, sf, "customer").select(F.col("c_name").alias("name")))
    return sanctions.screening_candidates(names, table(spark, sf, "sanction_name")).select("name", "norm")


def _match(df):
    return df.select("name", "matched_name", "list_source", "pos", F.round("similarity", 6).alias("similarity"))


@query("sanction_best_match", sql.best_match("screen_name"))
def sanction_best_match(spark, sf):
    return _match(sanctions.best_matches(table(spark, sf, "screen_name"), table(spark, sf, "sanction_name")))


@query("sanction_swapped", sql.best_match("SELECT c_name AS name FROM customer UNION SELECT concat(substr(p_name, 2, 1), substr(p_name, 1, 1), substr(p_name, 3)) FROM part"))
def sanction_swapped(spark, sf):
    names = table(spark, sf, "customer").select(F.col("c_name").alias("name")).unionByName(
        table(spark, sf, "part").select(F.expr("concat(substr(p_name, 2, 1), substr(p_name, 1, 1), substr(p_name, 3))").alias("name")))
    return _match(sanctions.best_matches(names, table(spark, sf, "sanction_name")))


@query("sanction_alerts", sql.SANCTION_ALERTS)
def sanction_alerts(spark, sf):
    found = sanctions.screen(table(spark, sf, "txn_party"), table(spark, sf, "sanction_name"), "counterparty_name")
    return sanctions.sanction_alerts(found).select(*_ALERT).withColumn("score", F.round("score", 4))


@query("sanction_hits", sql.SANCTION_HITS)
def sanction_hits(spark, sf):
    found = sanctions.screen(table(spark, sf, "txn_party"), table(spark, sf, "sanction_name"), "counterparty_name")
    return sanctions.sanction_hits(found).drop("hit_id").withColumn("similarity", F.round("similarity", 6))


@query("sanction_exact", sql.SANCTION_EXACT)
def sanction_exact(spark, sf):
    return sanctions.exact_matches(table(spark, sf, "screen_name"), table(spark, sf, "sanction_name")).select("name", "norm")


@query("sanction_set_merged", sql.SANCTION_SET)
def sanction_set_merged(spark, sf):
    """Names in a set of two lists, of which one lost and one gained names after it was built."""
    names_a, names_b = table(spark, sf, "sanction_name"), table(spark, sf, "screen_name").select("name", F.lit("LIST-B").alias("list_source"))
    late = F.length("name") % 3 == 0
    names = sanctions.name_set(names_a.select("name", "list_source").unionByName(names_b.filter(~late)))
    gone = names_a.filter(F.col("pos") % 2 == 0).select("list_source", "name", F.lit("REMOVE").alias("op"), F.lit(1).alias("seq"))
    back = names_a.filter(F.col("pos") % 4 == 0).select("list_source", "name", F.lit("ADD").alias("op"), F.lit(2).alias("seq"))
    come = names_b.filter(late).select("list_source", "name", F.lit("ADD").alias("op"), F.lit(1).alias("seq"))
    names, bits = sanctions.change_set(names, sanctions.set_bits(names), gone.unionByName(back).unionByName(come))
    probes = table(spark, sf, "part").select(F.col("p_name").alias("name")).unionByName(table(spark, sf, "customer").select(F.col("c_name").alias("name"))).distinct()
    return sanctions.set_members(probes, names, bits).select("name", "norm")


@query("sanction_levenshtein", sql.SANCTION_LEVENSHTEIN)
def sanction_levenshtein(spark, sf):
    found = sanctions.close_spellings(table(spark, sf, "screen_name"), table(spark, sf, "sanction_name"))
    return found.withColumn("distance", F.col("distance").cast("bigint"))


@query("sanction_lists_merged", sql.SANCTION_MERGED)
def sanction_lists_merged(spark, sf):
    other = table(spark, sf, "screen_name").select(F.lit(0).cast("bigint").alias("pos"), "name", F.lit("LIST-B").alias("list_source"))
    return sanctions.merge_lists(table(spark, sf, "sanction_name"), other).select("norm", "pos", "name", "list_source")


@query("sanction_aliases", sql.SANCTION_ALIASES)
def sanction_aliases(spark, sf):
    listed = table(spark, sf, "sanction_name")
    alias = listed.select("pos", F.concat_ws(" ", F.reverse(F.split("name", " "))).alias("alias"))
    return _match(sanctions.best_matches(table(spark, sf, "screen_name"), sanctions.with_aliases(listed, alias)))


# --- Alert handling --------------------------------------------------------------------------------------

@query("alert_dedup_tumbling", sql.DEDUP_TUMBLING)
def alert_dedup_tumbling(spark, sf):
    return dedup.dedup_tumbling(table(spark, sf, "alert_seed"))


@query("alert_dedup_anchored", sql.DEDUP_ANCHORED)
def alert_dedup_anchored(spark, sf):
    return dedup.dedup_anchored(table(spark, sf, "alert_seed"))


@query("alert_correlation", sql.CORRELATION)
def alert_correlation(spark, sf):
    return dedup.correlate(table(spark, sf, "alert_seed"), "customer_id")


@query("alert_correlation_counterparty", sql.CORRELATION_PARTY)
def alert_correlation_counterparty(spark, sf):
    detailed = reports.with_txn_details(table(spark, sf, "alert_seed"), table(spark, sf, "txn"), ["counterparty_id"])
    return dedup.correlate(detailed, "counterparty_id")


@query("alert_queue", sql.ALERT_QUEUE)
def alert_queue(spark, sf):
    return al.alert_queue(table(spark, sf, "alert_seed")).select("rank", "alert_id", "severity", "created_at")


@query("alert_queue_top10", sql.ALERT_TOP10)
def alert_queue_top10(spark, sf):
    return al.queue_head(table(spark, sf, "alert_seed"), 10).select("alert_id", "severity", "created_at")


@query("alert_status_counts", sql.ALERT_COUNTS)
def alert_status_counts(spark, sf):
    return al.count_by(table(spark, sf, "alert_seed"), "status", "severity")


@query("alerts_selected", sql.ALERTS_SELECTED)
def alerts_selected(spark, sf):
    return al.select_alerts(table(spark, sf, "alert_seed"), status="NEW", severity="CRITICAL").select("alert_id", "customer_id", "rule_id", "created_at")


@query("alert_actions", sql.ALERT_ACTIONS)
def alert_actions(spark, sf):
    done = al.apply_actions(table(spark, sf, "alert_seed"), table(spark, sf, "alert_action"))
    return done.select("alert_id", "status", "reviewer_id", "notes", "updated_at")


@query("alert_action_rejects", sql.ALERT_ACTION_REJECTS)
def alert_action_rejects(spark, sf):
    _, rejected = al.split_actions(table(spark, sf, "alert_action"), table(spark, sf, "alert_seed"))
    return rejected.select("alert_id", F.col("seq").cast("bigint").alias("seq"), "action", "reason")


@query("alert_assignment", sql.ALERT_ASSIGNMENT)
def alert_assignment(spark, sf):
    scored = table(spark, sf, "alert_seed").withColumn("score", rules.severity_score(F.col("severity")))
    teams = table(spark, sf, "alert_seed").select("severity", "alert_type").distinct().withColumn(
        "team", F.concat_ws("-", F.lower("alert_type"), F.lower("severity")))
    return al.assign(scored, teams, 0.4).select("alert_id", "team", "status")


@query("alert_timeline", sql.ALERT_TIMELINE)
def alert_timeline(spark, sf):
    return al.alert_timeline(table(spark, sf, "alert_seed"), table(spark, sf, "txn"), 2)


@query("sla_actions", sql.SLA)
def sla_actions(spark, sf):
    done = al.sla_actions(table(spark, sf, "alert_seed"), _instant(sql.SLA_NOW))
    return done.select("alert_id", "severity", "status", "minutes", "sla_action", "sla_note")


# --- Customers, risk, KYC --------------------------------------------------------------------------------

@query("customer_profile_30d", sql.PROFILE)
def customer_profile_30d(spark, sf):
    return risk.customer_profile(table(spark, sf, "txn"), AS_OF)


_FEATURE_OUT = ["customer_id", "risk_level", "risk_score", "txn_count_7d", "txn_count_30d", "total_amount_7d", "total_amount_30d", "avg_amount",
                "max_amount", "unique_counterparties_30d", "alert_count_total"]


@query("risk_levels", sql.RISK_LEVELS)
def risk_levels(spark, sf):
    return _features(spark, sf).select(*_FEATURE_OUT, "kyc_status", F.col("open_alert_count").cast("bigint").alias("open_alert_count"))


@query("risk_composite", sql.RISK_COMPOSITE)
def risk_composite(spark, sf):
    customer = F.when(F.col("customer_type") == "PEP", 0.9).when(F.col("customer_type") == "CORPORATE", 0.5).otherwise(0.2)
    product = F.when(F.col("kyc_level") == "ENHANCED", 0.7).otherwise(0.3)
    busy = F.least(F.col("txn_count_30d") / F.lit(100.0), F.lit(2.0))
    score = risk.factor_score(risk.country_weight(F.col("nationality")), product, customer, busy)
    out = _features(spark, sf).withColumn("score", F.round(score, 6))
    return out.select("customer_id", "score", risk.risk_level(F.col("score")).alias("level"))


@query("entity_snapshot", sql.SNAPSHOT)
def entity_snapshot(spark, sf):
    entity = table(spark, sf, "customer_entity")
    history = entity.withColumn("dt", F.lit("2024-01-28")).unionByName(
        entity.withColumn("dt", F.lit("2024-01-29")))
    out = risk.build_entity_snapshot(history, _features(spark, sf), AS_OF)
    return out.select("customer_id", "name", "customer_type", "risk_level", "risk_score", "txn_count_30d", "alert_count_total", "dt")


@query("kyc_change_rejects", sql.KYC_CHANGE_REJECTS)
def kyc_change_rejects(spark, sf):
    """Changes of customers without a profile, where those without a review date have none."""
    profiles = table(spark, sf, "kyc_seed").filter(F.col("next_review_date").isNotNull())
    found = kyc.unknown_customers(profiles, table(spark, sf, "kyc_change"))
    return found.select("customer_id", "seq", "change", "risk_level", "risk_points", "change_at")


@query("kyc_review", sql.KYC_REVIEW)
def kyc_review(spark, sf):
    now = _instant(NOW)
    return table(spark, sf, "kyc_seed").select(
        "customer_id", "risk_level", kyc.review_status(F.col("next_review_date"), now).alias("review_status"),
        kyc.next_review(F.col("risk_level"), now).alias("following_review"))


@query("kyc_overdue", sql.KYC_OVERDUE)
def kyc_overdue(spark, sf):
    profiles = table(spark, sf, "kyc_seed").withColumn(
        "review_status", kyc.review_status(F.col("next_review_date"), _instant("2024-01-20 00:00:00")))
    return kyc.overdue_reviews(profiles, _instant(NOW)).select("customer_id", "next_review_date", "review_status")


@query("kyc_high_risk", sql.KYC_HIGH)
def kyc_high_risk(spark, sf):
    return kyc.high_risk(table(spark, sf, "kyc_seed")).select("rank", "customer_id", "risk_points")


@query("kyc_counts", sql.KYC_COUNTS)
def kyc_counts(spark, sf):
    status = kyc.review_status(F.col("next_review_date"), _instant(NOW))
    return al.count_by(table(spark, sf, "kyc_seed").withColumn("review_status", status), "risk_level", "review_status")


@query("kyc_changes", sql.KYC_CHANGES)
def kyc_changes(spark, sf):
    return kyc.apply_changes(table(spark, sf, "kyc_seed"), table(spark, sf, "kyc_change"))


@query("kyc_pattern_triggers", sql.KYC_TRIGGERS)
def kyc_pattern_triggers(spark, sf):
    return kyc.pattern_changes(risk.customer_profile(table(spark, sf, "txn"), AS_OF), 1.2).select("customer_id", "txn_count_7d", "txn_count_30d")


# --- Cases -----------------------------------------------------------------------------------------------

@query("case_queue", sql.CASE_QUEUE)
def case_queue(spark, sf):
    return cases.case_queue(table(spark, sf, "case_seed")).select("rank", "case_id", "priority", "created_at")


@query("case_events", sql.CASE_EVENTS)
def case_events(spark, sf):
    return cases.fold_cases(table(spark, sf, "case_event"))


@query("case_linked_alerts", sql.CASE_LINKED)
def case_linked_alerts(spark, sf):
    folded = cases.fold_cases(table(spark, sf, "case_event")).select("case_id", "linked_alert_ids")
    return cases.linked_alerts(folded, table(spark, sf, "alert_seed")).select("case_id", "alert_id", "severity", "rule_id")


@query("case_status_counts", sql.CASE_COUNTS)
def case_status_counts(spark, sf):
    return al.count_by(table(spark, sf, "case_seed"), "status", "assigned_to")


@query("cases_selected", sql.CASES_SELECTED)
def cases_selected(spark, sf):
    return cases.select_cases(table(spark, sf, "case_seed"), status="OPEN", assigned_to="analyst3").select("case_id", "customer_id", "priority")


# --- Reports and reconciliation --------------------------------------------------------------------------

@query("daily_summary", sql.DAILY_SUMMARY)
def daily_summary(spark, sf):
    return reports.daily_summary(table(spark, sf, "txn"), table(spark, sf, "alert_seed"))


@query("ctr_extract", sql.CTR_EXTRACT)
def ctr_extract(spark, sf):
    found = reports.ctr_extract(table(spark, sf, "alert_seed"))
    return reports.with_txn_details(found, table(spark, sf, "txn"), ["amount", "currency", "channel"]).select(
        "alert_id", "txn_id", "customer_id", "amount", "currency", "channel", "created_at", "dt")


@query("sar_extract", sql.SAR_EXTRACT)
def sar_extract(spark, sf):
    return reports.sar_extract(table(spark, sf, "alert_seed")).select("alert_id", "txn_id", "customer_id", "severity", "created_at", "dt")


@query("ctr_events", sql.CTR_EVENTS)
def ctr_events(spark, sf):
    return reports.ctr_events(table(spark, sf, "alert_seed"), table(spark, sf, "txn"))


def _report_rows(spark, sf):
    alerts = table(spark, sf, "alert_seed")
    found = reports.ctr_extract(alerts).unionByName(reports.sar_extract(alerts))
    rows = reports.with_txn_details(found, table(spark, sf, "txn"), ["amount", "currency", "channel"])
    return rows.withColumns({"report_id": F.concat("alert_type", F.lit("-<"), "txn_id", F.lit(">")), "txn_date": F.col("dt")})


@query("report_xml", sql.report_xml("channel"))
def report_xml(spark, sf):
    return reports.report_xml(_report_rows(spark, sf), F.col("alert_type"), F.lit("2024-02-01")).select("report_id", "content")


@query("report_xml_dated", sql.report_xml("date"))
def report_xml_dated(spark, sf):
    return reports.report_xml(_report_rows(spark, sf), F.col("alert_type"), F.lit("2024-02-01"), "date").select("report_id", "content")


@query("report_summary_json", sql.SUMMARY_JSON)
def report_summary_json(spark, sf):
    rows = _report_rows(spark, sf).withColumn("report_date", F.to_date("created_at"))
    return reports.summary_json(rows, 25)


@query("report_status", sql.REPORT_STATUS)
def report_status(spark, sf):
    return reports.fold_reports(table(spark, sf, "report_event"))


@query("reports_pending", sql.REPORTS_PENDING)
def reports_pending(spark, sf):
    return reports.pending_submissions(reports.fold_reports(table(spark, sf, "report_event"))).select("report_id", "report_type", "customer_id")


@query("batch_alerts", sql.BATCH_ALERTS)
def batch_alerts(spark, sf):
    return reconcile.batch_alerts(table(spark, sf, "txn"), sar_total=15_000)


def _realtime(spark, sf):
    amounts = norm.normalize(table(spark, sf, "txn").select("txn_id", "txn_type", "ts", "amount", "amount_usd", "currency", "direction", "customer_id", "channel"))
    rolled = rolling.rolling_amounts(amounts, {"24h": rolling.DAY})
    found = rules.all_alerts(rolled, _pack(spark, "CTR-001", "SAR-001"))
    return found.withColumn("report_date", F.to_date("created_at"))


@query("reconciliation", sql.RECONCILIATION)
def reconciliation(spark, sf):
    return reconcile.reconcile(reconcile.batch_alerts(table(spark, sf, "txn"), sar_total=15_000), _realtime(spark, sf), ["report_date"],
                               ["CTR-001", "SAR-001"])


@query("reconciliation_missing", sql.RECON_MISSING)
def reconciliation_missing(spark, sf):
    return reconcile.missing_in_realtime(reconcile.batch_alerts(table(spark, sf, "txn"), sar_total=15_000), _realtime(spark, sf))


@query("reconciliation_extra", sql.RECON_EXTRA)
def reconciliation_extra(spark, sf):
    return reconcile.extra_in_realtime(reconcile.batch_alerts(table(spark, sf, "txn"), sar_total=15_000), _realtime(spark, sf))


# --- Tracing and routing ---------------------------------------------------------------------------------

@query("trace_forward", sql.trace(True))
def trace_forward(spark, sf):
    txn = table(spark, sf, "txn")
    return trace.trace(txn.select("customer_id"), txn)


@query("trace_backward", sql.trace(False))
def trace_backward(spark, sf):
    txn = table(spark, sf, "txn")
    return trace.trace(txn.select("customer_id"), txn, forward=False)


@query("trace_alerted", sql.TRACE_ALERTED)
def trace_alerted(spark, sf):
    return trace.trace_alerted(table(spark, sf, "alert_seed"), table(spark, sf, "txn"))


@query("hot_customers", sql.HOT)
def hot_customers(spark, sf):
    return routing.hot_customers(table(spark, sf, "txn"), 10)


@query("hot_routes", sql.HOT_ROUTES)
def hot_routes(spark, sf):
    txn = _canonical(spark, sf)
    return al.count_by(routing.tag_hot(txn, routing.hot_customers(txn, 10)), "route_tag", "customer_id")


@query("batch_deposits", sql.BATCH_DEPOSITS)
def batch_deposits(spark, sf):
    return routing.batch_deposits(table(spark, sf, "txn"), 1)


# --- Streams: the same files through Structured Streaming, drained and read back --------------------------

def _event_stream(spark, sf):
    """The events file as a stream of the canonical view's columns."""
    schema = table(spark, sf, "events").schema
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _stream_table(spark, sf, name):
    """A view over the streamed events; same SQL text as the batch view."""
    from txnwatch.plans.mapping import VIEWS

    events = _event_stream(spark, sf)
    known = {"events": events}
    for view in ("txn", "raw_txn", "alert_seed"):
        text = VIEWS[view].replace("{k}", "get_json_object(props, '$.k')")
        known[view] = spark.sql(text, **{n: d for n, d in known.items() if "{" + n + "}" in text})
    return known[name]


def _drain(started) -> None:
    started.awaitTermination()


@query("stream_normalize", sql.L1_VALID)
def stream_normalize(spark, sf):
    base = fresh_dir(spark, "normalize")
    _drain(jobs.normalize_job(_stream_table(spark, sf, "raw_txn"), f"{base}/valid", f"{base}/rejected", f"{base}/checkpoint", once=True))
    return spark.read.parquet(f"{base}/valid").select(*_L1)


@query("stream_rejects", sql.STREAM_REJECTS)
def stream_rejects(spark, sf):
    base = fresh_dir(spark, "rejects")
    _drain(jobs.normalize_job(_stream_table(spark, sf, "raw_txn"), f"{base}/valid", f"{base}/rejected", f"{base}/checkpoint", once=True))
    return spark.read.parquet(f"{base}/rejected").select("txn_id", "customer_id", "amount")


@query("stream_json_roundtrip", sql.STREAM_JSON)
def stream_json_roundtrip(spark, sf):
    txn = _stream_table(spark, sf, "txn").select("txn_id", "customer_id", "amount_usd", "channel")
    parsed = parse_json(to_messages(txn, key="customer_id", topic="txn.normalized"), txn.schema)
    base = fresh_dir(spark, "json")
    _drain(jobs.start(parsed.drop("raw_value").writeStream.format("parquet").option("path", f"{base}/out"), f"{base}/checkpoint", True))
    return spark.read.parquet(f"{base}/out").drop("topic")


@query("stream_dedup", sql.DEDUP_TUMBLING_CLOSED)
def stream_dedup(spark, sf):
    base = fresh_dir(spark, "dedup")
    _drain(jobs.aggregate_job(_stream_table(spark, sf, "alert_seed"), f"{base}/out", f"{base}/checkpoint", once=True))
    out = spark.read.parquet(f"{base}/out").drop("batch_id")
    return _ntz(out, "window_start", "window_end", "created_at")


@query("stream_dedup_anchored", sql.DEDUP_ANCHORED_CLOSED)
def stream_dedup_anchored(spark, sf):
    base = fresh_dir(spark, "anchored")
    _drain(jobs.anchored_job(_stream_table(spark, sf, "alert_seed"), f"{base}/out", f"{base}/checkpoint", once=True))
    return _ntz(spark.read.parquet(f"{base}/out").drop("batch_id"), "created_at")


@query("stream_dedup_updates", sql.DEDUP_TUMBLING)
def stream_dedup_updates(spark, sf):
    """All windows, also those that the watermark has not passed."""
    base = fresh_dir(spark, "updates")
    alerts = _stream_table(spark, sf, "alert_seed")
    _drain(jobs.aggregate_updates_job(alerts, f"{base}/out", f"{base}/checkpoint", once=True))
    stamped = table(spark, sf, "alert_seed").withColumn("created_at", F.col("created_at").cast("timestamp"))
    return _ntz(read_merged(spark, f"{base}/out", dedup.dedup_tumbling(stamped).schema), "window_start", "window_end", "created_at")


@query("stream_archive", sql.STREAM_ARCHIVE)
def stream_archive(spark, sf):
    """The valid rows by day and type, from a batch that ran, ran again with half of its rows, and ran a third time."""
    base = fresh_dir(spark, "archive")
    _drain(jobs.normalize_job(_stream_table(spark, sf, "raw_txn"), f"{base}/valid", f"{base}/rejected", f"{base}/checkpoint", once=True, archive=f"{base}/archive"))
    rows = spark.read.parquet(f"{base}/valid").filter("batch_id = 0").drop("batch_id")
    for kept in (F.dayofmonth("ts") % 2 == 0, F.lit(True)):
        archive_batch(rows.filter(kept), f"{base}/archive", 0)
    return spark.read.parquet(f"{base}/archive").select("txn_id", "customer_id", "amount", F.col("dt").cast("string").alias("dt"), "txn_type")


@query("stream_enrich_late", sql.STREAM_ENRICH_LATE)
def stream_enrich_late(spark, sf):
    """One row in fifty arrives in a second batch, when most of them are later than the watermark."""
    base = fresh_dir(spark, "late")
    txn = table(spark, sf, "txn").select("txn_id", "event_id", "customer_id", "counterparty_id", "ts", "amount_usd")
    for part in (F.col("event_id") % 50 != 0, F.col("event_id") % 50 == 0):
        txn.filter(part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs.STATE_STORE)
    stream = spark.readStream.schema(txn.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    _drain(jobs.enrich_job(stream, f"{base}/out", f"{base}/checkpoint", once=True))
    measures = [f"{m}_{w}" for w in ("1h", "24h") for m in ("txn_count", "total_amount", "max_amount", "unique_counterparties")]
    return spark.read.parquet(f"{base}/out").select("txn_id", "customer_id", *measures, "late")


@query("tumbling_24h_merged", sql.tumbling("24 hours"))
def tumbling_24h_merged(spark, sf):
    """From hourly rows; a customer's counterparties of a day are few enough here for exact estimates."""
    return _ntz(rolling.merged_windows(rolling.hourly_sketches(table(spark, sf, "txn"))), "window_start", "window_end")


@query("stream_tumbling_24h", sql.TUMBLING_CLOSED)
def stream_tumbling_24h(spark, sf):
    base = fresh_dir(spark, "tumbling")
    _drain(jobs.tumbling_job(_stream_table(spark, sf, "txn"), f"{base}/out", f"{base}/checkpoint", once=True))
    return _ntz(spark.read.parquet(f"{base}/out").drop("batch_id"), "window_start", "window_end")


@query("stream_enrich", sql.STREAM_ENRICH)
def stream_enrich(spark, sf):
    base = fresh_dir(spark, "enrich")
    _drain(jobs.enrich_job(_stream_table(spark, sf, "txn"), f"{base}/out", f"{base}/checkpoint", once=True))
    measures = [f"{m}_{w}" for w in ("1h", "24h") for m in ("txn_count", "total_amount", "max_amount", "unique_counterparties")]
    return spark.read.parquet(f"{base}/out").select("txn_id", "customer_id", *measures)


@query("stream_enrich_hot", sql.STREAM_ENRICH)
def stream_enrich_hot(spark, sf):
    base = fresh_dir(spark, "hot")
    txn = _stream_table(spark, sf, "txn").select("txn_id", "customer_id", "counterparty_id", "ts", "amount_usd")
    _drain(jobs.enrich_hot_lane(txn, f"{base}/history", f"{base}/out", f"{base}/checkpoint", once=True))
    return spark.read.parquet(f"{base}/out").drop("batch_id", "ts", "counterparty_id", "amount_usd")


@query("stream_alerts", sql.STREAM_ALERTS)
def stream_alerts(spark, sf):
    base = fresh_dir(spark, "alerts")
    pack = [r for r in packs.lowered_pack() if r["rule_id"] in ("CTR-001", "SAR-003")]
    rules.rule_frame(spark, pack).coalesce(1).write.json(f"{base}/rules")
    rows = norm.normalize(norm.valid_rows(_stream_table(spark, sf, "raw_txn")))
    _drain(jobs.detect_job(spark, rows, f"{base}/rules", f"{base}/out", f"{base}/checkpoint", once=True))
    return spark.read.parquet(f"{base}/out").select(*_ALERT)


@query("stream_pipeline_alerts", sql.RULE_ALERTS)
def stream_pipeline_alerts(spark, sf):
    """From the feed to alerts: validate, normalize, roll, look up features, bypass lane and all rules."""
    base = fresh_dir(spark, "feed")
    rules.rule_frame(spark, packs.lowered_pack()).coalesce(1).write.json(f"{base}/rules")
    rows = norm.normalize(norm.valid_rows(_stream_table(spark, sf, "raw_txn")))
    _drain(jobs.enrich_job(rows, f"{base}/enriched", f"{base}/checkpoint-1", once=True, features=_features(spark, sf)))
    schema = spark.read.parquet(f"{base}/enriched").schema
    enriched = spark.readStream.schema(schema).parquet(f"{base}/enriched")
    _drain(jobs.detect_job(spark, enriched, f"{base}/rules", f"{base}/out", f"{base}/checkpoint-2", once=True))
    return _ntz(spark.read.parquet(f"{base}/out").select(*_ALERT), "created_at")


@query("stream_all_alerts", sql.ALL_ALERTS)
def stream_all_alerts(spark, sf):
    """From the feed to bypass, rule and sanction alerts."""
    base = fresh_dir(spark, "all")
    rules.rule_frame(spark, packs.lowered_pack()).coalesce(1).write.json(f"{base}/rules")
    rows = _named(spark, sf, norm.normalize(norm.valid_rows(_stream_table(spark, sf, "raw_txn"))))
    _drain(jobs.enrich_job(rows, f"{base}/enriched", f"{base}/checkpoint-1", once=True, features=_features(spark, sf)))
    schema = spark.read.parquet(f"{base}/enriched").schema
    enriched = spark.readStream.schema(schema).parquet(f"{base}/enriched")
    _drain(jobs.detect_job(spark, enriched, f"{base}/rules", f"{base}/out", f"{base}/checkpoint-2", table(spark, sf, "sanction_name"), "counterparty_name", once=True))
    return _ntz(spark.read.parquet(f"{base}/out").select(*_ALERT).withColumn("score", F.round("score", 4)), "created_at")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions to alerts: validate, normalize, enrich, evaluate every rule, add the bypass lane."""
    return rule_alerts(spark, sf)
