"""SQL twins of the registered queries, over the same tables, for an independent engine."""

from __future__ import annotations

from txnwatch.operators.packs import HIGH_RISK_COUNTRIES
from txnwatch.plans.mapping import ctes
from txnwatch.schemas import CURRENCIES

NOW, AS_OF, SLA_NOW = "2024-02-01 00:00:00", "2024-01-30", "2024-01-30 12:00:00"


def _with(views: tuple[str, ...] | list[str], *own: str, body: str, recursive: bool = False) -> str:
    parts = [ctes(*views), *own]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(p for p in parts if p) + "\n" + body


_VALID = "coalesce(txn_id, '') <> '' AND amount > 0 AND coalesce(customer_id, '') <> ''"
_STRICT_CURRENCIES = ",".join(f"'{c}'" for c in CURRENCIES)


def _normalized(src: str, where: str = "TRUE") -> str:
    return f"""SELECT * REPLACE (upper(currency) AS currency),
 CASE WHEN txn_type IN ('TRANSFER','CARD','FOREX') THEN txn_type ELSE 'UNKNOWN' END AS txn_type_normalized,
 CASE WHEN direction IN ('INBOUND','OUTBOUND') THEN direction ELSE 'UNKNOWN' END AS direction_normalized,
 coalesce(amount >= 10000, FALSE) AS is_large_txn,
 CASE WHEN amount >= 10000 THEN 'BYPASS_CTR' ELSE 'MAIN' END AS route_tag
FROM {src} WHERE {where}"""


_CANON = f"canon AS ({_normalized('raw_txn', _VALID)})"
L1_VALID = _with(["raw_txn"], _CANON, body="SELECT txn_id, customer_id, amount, currency, txn_type_normalized, direction_normalized, is_large_txn, route_tag FROM canon")
_REASONS = """array_to_string([x FOR x IN [
 CASE WHEN coalesce(txn_id, '') = '' THEN 'txn_id' END,
 CASE WHEN NOT coalesce(amount > 0, FALSE) THEN 'amount' END,
 CASE WHEN coalesce(customer_id, '') = '' THEN 'customer_id' END] IF x IS NOT NULL], ',')"""
L1_REJECTS = _with(["raw_txn"], body=f"SELECT txn_id, customer_id, amount, {_REASONS} AS reject_reasons FROM raw_txn WHERE NOT coalesce({_VALID}, FALSE)")
STREAM_REJECTS = _with(["raw_txn"], body=f"SELECT txn_id, customer_id, amount FROM raw_txn WHERE NOT coalesce({_VALID}, FALSE)")
L1_STRICT = _with(["raw_txn"], body=f"""SELECT txn_id, customer_id, counterparty_id, currency FROM raw_txn
WHERE {_VALID} AND coalesce(counterparty_id, '') <> '' AND ts > TIMESTAMP '1970-01-01' AND upper(currency) IN ({_STRICT_CURRENCIES})""")
L1_ROUTES = _with(["raw_txn"], _CANON, body="SELECT route_tag, txn_type_normalized, count(*) AS n FROM canon GROUP BY ALL")

# --- Rolling ---


def _over(window: str) -> str:
    length = {"1h": "00:59:59.999999", "24h": "23:59:59.999999", "7d": "167:59:59.999999"}[window]
    return f"(PARTITION BY customer_id ORDER BY ts RANGE BETWEEN INTERVAL '{length}' PRECEDING AND CURRENT ROW)"


def _roll(windows: list[str], measures: str = "nsmd") -> str:
    out = []
    for w in windows:
        o = _over(w)
        out += [x for m, x in (
            ("n", f"count(*) OVER {o} AS txn_count_{w}"), ("s", f"CAST(sum(amount_usd) OVER {o} AS DECIMAL(18,2)) AS total_amount_{w}"),
            ("m", f"max(amount_usd) OVER {o} AS max_amount_{w}"),
            ("d", f"count(DISTINCT counterparty_id) OVER {o} AS unique_counterparties_{w}")) if m in measures]
    return ", ".join(out)


ROLLING = _with(["txn"], body=f"SELECT txn_id, customer_id, {_roll(['1h', '24h'], 'nsm')} FROM txn")
ROLLING_DISTINCT = _with(["txn"], body=f"SELECT txn_id, customer_id, {_roll(['1h', '24h'], 'd')} FROM txn")
ROLLING_7D = _with(["txn"], body=f"SELECT txn_id, customer_id, {_roll(['7d'])} FROM txn")
STREAM_ENRICH = _with(["txn"], body=f"SELECT txn_id, customer_id, {_roll(['1h', '24h'])} FROM txn")

_MEASURES = [f"{m}_{w}" for w in ("1h", "24h") for m in ("txn_count", "total_amount", "max_amount", "unique_counterparties")]
STREAM_ENRICH_LATE = _with(["txn"], f"a AS (SELECT txn_id, customer_id, ts, {_roll(['1h', '24h'])} FROM txn WHERE event_id % 50 <> 0)",
                           f"b AS (SELECT txn_id, customer_id, ts, event_id, {_roll(['1h', '24h'])} FROM txn)",
                           "h AS (SELECT customer_id, max(ts) - INTERVAL '48 hours' AS horizon FROM a GROUP BY 1)",
                           """k AS (SELECT b.*, ts - INTERVAL '24 hours' < coalesce(horizon, (SELECT max(ts) - INTERVAL '72 hours' FROM a)) AS late
 FROM b LEFT JOIN h USING (customer_id) WHERE event_id % 50 = 0)""",
                           body=f"""SELECT txn_id, customer_id, {', '.join(_MEASURES)}, FALSE AS late FROM a UNION ALL
 SELECT txn_id, customer_id, {', '.join(f'CASE WHEN NOT late THEN {m} END' for m in _MEASURES)}, late FROM k""")
STREAM_ARCHIVE = _with(["raw_txn"], _CANON, body="SELECT txn_id, customer_id, amount, strftime(ts, '%Y-%m-%d') AS dt, txn_type FROM canon")


def tumbling(length: str) -> str:
    return _with(["txn"], body=f"""SELECT customer_id, time_bucket(INTERVAL '{length}', ts, TIMESTAMP '1970-01-01') AS window_start,
 time_bucket(INTERVAL '{length}', ts, TIMESTAMP '1970-01-01') + INTERVAL '{length}' AS window_end, count(*) AS txn_count,
 CAST(sum(amount_usd) AS DECIMAL(18,2)) AS total_amount, max(amount_usd) AS max_amount, count(DISTINCT counterparty_id) AS unique_counterparties
FROM txn GROUP BY 1, 2, 3""")


TUMBLING_CLOSED = f"SELECT * FROM ({tumbling('24 hours')}) WHERE window_end <= (SELECT max(ts) FROM events) - INTERVAL '1 hour'"


NEWEST = _with(["txn"], body="""SELECT txn_id, customer_id, ts, row_number() OVER (PARTITION BY customer_id ORDER BY ts DESC, txn_id DESC) AS recency
FROM txn QUALIFY recency <= 50""")
TOP_EDGES = _with(["txn"], body="""SELECT customer_id, counterparty_id AS party, txn_id, amount_usd,
 row_number() OVER (PARTITION BY customer_id ORDER BY amount_usd DESC, txn_id) AS rank
FROM txn WHERE counterparty_id IS NOT NULL QUALIFY rank <= 100""")

_PROFILE = f"""profile AS (SELECT customer_id, count(*) AS txn_count_30d, CAST(sum(amount_usd) AS DECIMAL(18,2)) AS total_amount_30d,
 round(CAST(sum(amount_usd) AS DOUBLE) / count(amount_usd), 6) AS avg_amount, max(amount_usd) AS max_amount,
 count(DISTINCT counterparty_id) AS unique_counterparties_30d,
 count(*) FILTER (WHERE ts >= DATE '{AS_OF}' - 7) AS txn_count_7d,
 CAST(coalesce(sum(amount_usd) FILTER (WHERE ts >= DATE '{AS_OF}' - 7), 0) AS DECIMAL(18,2)) AS total_amount_7d
FROM txn WHERE ts >= DATE '{AS_OF}' - 30 AND ts < DATE '{AS_OF}' + 1 GROUP BY customer_id)"""
_SCORE = """round((CASE WHEN e.nationality IN ('IR','KP','SY') THEN 1e0 WHEN e.nationality IN ('US','GB','DE') THEN 1e-1 ELSE 5e-1 END) * 3e-1
 + (CASE WHEN coalesce(p.txn_count_30d, 0) > 100 THEN 8e-1 WHEN coalesce(p.txn_count_30d, 0) > 50 THEN 5e-1 ELSE 2e-1 END) * 7e-1, 6)"""


def _level(score: str) -> str:
    return f"CASE WHEN {score} >= 7e-1 THEN 'HIGH' WHEN {score} >= 4e-1 THEN 'MEDIUM' ELSE 'LOW' END"


_FEATURES = f"""alert_counts AS (SELECT customer_id, count(*) AS a, count(*) FILTER (WHERE status NOT IN ('CLOSED','REPORTED')) AS o FROM alert_seed GROUP BY 1),
features AS (SELECT e.*, coalesce(p.txn_count_7d, 0) AS txn_count_7d, coalesce(p.txn_count_30d, 0) AS txn_count_30d,
 coalesce(p.total_amount_7d, 0) AS total_amount_7d, coalesce(p.total_amount_30d, 0) AS total_amount_30d, coalesce(p.avg_amount, 0) AS avg_amount,
 coalesce(p.max_amount, 0) AS max_amount, coalesce(p.unique_counterparties_30d, 0) AS unique_counterparties_30d,
 coalesce(c.a, 0) AS alert_count_total, coalesce(c.o, 0) AS open_alert_count,
 {_SCORE} AS risk_score, {_level(_SCORE)} AS risk_level, e.kyc_level AS kyc_status
FROM customer_entity e LEFT JOIN profile p USING (customer_id) LEFT JOIN alert_counts c USING (customer_id))"""
_FEATURE_VIEWS = ["raw_txn", "customer_entity", "alert_seed"]
_LOOKUP = """looked AS (SELECT n.*, coalesce(f.risk_level, 'UNKNOWN') AS risk_level, coalesce(f.risk_score, 0) AS risk_score,
 coalesce(f.kyc_status, 'UNKNOWN') AS kyc_status, coalesce(f.alert_count_total, 0) AS alert_count_total, coalesce(f.open_alert_count, 0) AS open_alert_count
FROM canon n LEFT JOIN features f ON n.customer_id = f.customer_id AND n.route_tag <> 'BYPASS_CTR')"""
ENRICHED_PROFILE = _with(_FEATURE_VIEWS, _CANON, _PROFILE, _FEATURES, _LOOKUP, body="""SELECT txn_id, customer_id, route_tag, risk_level, risk_score,
 kyc_status, alert_count_total, open_alert_count FROM looked""")
WINDOW_STATS = _with(["raw_txn"], body="""SELECT customer_id, count(amount) AS txn_count, CAST(coalesce(sum(amount), 0) AS DECIMAL(18,2)) AS total_amount,
 CAST(coalesce(max(amount), 0) AS DECIMAL(18,2)) AS max_amount, round(coalesce(avg(CAST(amount AS DOUBLE)), 0), 6) AS avg_amount,
 coalesce(bool_or(amount >= 10000), FALSE) AS exceeds_threshold FROM raw_txn GROUP BY customer_id""")

# --- Rules ---


def _alert(src: str, rule: str, kind: str, severity: str, score: str, text: str, where: str) -> str:
    return f"""SELECT sha256(concat_ws('|', txn_id, '{rule}')) AS alert_id, txn_id, customer_id, '{kind}' AS alert_type, '{severity}' AS severity,
 '{rule}' AS rule_id, {text} AS rule_desc, CAST({score} AS FLOAT) AS score, 'NEW' AS status, ts AS created_at FROM {src} WHERE {where}"""


_HIGH_RISK = "(" + ",".join(f"'{c}'" for c in HIGH_RISK_COUNTRIES) + ")"
# rule: (type, severity, score, message, condition), limits as in the lowered pack.
_RULES = {
    "CTR-001": ("CTR", "HIGH", "0.8", "concat('CTR: Large cash transaction $', amount_usd, ' via $', channel)",
                "amount_usd >= 5000 AND txn_type_normalized = 'TRANSFER' AND channel IN ('ATM','BRANCH')"),
    "SAR-001": ("SAR", "HIGH", "0.8", "concat('SAR: Potential structuring - $', txn_count_24h, ' transactions totaling $', total_amount_24h)",
                "txn_count_24h >= 5 AND max_amount_24h < 10000 AND total_amount_24h >= 15000"),
    "SAR-002": ("SAR", "MEDIUM", "0.5", "concat('SAR: Anomalous frequency - $', txn_count_1h, ' transactions in 1 hour for customer $', customer_id)",
                "txn_count_1h >= 3"),
    "SAR-003": ("SAR", "HIGH", "0.8", "concat('SAR: High-risk country transfer $', amount_usd, ' to $', country_dst)",
                f"country_dst IN {_HIGH_RISK} AND amount_usd >= 5000"),
    "SAR-004": ("SAR", "MEDIUM", "0.5", "concat('SAR: Rapid in-out pattern - $', txn_count_24h, ' txns with $', unique_counterparties_24h, ' counterparties, risk=$', risk_level)",
                "txn_count_24h >= 3 AND unique_counterparties_24h <= 4 AND risk_level IN ('HIGH','PROHIBITED')"),
    "RISK-001": ("RULE", "MEDIUM", "0.5", "concat('RISK: High-risk customer $', customer_id, ' transaction $', amount_usd)",
                 "risk_level = 'HIGH' AND amount_usd >= 5000"),
}
_ENRICHED = f"enr AS (SELECT *, {_roll(['1h', '24h'])} FROM looked)"


def _rule_alerts(src: str, rule: str) -> str:
    kind, severity, score, text, where = _RULES[rule]
    return _alert(src, rule, kind, severity, score, text, f"route_tag <> 'BYPASS_CTR' AND {where}")


def _bypass(src: str) -> str:
    return _alert(src, "CTR-001", "CTR", "HIGH", "1.0", "concat('Auto-CTR: Large transaction ', coalesce(CAST(amount_usd AS VARCHAR), 'N/A'), ' bypass lane')",
                  "route_tag = 'BYPASS_CTR'")


def _enriched(body: str) -> str:
    return _with(_FEATURE_VIEWS, _CANON, _PROFILE, _FEATURES, _LOOKUP, _ENRICHED, body=body)


RULE_ALERTS = _enriched("\nUNION ALL\n".join([*(_rule_alerts("enr", r) for r in _RULES), _bypass("enr")]))


def _versioned() -> str:
    """Every rule once a version, with the version's time and limit."""
    spans = [("V1", "ts >= '2024-01-01' AND ts < '2024-01-10'", {}), ("V3", "ts >= '2024-01-15' AND ts < '2024-01-20'", {"CTR-001": ("5000", "9000")}),
             ("V2", "(ts >= '2024-01-10' AND ts < '2024-01-15' OR ts >= '2024-01-20')", {"SAR-003": ("5000", "7000")})]
    parts = []
    for version, when, limits in spans:
        for rule in _RULES:
            old, new = limits.get(rule, ("", ""))
            text = _rule_alerts("enr", rule)
            parts.append(f"SELECT *, '{version}' AS version_id FROM ({text.replace('>= ' + old, '>= ' + new) if old else text}) WHERE {when.replace('ts', 'created_at')}")
    return _enriched("\nUNION ALL\n".join([*parts, f"SELECT *, NULL AS version_id FROM ({_bypass('enr')})"]))


RULE_ALERTS_VERSIONED = _versioned()


def one_rule(rule: str) -> str:
    return _enriched(_rule_alerts("enr", rule))


BYPASS = _with(["raw_txn"], _CANON, body=_bypass("canon"))
STREAM_ALERTS = _with(["raw_txn"], _CANON, body="\nUNION ALL\n".join([_rule_alerts("canon", "CTR-001"), _rule_alerts("canon", "SAR-003"), _bypass("canon")]))
_OPS = {
    "OP-GTE": "amount_usd >= 7500", "OP-GT": "amount_usd > 7500", "OP-LTE": "amount_usd <= 120", "OP-LT": "amount_usd < 120",
    "OP-EQ": "channel = 'ATM'", "OP-NEQ": "channel <> 'ATM'", "OP-EQ-TEXT": "CAST(amount_usd AS VARCHAR) = '655'", "OP-LT-TEXT": "channel < 'B'",
    "OP-IN": "country_dst IN ('IR','KP')", "OP-NOT-IN": "country_dst NOT IN ('IR','KP','US')", "OP-IN-SCALAR": "FALSE",
    "OP-NOT-IN-SCALAR": "country_dst IS NOT NULL", "OP-UNKNOWN": "FALSE", "OP-MISSING": "FALSE",
    "OP-NULL": "counterparty_id NOT LIKE '%7' AND counterparty_id <> 'CUST-1'", "OP-EMPTY": "TRUE",
    "OP-MAP": "event_id % 3 = 1", "OP-MAP-NUM": "event_id % 2 = 0 AND event_id % 5 >= 3", "OP-MAP-ABSENT": "event_id % 3 = 2",
    "OP-MAP-UNKNOWN": "FALSE", "OP-MAP-OTHER": "FALSE",
}
OPS_MATRIX = _with(["txn"], body="\nUNION ALL\n".join([
    *(f"SELECT txn_id, '{r}' AS rule_id, 'Rule {r} triggered' AS rule_desc FROM txn WHERE {w}" for r, w in _OPS.items()),
    """SELECT txn_id, 'OP-MAP-TEXT', concat('4 by ', CASE event_id % 3 WHEN 1 THEN 'mobile' WHEN 2 THEN 'desktop' ELSE '${metadata.device}' END, ', ${metadata.none}')
 FROM txn WHERE event_id % 2 = 0 AND event_id % 5 = 4"""]))
NESTED = _with(["txn"], body="""SELECT txn_id, customer_id, 'MIX-001' AS rule_id, 'CRITICAL' AS severity, concat('MIX: ', customer_id, ' ', channel) AS rule_desc,
 CAST(1.0 AS FLOAT) AS score FROM txn WHERE (channel = 'SWIFT' OR country_dst IN ('IR','KP')) AND amount_usd >= 3000 AND direction <> 'INBOUND'""")
SAR002_HISTORICAL = _with(["txn"], f"c AS (SELECT txn_id, customer_id, ts, {_roll(['1h'], 'n')} FROM txn)",
                          "h AS (SELECT customer_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hr, count(*) AS n FROM txn GROUP BY ALL)",
                          """b AS (SELECT a.customer_id, a.hr, sum(p.n) / least(720, a.hr - 1 - (SELECT min(f.hr) FROM h f WHERE f.customer_id = a.customer_id)) AS mean_hourly
 FROM h a JOIN h p ON p.customer_id = a.customer_id AND p.hr BETWEEN a.hr - 721 AND a.hr - 2 GROUP BY a.customer_id, a.hr)""",
                          body="""SELECT txn_id, c.customer_id, txn_count_1h, round(mean_hourly, 6) AS mean_hourly FROM c
 LEFT JOIN b ON b.customer_id = c.customer_id AND b.hr = CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) WHERE txn_count_1h >= coalesce(mean_hourly, 1e0) * 5e0""")
SAR004_FLOW = _with(["txn"], """f AS (SELECT customer_id, txn_id, ts, direction, amount_usd AS a, row_number() OVER (PARTITION BY customer_id ORDER BY ts, direction, txn_id) AS i,
 sum(CASE WHEN direction = 'INBOUND' THEN amount_usd ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY ts, direction, txn_id) AS d,
 sum(CASE WHEN direction = 'OUTBOUND' THEN amount_usd ELSE 0 END) OVER (PARTITION BY customer_id ORDER BY ts, direction, txn_id) AS w
 FROM txn WHERE direction IN ('INBOUND', 'OUTBOUND') AND amount_usd > 0)""",
                    "g AS (SELECT *, w + least(0, min(d - w) OVER (PARTITION BY customer_id ORDER BY i)) AS m FROM f)",
                    "q AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY customer_id ORDER BY i), 0) AS m0 FROM g)",
                    """p AS (SELECT i.customer_id, i.txn_id AS deposit_id, o.txn_id AS withdrawal_id, i.a AS deposit_amount,
 CAST(least(i.d, o.m) - greatest(i.d - i.a, o.m0) AS DECIMAL(18,2)) AS amount, i.ts AS its, o.ts AS ots
 FROM q i JOIN q o ON o.customer_id = i.customer_id AND i.direction = 'INBOUND' AND o.direction = 'OUTBOUND' AND i.d - i.a < o.m AND o.m0 < i.d AND o.m0 < o.m)""",
                    """k AS (SELECT customer_id, deposit_id, max(deposit_amount) - coalesce(sum(amount) FILTER (WHERE ots < its + INTERVAL '24 hours'), 0) AS kept FROM p GROUP BY ALL)""",
                    body="""SELECT customer_id, deposit_id, withdrawal_id, deposit_amount, amount, CAST(kept AS DECIMAL(18,2)) AS kept,
 CAST(kept AS DOUBLE) < CAST(deposit_amount AS DOUBLE) * 1e-1 AS rapid FROM p JOIN k USING (customer_id, deposit_id)""")
SAR004_RETENTION = _with(["txn"], f"""r AS (SELECT txn_id, customer_id,
 CAST(coalesce(sum(CASE WHEN direction = 'INBOUND' THEN amount_usd END) OVER {_over('24h')}, 0) AS DECIMAL(18,2)) AS in_amount_24h,
 CAST(coalesce(sum(CASE WHEN direction = 'OUTBOUND' THEN amount_usd END) OVER {_over('24h')}, 0) AS DECIMAL(18,2)) AS out_amount_24h FROM txn)""",
                         body="""SELECT * FROM r WHERE in_amount_24h > 0 AND out_amount_24h > 0
 AND (CAST(in_amount_24h AS DOUBLE) - CAST(out_amount_24h AS DOUBLE)) / CAST(in_amount_24h AS DOUBLE) < 1e-1""")
VERSION_ASOF = _with(["txn", "rule_version"], body="""SELECT t.txn_id, v.version_id FROM txn t
ASOF LEFT JOIN (SELECT * FROM rule_version WHERE status = 'ACTIVE') v ON t.ts >= v.effective_from""")

# --- Sanctions ---


def _norm(col: str) -> str:
    return rf"regexp_replace(regexp_replace(lower(trim({col})), '[^a-z0-9\s]', '', 'g'), '\s+', ' ', 'g')"


def _grams(col: str) -> str:
    return f"CASE WHEN length({col}) < 2 THEN [{col}] ELSE [substr({col}, i, 2) FOR i IN range(1, length({col}))] END"


def _candidates(names: str, listed: str = "sanction_name") -> str:
    return f"""listed AS (SELECT *, {_norm('name')} AS norm FROM {listed}),
grams AS (SELECT DISTINCT unnest({_grams('norm')}) AS g FROM listed),
named AS (SELECT DISTINCT name, {_norm('name')} AS norm FROM ({names})),
cand AS (SELECT name, norm FROM named WHERE length(norm) >= 2 AND EXISTS (
 SELECT 1 FROM (SELECT unnest({_grams('named.norm')}) AS x) u JOIN grams ON grams.g = u.x))"""


_BEST = """best AS (SELECT c.name, l.name AS matched_name, l.list_source, l.pos, jaro_winkler_similarity(c.norm, l.norm) AS similarity
 FROM cand c JOIN listed l ON jaro_winkler_similarity(c.norm, l.norm) >= 0.85
 QUALIFY row_number() OVER (PARTITION BY c.name ORDER BY jaro_winkler_similarity(c.norm, l.norm) DESC, l.pos) = 1)"""
_MATCH = "SELECT name, matched_name, list_source, pos, round(similarity, 6) AS similarity FROM best"


def best_match(names: str) -> str:
    views = ["sanction_name"] + (["screen_name"] if names == "screen_name" else [])
    text = names if " " in names else f"SELECT name FROM {names}"
    return _with(views, _candidates(text), _BEST, body=_MATCH)


SANCTION_CANDIDATES = _with(["sanction_name", "screen_name"], _candidates("SELECT name FROM screen_name UNION ALL SELECT c_name FROM customer"),
                            body="SELECT name, norm FROM cand")
_PARTY = ["txn_party", "sanction_name"]
_PARTY_BEST = (_candidates("SELECT counterparty_name AS name FROM txn_party"), _BEST)
SANCTION_ALERTS = _with(_PARTY, *_PARTY_BEST, body="""SELECT sha256(concat_ws('|', t.txn_id, 'SAN-001')) AS alert_id, t.txn_id, t.customer_id, 'SANCTION' AS alert_type,
 'CRITICAL' AS severity, 'SAN-001' AS rule_id, concat('Sanctions match: ''', matched_name, ''' (similarity: ', printf('%.2f', similarity), ')') AS rule_desc,
 round(CAST(similarity AS FLOAT), 4) AS score, 'NEW' AS status, t.ts AS created_at FROM txn_party t JOIN best b ON t.counterparty_name = b.name""")
ALL_ALERTS = _with([*_FEATURE_VIEWS, *_PARTY], _CANON, _PROFILE, _FEATURES, _LOOKUP, _ENRICHED, *_PARTY_BEST,
                   "u AS (" + "\nUNION ALL\n".join([*(_rule_alerts("enr", r) for r in _RULES), _bypass("enr"), _alert(
                       "(SELECT n.*, b.matched_name, b.similarity FROM canon n JOIN txn_party t ON n.txn_id = t.txn_id JOIN best b ON t.counterparty_name = b.name)", "SAN-001", "SANCTION",
                       "CRITICAL", "similarity", "concat('Sanctions match: ''', matched_name, ''' (similarity: ', printf('%.2f', similarity), ')')", "TRUE")]) + ")",
                   body="SELECT * REPLACE (round(score, 4) AS score) FROM u")
SANCTION_HITS = _with(_PARTY, *_PARTY_BEST, body="""SELECT t.txn_id, t.customer_id, t.counterparty_id, matched_name, list_source, round(similarity, 6) AS similarity,
 t.ts AS created_at FROM txn_party t JOIN best b ON t.counterparty_name = b.name""")
SANCTION_EXACT = _with(["screen_name", "sanction_name"], body=f"""SELECT name, {_norm('name')} AS norm FROM screen_name
WHERE {_norm('name')} IN (SELECT {_norm('name')} FROM sanction_name)""")
SANCTION_LEVENSHTEIN = _with(["screen_name", "sanction_name"], body=f"""SELECT s.name, l.name AS matched_name, l.pos, levenshtein({_norm('s.name')}, {_norm('l.name')}) AS distance
FROM screen_name s JOIN sanction_name l ON levenshtein({_norm('s.name')}, {_norm('l.name')}) <= 2""")
SANCTION_MERGED = _with(["screen_name", "sanction_name"], body=f"""SELECT norm, pos, name, list_source FROM (
 SELECT {_norm('name')} AS norm, pos, name, list_source, 0 AS src FROM sanction_name UNION ALL SELECT {_norm('name')}, 0, name, 'LIST-B', 1 FROM screen_name)
QUALIFY row_number() OVER (PARTITION BY norm ORDER BY src, pos, name) = 1""")
SANCTION_ALIASES = _with(["screen_name", "sanction_name"], """all_names AS (SELECT pos, name, list_source FROM sanction_name UNION ALL
 SELECT pos, array_to_string(list_reverse(string_split(name, ' ')), ' '), list_source FROM sanction_name)""",
                         """firsts AS (SELECT norm0, pos, name, list_source FROM (SELECT *, """ + _norm("name") + """ AS norm0 FROM all_names)
 QUALIFY row_number() OVER (PARTITION BY norm0 ORDER BY pos, name) = 1)""",
                         _candidates("SELECT name FROM screen_name", "firsts"), """tied AS (SELECT c.name, l.name AS matched_name, l.list_source, l.pos,
 jaro_winkler_similarity(c.norm, l.norm) AS similarity FROM cand c JOIN listed l ON jaro_winkler_similarity(c.norm, l.norm) >= 0.85)""",
                         """best AS (SELECT * FROM tied QUALIFY row_number() OVER (PARTITION BY name ORDER BY similarity DESC, pos, matched_name) = 1)""", body=_MATCH)

# --- Alerts ---

_RANK = "CASE severity WHEN 'LOW' THEN 0 WHEN 'MEDIUM' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'CRITICAL' THEN 3 ELSE -1 END"
_RANK_NAME = "CASE max({r}) WHEN 3 THEN 'CRITICAL' WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END"
_FIRST = """arg_min(rule_desc, {{'a': created_at, 'b': alert_id}}) AS rule_desc, max(score) AS score, arg_min(alert_id, {{'a': created_at, 'b': alert_id}}) AS alert_id, arg_min(txn_id, {{'a': created_at, 'b': alert_id}}) AS txn_id,
 arg_min(alert_type, {{'a': created_at, 'b': alert_id}}) AS alert_type, {name} AS severity, 'NEW' AS status, min(created_at) AS created_at, count(*) AS alert_count""".format(
    name=_RANK_NAME.format(r=_RANK))
_SLOT = "time_bucket(INTERVAL '30 minutes', created_at, TIMESTAMP '1970-01-01')"
_TUMBLING = f"""SELECT customer_id, rule_id, {_SLOT} AS window_start, {_SLOT} + INTERVAL '30 minutes' AS window_end, {_FIRST} FROM alert_seed a GROUP BY 1, 2, 3, 4"""
# The aggregate alias created_at shadows the column inside arg_min keys, so the source is renamed first.
DEDUP_TUMBLING = _with(["alert_seed"], body=_TUMBLING.replace("created_at", "a.created_at").replace("AS a.created_at", "AS created_at"))
DEDUP_TUMBLING_CLOSED = _with(["alert_seed"], f"d AS ({_TUMBLING.replace('created_at', 'a.created_at').replace('AS a.created_at', 'AS created_at')})",
                              body="SELECT * FROM d WHERE window_end <= (SELECT max(created_at) FROM alert_seed) - INTERVAL '30 minutes'")
_ANCHORED = ("""anchors AS (SELECT customer_id, rule_id, min(created_at) AS a FROM alert_seed GROUP BY 1, 2
 UNION ALL SELECT n.customer_id, n.rule_id, min(s.created_at) FROM anchors n JOIN alert_seed s ON s.customer_id = n.customer_id AND s.rule_id = n.rule_id
 AND s.created_at >= n.a + INTERVAL '31 minutes' GROUP BY 1, 2)""",
             """placed AS (SELECT s.*, n.a FROM alert_seed s ASOF JOIN anchors n ON s.customer_id = n.customer_id AND s.rule_id = n.rule_id AND s.created_at >= n.a)""")
_GROUPS = f"SELECT customer_id, rule_id, {_FIRST} FROM placed a GROUP BY customer_id, rule_id, a.a".replace("created_at", "a.created_at").replace("AS a.created_at", "AS created_at")
DEDUP_ANCHORED = _with(["alert_seed"], *_ANCHORED, body=_GROUPS, recursive=True)
# groups whose end the last watermark has passed; no alert of one batch is late
DEDUP_ANCHORED_CLOSED = _with(["alert_seed"], *_ANCHORED, f"d AS ({_GROUPS})", recursive=True, body="""SELECT *, FALSE AS late FROM d
 WHERE created_at + INTERVAL '31 minutes' <= (SELECT max(created_at) FROM alert_seed) - INTERVAL '30 minutes'""")


def _correlation(party: str) -> str:
    return f"""SELECT {party}, count(*) AS alert_count, count(DISTINCT rule_id) AS rule_count,
 array_to_string(list_sort(list(DISTINCT rule_id)), ',') AS rules, {_RANK_NAME.format(r=_RANK)} AS worst_severity,
 min(created_at) AS first_at, max(created_at) AS last_at"""


CORRELATION = _with(["alert_seed"], body=_correlation("customer_id") + " FROM alert_seed GROUP BY customer_id")
CORRELATION_PARTY = _with(["alert_seed", "txn"], body=_correlation("counterparty_id") + """ FROM (SELECT a.*, t.counterparty_id FROM alert_seed a LEFT JOIN txn t USING (txn_id))
GROUP BY counterparty_id""")


def _queue(col: str) -> str:
    return f"CASE {col} WHEN 'CRITICAL' THEN 1 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 3 ELSE 4 END"


ALERT_QUEUE = _with(["alert_seed"], body=f"""SELECT row_number() OVER (ORDER BY {_queue('severity')}, created_at, alert_id) AS rank, alert_id, severity, created_at
FROM alert_seed WHERE status = 'NEW'""")
ALERT_TOP10 = _with(["alert_seed"], body=f"SELECT alert_id, severity, created_at FROM alert_seed WHERE status = 'NEW' ORDER BY {_queue('severity')}, created_at, alert_id LIMIT 10")
ALERT_COUNTS = _with(["alert_seed"], body="SELECT status, severity, count(*) AS n FROM alert_seed GROUP BY ALL")
ALERTS_SELECTED = _with(["alert_seed"], body="SELECT alert_id, customer_id, rule_id, created_at FROM alert_seed WHERE status = 'NEW' AND severity = 'CRITICAL'")
ALERT_ACTIONS = _with(["alert_seed", "alert_action"], """act AS (SELECT * FROM alert_action WHERE action IN ('CONFIRM','CLOSE','ESCALATE','REPORT')),
last AS (SELECT alert_id, arg_max(CASE action WHEN 'CLOSE' THEN 'CLOSED' WHEN 'REPORT' THEN 'REPORTED' ELSE 'ESCALATED' END, seq) AS st, arg_max(action_at, seq) AS at FROM act GROUP BY 1),
rev AS (SELECT alert_id, arg_max(reviewer_id, seq) AS reviewer_id, arg_max(notes, seq) AS notes FROM act WHERE action <> 'REPORT' GROUP BY 1)""",
                      body="""SELECT a.alert_id, coalesce(l.st, a.status) AS status, r.reviewer_id, r.notes, coalesce(l.at, a.created_at) AS updated_at
FROM alert_seed a LEFT JOIN last l USING (alert_id) LEFT JOIN rev r USING (alert_id)""")
ALERT_ACTION_REJECTS = _with(["alert_seed", "alert_action"], body="""SELECT c.alert_id, CAST(c.seq AS BIGINT) AS seq, c.action,
 CASE WHEN a.alert_id IS NULL THEN 'UNKNOWN_ALERT' ELSE 'UNKNOWN_ACTION' END AS reason
FROM alert_action c LEFT JOIN alert_seed a USING (alert_id)
WHERE a.alert_id IS NULL OR c.action NOT IN ('CONFIRM','CLOSE','ESCALATE','REPORT')""")
ALERT_ASSIGNMENT = _with(["alert_seed"], body="""SELECT alert_id, concat_ws('-', lower(alert_type), lower(severity)) AS team,
 CASE WHEN status = 'NEW' AND severity = 'LOW' THEN 'CLOSED' ELSE status END AS status FROM alert_seed""")
ALERT_TIMELINE = _with(["alert_seed", "txn"], body="""SELECT a.alert_id, t.customer_id, t.txn_id, t.ts, t.amount_usd, epoch_us(t.ts) - epoch_us(a.created_at) AS offset_us
FROM alert_seed a JOIN txn t ON a.customer_id = t.customer_id AND t.ts BETWEEN a.created_at - INTERVAL '2 hours' AND a.created_at + INTERVAL '2 hours'""")
SLA = _with(["alert_seed"], f"""aged AS (SELECT *, (epoch_us(TIMESTAMP '{SLA_NOW}') - epoch_us(created_at)) // 60000000 AS m FROM alert_seed WHERE status = 'NEW'),
acted AS (SELECT *, CASE WHEN (severity = 'CRITICAL' AND m > 30) OR (severity = 'HIGH' AND m > 120) THEN 'ESCALATE'
 WHEN (severity = 'CRITICAL' AND m > 15) OR (severity = 'HIGH' AND m > 60) OR (severity = 'MEDIUM' AND m > 480) THEN 'REMIND' END AS sla_action FROM aged)""",
            body="""SELECT alert_id, severity, CASE sla_action WHEN 'ESCALATE' THEN 'ESCALATED' ELSE status END AS status, m AS minutes, sla_action,
 CASE sla_action WHEN 'ESCALATE' THEN concat('Auto-escalated by SLA timer: ', severity, ' alert overdue by ', m - CASE severity WHEN 'CRITICAL' THEN 30 ELSE 120 END, ' minutes') END AS sla_note
FROM acted WHERE sla_action IS NOT NULL""")

# --- Customers ---

PROFILE = _with(["txn"], _PROFILE, body="SELECT * FROM profile")
RISK_LEVELS = _with(["txn", "customer_entity", "alert_seed"], _PROFILE, _FEATURES, body="""SELECT customer_id, risk_level, risk_score, txn_count_7d, txn_count_30d, total_amount_7d,
 total_amount_30d, avg_amount, max_amount, unique_counterparties_30d, alert_count_total, kyc_status, open_alert_count FROM features""")
_FACTOR = """round(least(1e0, greatest(0e0, (CASE nationality WHEN 'IR' THEN 1e0 WHEN 'KP' THEN 1e0 WHEN 'SY' THEN 9e-1 WHEN 'CU' THEN 8e-1 WHEN 'US' THEN 1e-1
 WHEN 'GB' THEN 1e-1 WHEN 'DE' THEN 1e-1 WHEN 'FR' THEN 1e-1 ELSE 5e-1 END) * 3e-1 + (CASE kyc_level WHEN 'ENHANCED' THEN 7e-1 ELSE 3e-1 END) * 25e-2
 + (CASE customer_type WHEN 'PEP' THEN 9e-1 WHEN 'CORPORATE' THEN 5e-1 ELSE 2e-1 END) * 25e-2 + least(txn_count_30d / 100e0, 2e0) * 2e-1)), 6)"""
RISK_COMPOSITE = _with(["txn", "customer_entity", "alert_seed"], _PROFILE, _FEATURES, f"s AS (SELECT customer_id, {_FACTOR} AS score FROM features)",
                       body=f"SELECT customer_id, score, {_level('score')} AS level FROM s")
SNAPSHOT = _with(["txn", "customer_entity", "alert_seed"], _PROFILE, _FEATURES, body=f"""SELECT e.customer_id, e.name, e.customer_type, coalesce(f.risk_level, 'UNKNOWN') AS risk_level,
 coalesce(f.risk_score, 0) AS risk_score, coalesce(f.txn_count_30d, 0) AS txn_count_30d, coalesce(f.alert_count_total, 0) AS alert_count_total, '{AS_OF}' AS dt
FROM customer_entity e LEFT JOIN features f USING (customer_id)""")


def _status(now: str) -> str:
    return f"""CASE WHEN next_review_date IS NULL THEN 'DUE' WHEN TIMESTAMP '{now}' > next_review_date THEN 'OVERDUE'
 WHEN TIMESTAMP '{now}' + INTERVAL '30 days' > next_review_date THEN 'DUE' ELSE 'CURRENT' END"""


def _next(level: str, at: str) -> str:
    return f"""{at} + INTERVAL '1 month' * (CASE WHEN {level} IS NULL THEN 12 WHEN {level} IN ('HIGH','PROHIBITED') THEN 3 WHEN {level} = 'MEDIUM' THEN 12 ELSE 24 END)"""


_AT = f"TIMESTAMP '{NOW}'"
KYC_REVIEW = _with(["kyc_seed"], body=f"SELECT customer_id, risk_level, {_status(NOW)} AS review_status, {_next('risk_level', _AT)} AS following_review FROM kyc_seed")
KYC_OVERDUE = _with(["kyc_seed"], f"k AS (SELECT *, {_status('2024-01-20 00:00:00')} AS review_status FROM kyc_seed)",
                    body=f"SELECT customer_id, next_review_date, review_status FROM k WHERE next_review_date <= TIMESTAMP '{NOW}' AND review_status <> 'OVERDUE'")
KYC_HIGH = _with(["kyc_seed"], body="""SELECT row_number() OVER (ORDER BY risk_points DESC NULLS LAST, customer_id) AS rank, customer_id, risk_points
FROM kyc_seed WHERE risk_level = 'HIGH'""")
KYC_COUNTS = _with(["kyc_seed"], body=f"SELECT risk_level, {_status(NOW)} AS review_status, count(*) AS n FROM kyc_seed GROUP BY ALL")
KYC_CHANGES = _with(["kyc_seed", "kyc_change"], """step0 AS (SELECT customer_id, risk_level, risk_points, next_review_date, CAST(NULL AS TIMESTAMP) AS last_review_date,
 CAST(NULL AS TIMESTAMP) AS updated_at FROM kyc_seed)""", *[f"""step{i} AS (SELECT s.customer_id, coalesce(c.risk_level, s.risk_level) AS risk_level, coalesce(c.risk_points, s.risk_points) AS risk_points,
 CASE WHEN c.change IN ('RISK','REVIEW') OR (c.change = 'UPSERT' AND s.next_review_date IS NULL) THEN {_next('coalesce(c.risk_level, s.risk_level)', 'c.change_at')} ELSE s.next_review_date END AS next_review_date,
 CASE c.change WHEN 'REVIEW' THEN c.change_at ELSE s.last_review_date END AS last_review_date, coalesce(c.change_at, s.updated_at) AS updated_at
FROM step{i - 1} s LEFT JOIN (SELECT * FROM kyc_change WHERE seq = {i}) c USING (customer_id))""" for i in (1, 2)], body="SELECT * FROM step2")
KYC_TRIGGERS = _with(["txn"], _PROFILE, body="""SELECT customer_id, txn_count_7d, txn_count_30d FROM profile
WHERE txn_count_7d / 7e0 >= txn_count_30d / 30e0 * 12e-1""")

# --- Cases and reports ---

CASE_QUEUE = _with(["case_seed"], body=f"""SELECT row_number() OVER (ORDER BY {_queue('priority')}, created_at, case_id) AS rank, case_id, priority, created_at
FROM case_seed WHERE status IN ('OPEN','INVESTIGATING')""")
_CASES = """folded AS (SELECT case_id, arg_max(customer_id, seq) AS customer_id, arg_max(priority, seq) AS priority,
 arg_max(st, seq) AS status, arg_max(actor, seq) FILTER (WHERE event = 'ASSIGN') AS assigned_to, arg_max(actor, seq) FILTER (WHERE event = 'CREATE') AS created_by,
 arg_max(nt, seq) AS notes, arg_max(resolution, seq) AS resolution, arg_max(linked_alert_ids, seq) AS linked_alert_ids,
 max(event_at) FILTER (WHERE event = 'CREATE') AS created_at, arg_max(event_at, seq) AS updated_at,
 arg_max(event_at, seq) FILTER (WHERE event = 'UPDATE' AND resolution IS NOT NULL) AS closed_at
FROM (SELECT *, CASE WHEN event = 'CREATE' THEN 'OPEN' WHEN event = 'ASSIGN' THEN 'INVESTIGATING' WHEN event = 'ESCALATE' THEN 'ESCALATED'
 WHEN resolution IS NOT NULL THEN 'CLOSED' ELSE status END AS st, CASE WHEN event = 'ESCALATE' THEN concat('ESCALATED: ', notes) ELSE notes END AS nt FROM case_event) GROUP BY case_id)"""
CASE_EVENTS = _with(["case_event"], _CASES, body="SELECT * FROM folded")
CASE_LINKED = _with(["case_event", "alert_seed"], _CASES, body="""SELECT l.case_id, a.alert_id, a.severity, a.rule_id
FROM (SELECT case_id, trim(unnest(string_split(linked_alert_ids, ','))) AS aid FROM folded) l JOIN alert_seed a ON l.aid = a.alert_id""")
CASE_COUNTS = _with(["case_seed"], body="SELECT status, assigned_to, count(*) AS n FROM case_seed GROUP BY ALL")
CASES_SELECTED = _with(["case_seed"], body="SELECT case_id, customer_id, priority FROM case_seed WHERE status = 'OPEN' AND assigned_to = 'analyst3'")
DAILY_SUMMARY = _with(["txn", "alert_seed"], """v AS (SELECT CAST(ts AS DATE) AS report_date, count(*) AS total_transactions, CAST(sum(amount_usd) AS DECIMAL(18,2)) AS total_amount,
 count(DISTINCT customer_id) AS unique_customers FROM txn GROUP BY 1),
h AS (SELECT CAST(t.ts AS DATE) AS report_date, count(*) FILTER (WHERE alert_type = 'CTR') AS ctr_count, count(*) FILTER (WHERE alert_type = 'SAR') AS sar_count
 FROM txn t JOIN alert_seed a USING (txn_id) GROUP BY 1)""", body="""SELECT report_date, total_transactions, total_amount, unique_customers,
 coalesce(ctr_count, 0) AS ctr_count, coalesce(sar_count, 0) AS sar_count FROM v LEFT JOIN h USING (report_date)""")
CTR_EXTRACT = _with(["txn", "alert_seed"], body="""SELECT a.alert_id, a.txn_id, a.customer_id, t.amount, t.currency, t.channel, a.created_at,
 strftime(a.created_at, '%Y-%m-%d') AS dt FROM alert_seed a LEFT JOIN txn t USING (txn_id) WHERE a.alert_type = 'CTR'""")
SAR_EXTRACT = _with(["alert_seed"], body="""SELECT alert_id, txn_id, customer_id, severity, created_at, strftime(created_at, '%Y-%m-%d') AS dt
FROM alert_seed WHERE alert_type = 'SAR' AND status = 'REPORTED'""")
CTR_EVENTS = _with(["txn", "alert_seed"], body="""SELECT a.alert_id AS ctr_id, a.txn_id, a.customer_id, a.created_at, t.amount, t.currency, t.channel
FROM alert_seed a LEFT JOIN txn t USING (txn_id) WHERE a.alert_type = 'CTR'""")
_REPORT_ROWS = """rr AS (SELECT concat(a.alert_type, '-<', a.txn_id, '>') AS report_id, a.alert_type, a.customer_id, t.amount, t.currency, t.channel, a.created_at,
 strftime(a.created_at, '%Y-%m-%d') AS dt FROM alert_seed a LEFT JOIN txn t USING (txn_id) WHERE a.alert_type = 'CTR' OR (a.alert_type = 'SAR' AND a.status = 'REPORTED'))"""


def _xml(col: str) -> str:
    out = f"coalesce(CAST({col} AS VARCHAR), '')"
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&apos;")):
        out = f"replace({out}, '{raw}', '{entity}')"
    return out


def report_xml(layout: str) -> str:
    esc = _xml
    tail = f"'      <Channel>', {esc('channel')}, '</Channel>'" if layout == "channel" else f"'      <Date>', {esc('dt')}, '</Date>'"
    nl = ", chr(10), "
    lines = ["""'<?xml version="1.0" encoding="UTF-8"?>'""", """'<FATFReport xmlns="urn:fatf:report:1.0">'""", "'  <ReportHeader>'",
             f"'    <ReportType>', {esc('alert_type')}, '</ReportType>'", f"'    <ReportId>', {esc('report_id')}, '</ReportId>'", "'    <SubmissionDate>2024-02-01</SubmissionDate>'",
             "'  </ReportHeader>'", "'  <ReportBody>'", "'    <Subject>'", f"'      <CustomerId>', {esc('customer_id')}, '</CustomerId>'", "'    </Subject>'",
             "'    <Transaction>'", f"""'      <Amount currency="', {esc('currency')}, '">', {esc('amount')}, '</Amount>'""", tail, "'    </Transaction>'",
             "'  </ReportBody>'", "'</FATFReport>'"]
    return _with(["txn", "alert_seed"], _REPORT_ROWS, body=f"SELECT report_id, concat({nl.join(lines)}) AS content FROM rr")


SUMMARY_JSON = _with(["txn", "alert_seed"], _REPORT_ROWS, """k AS (SELECT *, CAST(created_at AS DATE) AS report_date,
 row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, report_id) AS rn, count(*) OVER (PARTITION BY CAST(created_at AS DATE)) AS total FROM rr)""",
                     body="""SELECT report_date, (rn - 1) // 25 AS part, count(*) AS reports,
 concat(CASE WHEN (rn - 1) // 25 = 0 THEN concat('{"report_type":"SUMMARY","generated_at":"', report_date, '","total_count":', any_value(total), ',"reports":[') ELSE ',' END,
 string_agg(concat('{"id":"', report_id, '","customer":"', customer_id, '","amount":', amount, '}'), ',' ORDER BY rn),
 CASE WHEN (rn - 1) // 25 = (any_value(total) - 1) // 25 THEN ']}' ELSE '' END) AS content FROM k GROUP BY report_date, (rn - 1) // 25""")
_REPORTS = """st AS (SELECT report_id, max(report_type) FILTER (WHERE event = 'GENERATE') AS report_type, max(customer_id) FILTER (WHERE event = 'GENERATE') AS customer_id,
 arg_max(CASE event WHEN 'GENERATE' THEN 'PENDING_SUBMISSION' WHEN 'SUBMIT' THEN 'SUBMITTED' ELSE status END, seq) AS status,
 arg_max(submission_id, seq) AS submission_id, arg_max(actor, seq) FILTER (WHERE event = 'SUBMIT') AS submitted_by,
 max(event_at) FILTER (WHERE event = 'SUBMIT') AS submitted_at, max(event_at) FILTER (WHERE event = 'GENERATE') AS generated_at FROM report_event GROUP BY 1)"""
REPORT_STATUS = _with(["report_event"], _REPORTS, body="SELECT * FROM st")
REPORTS_PENDING = _with(["report_event"], _REPORTS, body="SELECT report_id, report_type, customer_id FROM st WHERE status = 'PENDING_SUBMISSION'")

# --- Reconciliation ---

_BATCH = """busy AS (SELECT customer_id, CAST(ts AS DATE) AS d FROM txn GROUP BY 1, 2 HAVING count(*) >= 5 AND max(amount_usd) < 10000 AND sum(amount_usd) >= 15000),
batch AS (SELECT * FROM (SELECT t.txn_id, CASE WHEN t.amount_usd >= 10000 AND t.channel IN ('ATM','BRANCH') THEN 'CTR' WHEN b.d IS NOT NULL THEN 'SAR' END AS alert_type,
 t.ts AS created_at, CAST(t.ts AS DATE) AS report_date FROM txn t LEFT JOIN busy b ON t.customer_id = b.customer_id AND CAST(t.ts AS DATE) = b.d) WHERE alert_type IS NOT NULL)"""
BATCH_ALERTS = _with(["txn"], _BATCH, body="SELECT txn_id, alert_type, concat(alert_type, '-001') AS rule_id, created_at, report_date FROM batch")
_REALTIME = f"""nt AS ({_normalized('txn')}), rt0 AS (SELECT *, {_roll(['24h'], 'nsm')} FROM nt),
realtime AS (SELECT txn_id, alert_type, CAST(created_at AS DATE) AS report_date FROM ({_rule_alerts('rt0', 'CTR-001')} UNION ALL {_rule_alerts('rt0', 'SAR-001')} UNION ALL {_bypass('rt0')}))"""
_COMPARED = """cmp AS (SELECT report_date, txn_id, alert_type, max(b) AS b, max(r) AS r FROM (
 SELECT report_date, txn_id, alert_type, 1 AS b, 0 AS r FROM batch UNION ALL SELECT report_date, txn_id, alert_type, 0, 1 FROM realtime) GROUP BY 1, 2, 3)"""
RECONCILIATION = _with(["txn"], _BATCH, _REALTIME, _COMPARED, body="""SELECT report_date, CAST(sum(b) AS BIGINT) AS batch_alerts, CAST(sum(r) AS BIGINT) AS realtime_alerts,
 CAST(sum(b * (1 - r)) AS BIGINT) AS missing_in_realtime, CAST(sum(r * (1 - b)) AS BIGINT) AS extra_in_realtime,
 round(CASE WHEN sum(b) > 0 THEN sum(b * (1 - r)) / CAST(sum(b) AS DOUBLE) ELSE 0e0 END, 6) AS diff_rate,
 CASE WHEN sum(b) > 0 THEN sum(b * (1 - r)) / CAST(sum(b) AS DOUBLE) ELSE 0e0 END > 1e-3 AS exceeds FROM cmp GROUP BY 1""")
RECON_MISSING = _with(["txn"], _BATCH, _REALTIME, body="SELECT txn_id, alert_type FROM batch EXCEPT SELECT txn_id, alert_type FROM realtime")
RECON_EXTRA = _with(["txn"], _BATCH, _REALTIME, body="SELECT txn_id, alert_type FROM realtime EXCEPT SELECT txn_id, alert_type FROM batch")

# --- Tracing and routing ---


def _walk(starts: str, hops: int, near: str = "customer_id", far: str = "counterparty_id") -> tuple[str, ...]:
    return (f"""edges AS (SELECT {near} AS node, {far} AS party, txn_id, amount_usd, row_number() OVER (PARTITION BY {near} ORDER BY amount_usd DESC, txn_id) AS rn,
 count(*) OVER (PARTITION BY {near}) > 100 AS truncated FROM txn WHERE {near} IS NOT NULL AND {far} IS NOT NULL QUALIFY rn <= 100)""",
            """adj AS (SELECT node, list({'party': party, 'txn_id': txn_id, 'amount_usd': amount_usd, 'truncated': truncated} ORDER BY rn) AS es FROM
 (SELECT *, row_number() OVER (PARTITION BY node, party ORDER BY rn) AS nth FROM edges) WHERE nth = 1 GROUP BY 1)""",
            f"""walk AS (SELECT customer_id AS start_id, 0 AS hop, customer_id AS node_at, [customer_id] AS seen,
 CAST([] AS STRUCT(party VARCHAR, txn_id VARCHAR, amount_usd DECIMAL(18,2), truncated BOOLEAN)[]) AS found FROM ({starts})
 UNION ALL SELECT start_id, hop + 1, fresh[1].party, list_concat(seen, [x.party FOR x IN fresh]), fresh
 FROM (SELECT w.start_id, w.hop, w.seen, [x FOR x IN a.es IF NOT list_contains(w.seen, x.party)] AS fresh FROM walk w JOIN adj a ON w.node_at = a.node WHERE w.hop < {hops}) WHERE len(fresh) > 0)""")


_TRACED = """SELECT start_id, CAST(hop AS BIGINT) AS hop, e.party AS party, e.txn_id AS txn_id, e.amount_usd AS amount_usd, e.truncated AS truncated
FROM (SELECT start_id, hop, unnest(found) AS e FROM walk WHERE hop > 0)"""


def trace(forward: bool) -> str:
    near, far = ("customer_id", "counterparty_id") if forward else ("counterparty_id", "customer_id")
    return _with(["txn"], *_walk("SELECT DISTINCT customer_id FROM txn", 5, near, far), body=_TRACED, recursive=True)


TRACE_ALERTED = _with(["txn", "alert_seed"], *_walk("SELECT DISTINCT customer_id FROM alert_seed WHERE severity IN ('MEDIUM','HIGH','CRITICAL')", 5),
                      body=_TRACED, recursive=True)
HOT = _with(["txn"], body="SELECT customer_id, CAST(ts AS DATE) AS day, count(*) AS txn_count FROM txn GROUP BY 1, 2 HAVING count(*) > 10")
HOT_ROUTES = _with(["raw_txn"], _CANON, "hot AS (SELECT customer_id, CAST(ts AS DATE) AS day FROM canon GROUP BY 1, 2 HAVING count(*) > 10)",
                   body="""SELECT CASE WHEN h.day IS NOT NULL AND c.route_tag = 'MAIN' THEN 'BYPASS_HOT' ELSE c.route_tag END AS route_tag, c.customer_id, count(*) AS n
FROM canon c LEFT JOIN hot h ON c.customer_id = h.customer_id AND CAST(c.ts AS DATE) = h.day GROUP BY ALL""")
BATCH_DEPOSITS = _with(["txn"], body="""SELECT customer_id, counterparty_id, CAST(ts AS DATE) AS day, count(*) AS txn_count, CAST(sum(amount_usd) AS DECIMAL(18,2)) AS total_amount,
 min(ts) AS first_ts, max(ts) AS last_ts, concat_ws('|', customer_id, counterparty_id, CAST(CAST(ts AS DATE) AS VARCHAR)) AS batch_id
FROM txn GROUP BY 1, 2, 3 HAVING count(*) > 1""")
STREAM_JSON = _with(["txn"], body="SELECT txn_id, customer_id, amount_usd, channel FROM txn")
KYC_CHANGE_REJECTS = _with(["kyc_seed", "kyc_change"], "p AS (SELECT customer_id FROM kyc_seed WHERE next_review_date IS NOT NULL)",
                           body="""SELECT customer_id, seq, change, risk_level, risk_points, change_at FROM kyc_change c WHERE change <> 'UPSERT'
 AND customer_id NOT IN (SELECT customer_id FROM p) AND NOT EXISTS (SELECT 1 FROM kyc_change u WHERE u.customer_id = c.customer_id AND u.change = 'UPSERT')""")
_KEY = _norm("name")
SANCTION_SET = _with(["sanction_name", "screen_name"], f"""s AS (SELECT {_KEY} AS norm FROM sanction_name GROUP BY 1 HAVING bool_or(pos % 4 = 0) OR NOT bool_or(pos % 2 = 0)
 UNION SELECT {_KEY} FROM screen_name)""", "p AS (SELECT p_name AS name FROM part UNION SELECT c_name FROM customer)",
                     body=f"SELECT name, {_KEY} AS norm FROM p WHERE {_KEY} IN (SELECT norm FROM s)")
