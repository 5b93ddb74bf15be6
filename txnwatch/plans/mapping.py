"""Transaction-monitoring views over the supplied TPC-H-like tables.

One SQL text per view; ``{k}`` is the JSON access that differs between engines, ``{name}`` another view.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

BASE = ("customer", "part", "orders", "events")

VIEWS = {
    "txn": """
SELECT event_id,
 concat('TXN-', CAST(event_id AS VARCHAR(20))) AS txn_id,
 CASE event_type WHEN 'click' THEN 'CARD' WHEN 'view' THEN 'CARD' WHEN 'purchase' THEN 'TRANSFER' WHEN 'signup' THEN 'FOREX' ELSE 'REFUND' END AS txn_type,
 ts,
 CAST(CAST(value AS DECIMAL(18,2)) * 100 AS DECIMAL(18,2)) AS amount,
 CASE event_id % 10 WHEN 0 THEN 'eur' WHEN 1 THEN 'XXX' ELSE 'USD' END AS currency,
 CAST(CAST(value AS DECIMAL(18,2)) * 100 * CASE WHEN event_id % 10 = 0 THEN 1.08 ELSE 1.00 END AS DECIMAL(18,2)) AS amount_usd,
 CASE WHEN event_id % 97 = 0 THEN 'SIDEWAYS' WHEN event_id % 3 = 0 THEN 'INBOUND' ELSE 'OUTBOUND' END AS direction,
 concat('CUST-', CAST(CASE WHEN user_id % 5 = 0 THEN user_id % 25 ELSE user_id END AS VARCHAR(20))) AS customer_id,
 concat('CUST-', {k}) AS counterparty_id,
 CASE event_id % 4 WHEN 0 THEN 'ATM' WHEN 1 THEN 'ONLINE' WHEN 2 THEN 'BRANCH' ELSE 'SWIFT' END AS channel,
 CASE user_id % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR' ELSE 'NL' END AS country_src,
 CASE CAST({k} AS INT) % 10 WHEN 0 THEN 'IR' WHEN 1 THEN 'KP' WHEN 2 THEN 'SY' WHEN 3 THEN 'CU' WHEN 4 THEN 'GB' WHEN 5 THEN 'DE' WHEN 6 THEN 'FR' WHEN 7 THEN 'MM' ELSE 'US' END AS country_dst
FROM {events}""",
    "raw_txn": """
SELECT CASE WHEN event_id % 101 = 50 THEN '' ELSE txn_id END AS txn_id, txn_type, ts,
 CASE WHEN event_id % 107 = 52 THEN -amount WHEN event_id % 109 = 53 THEN NULL ELSE amount END AS amount,
 currency, amount_usd, direction,
 CASE WHEN event_id % 103 = 51 THEN NULL ELSE customer_id END AS customer_id,
 CASE WHEN event_id % 113 = 54 THEN '' ELSE counterparty_id END AS counterparty_id,
 channel, country_src, country_dst FROM {txn}""",
    "customer_entity": """
SELECT concat('CUST-', CAST(c_custkey AS VARCHAR(20))) AS customer_id, c_name AS name,
 CASE c_nationkey % 10 WHEN 0 THEN 'IR' WHEN 1 THEN 'KP' WHEN 2 THEN 'SY' WHEN 3 THEN 'CU' WHEN 4 THEN 'US' WHEN 5 THEN 'GB' WHEN 6 THEN 'DE' WHEN 7 THEN 'FR' WHEN 8 THEN 'JP' ELSE 'CN' END AS nationality,
 CASE c_mktsegment WHEN 'MACHINERY' THEN 'CORPORATE' WHEN 'BUILDING' THEN 'PEP' ELSE 'INDIVIDUAL' END AS customer_type,
 CASE c_custkey % 3 WHEN 0 THEN 'SIMPLIFIED' WHEN 1 THEN 'STANDARD' ELSE 'ENHANCED' END AS kyc_level FROM {customer}""",
    "alert_seed": """
SELECT concat('A-', CAST(event_id AS VARCHAR(20))) AS alert_id, concat('TXN-', CAST(event_id AS VARCHAR(20))) AS txn_id,
 concat('CUST-', CAST(CASE WHEN user_id % 5 = 0 THEN user_id % 25 ELSE user_id END AS VARCHAR(20))) AS customer_id,
 CASE event_id % 4 WHEN 0 THEN 'CTR' WHEN 1 THEN 'SAR' WHEN 2 THEN 'SANCTION' ELSE 'RULE' END AS alert_type,
 CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'purchase' THEN 'HIGH' WHEN 'signup' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 CASE event_id % 4 WHEN 0 THEN 'CTR-001' WHEN 1 THEN 'SAR-001' WHEN 2 THEN 'SAN-001' ELSE 'RISK-001' END AS rule_id,
 CASE event_id % 5 WHEN 0 THEN 'NEW' WHEN 1 THEN 'NEW' WHEN 2 THEN 'ESCALATED' WHEN 3 THEN 'REPORTED' ELSE 'CLOSED' END AS status,
 ts AS created_at, concat('seen as ', event_type, ' in ', CAST(event_id AS VARCHAR(20))) AS rule_desc, CAST(event_id * 7 % 100 AS DOUBLE) / 100 AS score
FROM {events}""",
    "case_seed": """
SELECT concat('CASE-', CAST(o_orderkey AS VARCHAR(20))) AS case_id, concat('CUST-', CAST(o_custkey AS VARCHAR(20))) AS customer_id,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'HIGH' WHEN '3-MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END AS priority,
 CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'INVESTIGATING' ELSE 'CLOSED' END AS status,
 concat('analyst', CAST(o_custkey % 7 AS VARCHAR(20))) AS assigned_to, o_orderdate AS created_at FROM {orders}""",
    "kyc_seed": """
SELECT concat('CUST-', CAST(c_custkey AS VARCHAR(20))) AS customer_id,
 CASE c_custkey % 6 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'PROHIBITED' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' WHEN 4 THEN 'OTHER' ELSE NULL END AS risk_level,
 CAST(c_acctbal AS DECIMAL(18,2)) AS risk_points,
 CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(DATE '2024-01-01' AS TIMESTAMP) + INTERVAL '1' DAY * (c_custkey % 90) END AS next_review_date FROM {customer}""",
    "sanction_name": """
SELECT min(p_partkey) AS pos, p_name AS name, 'LIST-A' AS list_source FROM {part} GROUP BY p_name""",
    "screen_name": """
SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN concat(upper(p_name), '!') WHEN 1 THEN replace(p_name, 'e', 'a') ELSE replace(p_name, ' ', '  ') END AS name FROM {part}""",
    "rule_version": """
SELECT * FROM (VALUES ('V1', TIMESTAMP '2024-01-01 00:00:00', 'ACTIVE'), ('V2', TIMESTAMP '2024-01-10 00:00:00', 'ACTIVE'), ('V3', TIMESTAMP '2024-01-15 00:00:00', 'DEPRECATED'), ('V4', TIMESTAMP '2024-01-20 00:00:00', 'ACTIVE')) AS v(version_id, effective_from, status)""",
    # Each party of a transaction gets a name, so that screening has text to work on.
    "txn_party": """
SELECT t.txn_id, t.customer_id, t.counterparty_id, t.ts,
 CASE t.event_id % 3 WHEN 0 THEN concat(upper(p.p_name), '!') WHEN 1 THEN replace(p.p_name, 'e', 'a') ELSE replace(p.p_name, ' ', '  ') END AS counterparty_name
FROM (SELECT *, event_id % (SELECT count(*) FROM {part}) AS party_key FROM {txn}) t JOIN {part} p ON t.party_key = p.p_partkey""",
    "alert_action": """
SELECT concat('A-', CAST(event_id AS VARCHAR(20))) AS alert_id, s.seq,
 concat('rev', CAST((event_id + s.seq) % 9 AS VARCHAR(20))) AS reviewer_id,
 CASE (event_id + s.seq * 3) % 7 WHEN 0 THEN 'CONFIRM' WHEN 1 THEN 'CLOSE' WHEN 2 THEN 'ESCALATE' WHEN 3 THEN 'REPORT' WHEN 4 THEN 'CLOSE' WHEN 5 THEN 'DISMISS' ELSE 'CONFIRM' END AS action,
 concat('note ', CAST(s.seq AS VARCHAR(20))) AS notes,
 ts + INTERVAL '1' HOUR * s.seq AS action_at
FROM {events} e JOIN (VALUES (1), (2), (3)) AS s(seq) ON (e.event_id + s.seq) % 3 <> 0""",
    "case_event": """
SELECT concat('CASE-', CAST(o_orderkey AS VARCHAR(20))) AS case_id, s.seq,
 CASE s.seq WHEN 1 THEN 'CREATE' WHEN 2 THEN 'ASSIGN' WHEN 3 THEN 'UPDATE' ELSE CASE o_orderkey % 2 WHEN 0 THEN 'ESCALATE' ELSE 'UPDATE' END END AS event,
 CASE WHEN s.seq = 1 THEN concat('CUST-', CAST(o_custkey AS VARCHAR(20))) END AS customer_id,
 CASE WHEN s.seq = 1 THEN o_orderpriority END AS priority,
 CASE WHEN s.seq IN (1, 2) THEN concat('analyst', CAST((o_custkey + s.seq) % 7 AS VARCHAR(20))) END AS actor,
 CASE WHEN s.seq = 3 AND o_orderkey % 5 = 0 THEN 'INVESTIGATING' END AS status,
 CASE WHEN s.seq = 3 THEN concat('looked at ', CAST(o_orderkey AS VARCHAR(20))) WHEN s.seq = 4 AND o_orderkey % 2 = 0 THEN 'large sums' END AS notes,
 CASE WHEN s.seq = 4 AND o_orderkey % 4 = 1 THEN 'CONFIRMED_SAR' END AS resolution,
 CASE WHEN s.seq = 1 THEN concat('A-', CAST(o_orderkey AS VARCHAR(20)), ', A-', CAST(o_orderkey + 1 AS VARCHAR(20))) END AS linked_alert_ids,
 o_orderdate + INTERVAL '1' DAY * s.seq AS event_at
FROM {orders} o JOIN (VALUES (1), (2), (3), (4)) AS s(seq) ON s.seq = 1 OR (o.o_orderkey + s.seq) % 3 <> 0""",
    "report_event": """
SELECT concat('RPT-', CAST(event_id AS VARCHAR(20))) AS report_id, s.seq,
 CASE s.seq WHEN 1 THEN 'GENERATE' WHEN 2 THEN 'SUBMIT' ELSE 'UPDATE' END AS event,
 CASE WHEN s.seq = 1 THEN CASE event_id % 2 WHEN 0 THEN 'CTR' ELSE 'SAR' END END AS report_type,
 CASE WHEN s.seq = 1 THEN concat('CUST-', CAST(user_id AS VARCHAR(20))) END AS customer_id,
 CASE WHEN s.seq = 3 THEN CASE event_id % 4 WHEN 0 THEN 'ACCEPTED' WHEN 1 THEN 'REJECTED' ELSE 'ACKNOWLEDGED' END END AS status,
 CASE WHEN s.seq >= 2 AND event_id % 7 <> 0 THEN concat('SUB-', CAST(event_id * 10 + s.seq AS VARCHAR(20))) END AS submission_id,
 CASE WHEN s.seq = 2 THEN concat('officer', CAST(user_id % 4 AS VARCHAR(20))) END AS actor,
 ts + INTERVAL '1' HOUR * s.seq AS event_at
FROM {events} e JOIN (VALUES (1), (2), (3)) AS s(seq) ON s.seq = 1 OR (e.event_id % 5) >= s.seq""",
    "kyc_change": """
SELECT concat('CUST-', CAST(c_custkey AS VARCHAR(20))) AS customer_id, s.seq,
 CASE (c_custkey + s.seq) % 3 WHEN 0 THEN 'UPSERT' WHEN 1 THEN 'RISK' ELSE 'REVIEW' END AS change,
 CASE WHEN (c_custkey + s.seq) % 3 <> 2 THEN CASE (c_custkey * 7 + s.seq) % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'PROHIBITED' END END AS risk_level,
 CASE WHEN (c_custkey + s.seq) % 3 = 1 THEN CAST(c_custkey % 100 AS DECIMAL(18,2)) END AS risk_points,
 CAST(DATE '2024-01-05' AS TIMESTAMP) + INTERVAL '1' DAY * s.seq AS change_at
FROM {customer} c JOIN (VALUES (1), (2)) AS s(seq) ON (c.c_custkey % 4) >= s.seq""",
}

_NEEDS = {name: [n for n in (*VIEWS, *BASE) if "{" + n + "}" in text] for name, text in VIEWS.items()}
_SPARK_K = "get_json_object(props, '$.k')"
_DUCK_K = "json_extract_string(props, '$.k')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table or one of the views above, read from ``sf_dir``."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    inputs = {n: table(spark, sf_dir, n) for n in _NEEDS[name]}
    text = VIEWS[name].replace("{k}", _SPARK_K)
    return spark.sql(text, **inputs) if inputs else spark.sql(text)


@cache
def _closure(name: str) -> tuple[str, ...]:
    out: list[str] = []
    for need in _NEEDS.get(name, []):
        out += [n for n in (*_closure(need), need) if n in VIEWS and n not in out]
    return tuple(out)


def ctes(*names: str) -> str:
    """``name AS (…)`` list, dependencies first, for the SQL twin of a query."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*_closure(name), name) if n not in order]
    parts = []
    for name in order:
        text = VIEWS[name].replace("{k}", _DUCK_K)
        for need in _NEEDS[name]:
            text = text.replace("{" + need + "}", need)
        parts.append(f"{name} AS ({text})")
    return ",\n".join(parts)
