"""The shipped rule pack, and the variant with lower limits used on small tables."""

from __future__ import annotations

import copy

from txnwatch.operators.rules import condition as c


def _alert(template: str) -> dict:
    return {"type": "ALERT", "template": template, "priority": None}


def _escalate(priority: str) -> dict:
    return {"type": "ESCALATE", "template": None, "priority": priority}


def _rule(rule_id, name, kind, severity, window, conditions, actions, logic=None) -> dict:
    return {"rule_id": rule_id, "name": name, "type": kind, "severity": severity, "window": window,
            "conditions": conditions, "actions": actions, "logic": logic}


# Thresholds, country lists and message texts of the detection rules.
HIGH_RISK_COUNTRIES = ["IR", "KP", "SY", "CU", "MM", "SD", "VE"]
SHIPPED = [
    _rule("CTR-001", "Large Cash Transaction", "CTR", "HIGH", None,
          [c("amount_usd", "GTE", 10000), c("txn_type_normalized", "EQ", "TRANSFER"), c("channel", "IN", ["ATM", "BRANCH"])],
          [_alert("CTR: Large cash transaction $${amount_usd} via $${channel}")]),
    _rule("SAR-001", "Structuring Detection", "SAR", "HIGH", "24h",
          [c("txn_count_24h", "GTE", 5), c("max_amount_24h", "LT", 10000), c("total_amount_24h", "GTE", 40000)],
          [_alert("SAR: Potential structuring - $${txn_count_24h} transactions totaling $${total_amount_24h}"), _escalate("HIGH")]),
    _rule("SAR-002", "Anomalous Frequency", "SAR", "MEDIUM", "1h",
          [c("txn_count_1h", "GTE", 20)],
          [_alert("SAR: Anomalous frequency - $${txn_count_1h} transactions in 1 hour for customer $${customer_id}"), _escalate("MEDIUM")]),
    _rule("SAR-003", "High-Risk Country Transfer", "SAR", "HIGH", None,
          [c("country_dst", "IN", HIGH_RISK_COUNTRIES), c("amount_usd", "GTE", 5000)],
          [_alert("SAR: High-risk country transfer $${amount_usd} to $${country_dst}"), _escalate("HIGH")]),
    _rule("SAR-004", "Rapid In-Out", "SAR", "MEDIUM", "24h",
          [c("txn_count_24h", "GTE", 3), c("unique_counterparties_24h", "LTE", 2), c("risk_level", "IN", ["HIGH", "PROHIBITED"])],
          [_alert("SAR: Rapid in-out pattern - $${txn_count_24h} txns with $${unique_counterparties_24h} counterparties, risk=$${risk_level}"),
           _escalate("MEDIUM")]),
    _rule("RISK-001", "High-Risk Customer Large Transaction", "RULE", "MEDIUM", None,
          [c("risk_level", "EQ", "HIGH"), c("amount_usd", "GTE", 5000)],
          [_alert("RISK: High-risk customer $${customer_id} transaction $${amount_usd}")]),
]

# Limits lowered so that every rule fires on the small supplied tables: (rule, field) -> value.
_LOWERED = {("CTR-001", "amount_usd"): 5000, ("SAR-001", "total_amount_24h"): 15000,
            ("SAR-002", "txn_count_1h"): 3, ("SAR-004", "unique_counterparties_24h"): 4}


def lowered_pack() -> list[dict]:
    pack = copy.deepcopy(SHIPPED)
    for rule in pack:
        rule["conditions"] = [c(x["field"], x["operator"], _LOWERED.get((rule["rule_id"], x["field"]), x["list"] or _number(x)))
                              for x in rule["conditions"]]
    return pack


def _number(cond: dict):
    return cond["num"] if cond["kind"] == "num" else cond["str"]


def ops_matrix() -> list[dict]:
    """One rule per operator, plus the odd cases: unknown operator, missing and null field, non-list values."""
    cases = {
        "OP-GTE": [c("amount_usd", "GTE", 7500)], "OP-GT": [c("amount_usd", "GT", 7500)],
        "OP-LTE": [c("amount_usd", "LTE", 120)], "OP-LT": [c("amount_usd", "LT", 120)],
        "OP-EQ": [c("channel", "EQ", "ATM")], "OP-NEQ": [c("channel", "NEQ", "ATM")],
        "OP-EQ-TEXT": [c("amount_usd", "EQ", 655)], "OP-LT-TEXT": [c("channel", "LT", "B")],
        "OP-IN": [c("country_dst", "IN", ["IR", "KP"])], "OP-NOT-IN": [c("country_dst", "NOT_IN", ["IR", "KP", "US"])],
        "OP-IN-SCALAR": [c("country_dst", "IN", "IR")], "OP-NOT-IN-SCALAR": [c("country_dst", "NOT_IN", "IR")],
        "OP-UNKNOWN": [c("amount_usd", "BETWEEN", 5)], "OP-MISSING": [c("no_such_field", "NEQ", "x")],
        "OP-NULL": [c("counterparty_opt", "NEQ", "CUST-1")], "OP-EMPTY": [],
        "OP-MAP": [c("metadata.device", "EQ", "mobile")], "OP-MAP-NUM": [c("metadata.attempts", "GTE", 3)], "OP-MAP-ABSENT": [c("metadata.device", "NEQ", "mobile")],
        "OP-MAP-UNKNOWN": [c("metadata.no_such_key", "NOT_IN", ["x"])], "OP-MAP-OTHER": [c("channel.device", "NEQ", "x")],
    }
    return [*(_rule(k, k, "RULE", "LOW", None, v, []) for k, v in cases.items()),
            _rule("OP-MAP-TEXT", "OP-MAP-TEXT", "RULE", "LOW", None, [c("metadata.attempts", "EQ", "4")], [_alert("${metadata.attempts} by ${metadata.device}, ${metadata.none}")])]


def stricter_pack(rule_id: str, field: str, value) -> list[dict]:
    """The lowered pack with another limit in one rule: a later version of it."""
    pack = lowered_pack()
    for rule in pack:
        if rule["rule_id"] == rule_id:
            rule["conditions"] = [c(x["field"], x["operator"], value if x["field"] == field else x["list"] or _number(x)) for x in rule["conditions"]]
    return pack


# A nested example: two of the three marks, and not an inbound row.
NESTED = [_rule(
    "MIX-001", "Nested conditions", "SAR", "CRITICAL", None, [], [_alert("MIX: ${customer_id} ${channel}")],
    logic='{"all": [{"any": [{"field": "channel", "operator": "EQ", "value": "SWIFT"}, '
          '{"field": "country_dst", "operator": "IN", "value": ["IR", "KP"]}]}, '
          '{"field": "amount_usd", "operator": "GTE", "value": 3000}, '
          '{"not": {"field": "direction", "operator": "EQ", "value": "INBOUND"}}]}')]
