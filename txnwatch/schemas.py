"""Explicit schemas and the fixed values they depend on."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

# Enumerations, currency codes and country lists the rules and validators rely on.
TXN_TYPES = ["TRANSFER", "CARD", "FOREX"]
DIRECTIONS = ["INBOUND", "OUTBOUND"]
ALERT_TYPES = ["CTR", "SAR", "SANCTION", "RULE"]
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
ALERT_STATUSES = ["NEW", "REVIEWING", "ESCALATED", "CLOSED", "REPORTED"]
RISK_LEVELS = ["LOW", "MEDIUM", "HIGH", "PROHIBITED"]
CURRENCIES = [
    "USD", "EUR", "GBP", "JPY", "CNY", "CHF", "AUD", "CAD", "HKD", "SGD",
    "SEK", "NOK", "DKK", "NZD", "KRW", "INR", "BRL", "RUB", "ZAR", "MXN",
    "TRY", "THB", "MYR", "IDR", "PHP", "PLN", "CZK", "HUF", "RON", "BGN",
]
TOPIC_BY_TXN_TYPE = {"TRANSFER": "txn.bank", "CARD": "txn.card", "FOREX": "txn.forex"}
DEAD_LETTER_TOPIC = "txn.dlq"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _L, _I, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()

# Feed messages use camelCase names; everything downstream is snake_case.
TXN_JSON = _struct(
    txnId=_S, txnType=_S, timestamp=_L, amount=MONEY, currency=_S, amountUsd=MONEY, direction=_S,
    customerId=_S, counterpartyId=_S, channel=_S, countrySrc=_S, countryDst=_S,
    metadata=T.MapType(_S, _S), rawPayload=_S,
)

TXN = _struct(
    txn_id=_S, txn_type=_S, timestamp=_L, ts=_TS, amount=MONEY, currency=_S, amount_usd=MONEY,
    direction=_S, customer_id=_S, counterparty_id=_S, channel=_S, country_src=_S, country_dst=_S,
    metadata=T.MapType(_S, _S), raw_payload=_S,
)

ALERT = _struct(
    alert_id=_S, txn_id=_S, customer_id=_S, alert_type=_S, severity=_S, rule_id=_S, rule_desc=_S,
    score=T.FloatType(), status=_S, created_at=_TS, updated_at=_TS, reviewer_id=_S, notes=_S,
)

RULE = T.StructType([
    T.StructField("rule_id", _S),
    T.StructField("name", _S),
    T.StructField("type", _S),
    T.StructField("severity", _S),
    T.StructField("window", _S),
    T.StructField("conditions", T.ArrayType(_struct(
        field=_S, operator=_S, kind=_S, num=T.DecimalType(38, 18), str=_S, list=T.ArrayType(_S)))),
    T.StructField("actions", T.ArrayType(_struct(type=_S, template=_S, priority=_S))),
    # Optional nested AND/OR/NOT tree as JSON text; replaces `conditions` when present.
    T.StructField("logic", _S),
])

RULE_VERSION = _struct(version_id=_S, effective_from=_TS, rules_json=_S, created_by=_S, created_at=_TS, status=_S)

CUSTOMER_FEATURES = _struct(
    customer_id=_S, risk_level=_S, risk_score=_D, kyc_status=_S, txn_count_7d=_L, txn_count_30d=_L,
    total_amount_7d=MONEY, total_amount_30d=MONEY, avg_amount=MONEY, max_amount=MONEY,
    unique_counterparties_30d=_I, alert_count_total=_L, open_alert_count=_I, dt=_S,
)

CUSTOMER_ENTITY = _struct(
    customer_id=_S, name=_S, id_type=_S, id_number=_S, nationality=_S, occupation=_S, income_source=_S,
    address=_S, kyc_level=_S, customer_type=_S, dt=_S,
)

CASE_EVENT = _struct(
    case_id=_S, seq=_L, event=_S, customer_id=_S, title=_S, description=_S, priority=_S, actor=_S,
    status=_S, notes=_S, resolution=_S, linked_alert_ids=_S, event_at=_TS,
)

ALERT_ACTION = _struct(alert_id=_S, seq=_L, reviewer_id=_S, action=_S, notes=_S, action_at=_TS)
