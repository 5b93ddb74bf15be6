"""Layer 1: canonical values, validation, dead letters, routing tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.schemas import CURRENCIES, DIRECTIONS, TXN_TYPES

CTR_THRESHOLD = 10_000
MAIN, BYPASS = "MAIN", "BYPASS_CTR"


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("")) != ""


def basic_checks() -> dict[str, Column]:
    """What a row must satisfy to enter the pipeline; null-safe booleans."""
    return {
        "txn_id": _filled("txn_id"),
        "amount": F.coalesce(F.col("amount") > 0, F.lit(False)),
        "customer_id": _filled("customer_id"),
    }


def strict_checks(time: Column | None = None) -> dict[str, Column]:
    """Basic checks plus counterparty, positive event time and a known currency."""
    when = F.unix_millis(F.col("ts").cast("timestamp")) if time is None else time
    return {
        **basic_checks(),
        "counterparty_id": _filled("counterparty_id"),
        "timestamp": F.coalesce(when > 0, F.lit(False)),
        "currency": F.coalesce(F.upper("currency").isin(CURRENCIES), F.lit(False)),
    }


def _all(checks: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, checks.values())


def valid_rows(df: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    return df.filter(_all(checks or basic_checks()))


def rejected_rows(df: DataFrame, checks: dict[str, Column] | None = None) -> DataFrame:
    """Exact complement of :func:`valid_rows`, with the names of the failed checks."""
    checks = checks or basic_checks()
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks.items()]))
    return df.filter(~_all(checks)).withColumn("reject_reasons", failed)


def normalize(df: DataFrame, now: Column | None = None, ctr_threshold: float = CTR_THRESHOLD,
              bypass_on: str = "amount") -> DataFrame:
    """Canonical currency, type and direction, the large-transaction flag and the lane it routes to."""
    large = F.coalesce(F.col(bypass_on) >= F.lit(ctr_threshold), F.lit(False))

    def known(name: str, values: list[str]) -> Column:
        return F.when(F.col(name).isin(values), F.col(name)).otherwise(F.lit("UNKNOWN"))

    return df.withColumns({
        "currency": F.upper("currency"),
        "txn_type_normalized": known("txn_type", TXN_TYPES),
        "direction_normalized": known("direction", DIRECTIONS),
        "process_ts": F.current_timestamp() if now is None else now,
        "is_large_txn": large,
        "route_tag": F.when(large, F.lit(BYPASS)).otherwise(F.lit(MAIN)),
    })


def to_canonical(parsed: DataFrame) -> DataFrame:
    """camelCase feed message to the canonical snake_case row, with ``ts`` from epoch milliseconds."""
    names = {
        "txnId": "txn_id", "txnType": "txn_type", "amountUsd": "amount_usd", "customerId": "customer_id",
        "counterpartyId": "counterparty_id", "countrySrc": "country_src", "countryDst": "country_dst",
        "rawPayload": "raw_payload",
    }
    return parsed.withColumnsRenamed(names).withColumn("ts", F.timestamp_millis("timestamp"))
