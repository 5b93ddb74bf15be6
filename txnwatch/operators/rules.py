"""Declarative rules compiled to columns and evaluated in one pass.

A rule is a row of the ``RULE`` schema: conditions joined by AND, or a nested ``all``/``any``/``not`` tree.
Every rule becomes one optional struct in an array; exploding the non-null ones yields the alerts, so any
number of rules costs a single scan and no join.
"""

from __future__ import annotations

import json
import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnwatch.functions.columns import SEVERITY_SCORE, alert_key, mapped
from txnwatch.operators.normalize import BYPASS
from txnwatch.schemas import RULE

# Rules that are compiled into one array; a larger pack makes several, which are joined.
RULES_PER_ARRAY = 500
DEFAULT_SCORE = 0.5


def _text(value: Any) -> str:
    """As cells read: booleans in lower case."""
    return str(value).lower() if isinstance(value, bool) else str(value)


def condition(field: str, operator: str, value: Any) -> dict:
    """One condition row from a Python value: list, number or text."""
    out = {"field": field, "operator": operator, "kind": "str", "num": None, "str": None, "list": None}
    if isinstance(value, (list, tuple)):
        out |= {"kind": "list", "list": [_text(v) for v in value]}
    elif isinstance(value, bool):
        out |= {"str": _text(value)}
    elif isinstance(value, (int, float)):
        out |= {"kind": "num", "num": value, "str": str(value)}
    else:
        out |= {"str": value}
    return out


def rule_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules written as Python literals as a rule table."""
    lines = spark.createDataFrame([(json.dumps(r),) for r in rules], "value string").coalesce(1)
    return lines.select(F.from_json("value", RULE).alias("r")).select("r.*")


def collect_rules(rules: DataFrame) -> list[Row]:
    """The rule table on the driver, in table order: rules are control data, written by people."""
    return rules.collect()


def _plain(num) -> str:
    text = format(num, "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def _literal_text(cond) -> str | None:
    """How the rule's value reads as text; numbers keep their written form when the row has one."""
    if cond["kind"] == "list":
        return None
    if cond["str"] is not None:
        return cond["str"]
    return None if cond["num"] is None else _plain(cond["num"])


def field_names(df: DataFrame) -> set[str]:
    """Columns that rules may name; ``name.*`` stands for the keys of a map column."""
    return {*df.columns, *(f"{f.name}.*" for f in df.schema if isinstance(f.dataType, T.MapType))}


def resolve(field: str, columns: set[str]) -> Column | None:
    """A column, or behind a dot a key of a map column, e.g. ``metadata.device``; null for rows without the key."""
    if field in columns:
        return F.col(field)
    head, dot, key = field.partition(".")
    return F.try_element_at(F.col(head), F.lit(key)) if dot and f"{head}.*" in columns else None


def compile_condition(cond, columns: set[str]) -> Column:
    """Boolean column of one condition; absent or null fields never match, whatever the operator.

    Ordering compares numbers when both sides are numbers, else texts. Equality and membership compare
    texts, so a decimal ``10000.00`` differs from ``10000``.
    """
    field = resolve(cond["field"], columns)
    if field is None:
        return F.lit(False)
    text = field.cast("string")
    op, value = cond["operator"], _literal_text(cond)
    if op in ("GTE", "GT", "LTE", "LT"):
        if value is None:
            return F.lit(False)
        number, other = field.try_cast("decimal(38,18)"), F.lit(value).try_cast("decimal(38,18)")
        pick = {"GTE": lambda a, b: a >= b, "GT": lambda a, b: a > b,
                "LTE": lambda a, b: a <= b, "LT": lambda a, b: a < b}[op]
        both = number.isNotNull() & other.isNotNull()
        test = F.when(both, pick(number, other)).otherwise(pick(text, F.lit(value)))
    elif op == "EQ":
        test = text == F.lit(value)
    elif op == "NEQ":
        test = text != F.lit(value)
    elif op == "IN":
        test = text.isin(list(cond["list"])) if cond["kind"] == "list" else F.lit(False)
    elif op == "NOT_IN":
        test = ~text.isin(list(cond["list"])) if cond["kind"] == "list" else text.isNotNull()
    else:
        test = F.lit(False)
    return F.coalesce(test, F.lit(False))


def compile_tree(node: dict, columns: set[str]) -> Column:
    """``{"all": […]}``, ``{"any": […]}``, ``{"not": …}`` or a single condition."""
    if "all" in node:
        return reduce(lambda a, b: a & b, [compile_tree(n, columns) for n in node["all"]], F.lit(True))
    if "any" in node:
        return reduce(lambda a, b: a | b, [compile_tree(n, columns) for n in node["any"]], F.lit(False))
    if "not" in node:
        return ~compile_tree(node["not"], columns)
    return compile_condition(condition(node["field"], node["operator"], node["value"]), columns)


def compile_rule(rule, columns: set[str]) -> Column:
    if rule["logic"]:
        return compile_tree(json.loads(rule["logic"]), columns)
    tests = [compile_condition(c, columns) for c in rule["conditions"] or []]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def rule_message(rule, columns: set[str]) -> Column:
    """First action's template with ``${field}`` replaced; unknown or null fields keep their placeholder."""
    actions = rule["actions"] or []
    template = actions[0]["template"] if actions else None
    if not template:
        return F.lit(f"Rule {rule['rule_id']} triggered")
    parts = []
    for piece in re.split(r"(\$\{\w[\w.]*\})", template):
        field = resolve(piece[2:-1], columns) if piece.startswith("${") else None
        if field is not None:
            parts.append(F.coalesce(field.cast("string"), F.lit(piece)))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def severity_score(severity: Column) -> Column:
    return mapped(severity, SEVERITY_SCORE, DEFAULT_SCORE).cast("float")


def _is_bypass() -> Column:
    return F.coalesce(F.col("route_tag") == BYPASS, F.lit(False))


def _bypass_hit() -> Column:
    """The CTR alert every row of the bypass lane becomes, without a look at the rules."""
    amount = F.coalesce(F.col("amount_usd").cast("string"), F.lit("N/A"))
    text = F.concat(F.lit("Auto-CTR: Large transaction "), amount, F.lit(" bypass lane"))
    return F.struct(F.lit("CTR-001").alias("rule_id"), F.lit("CTR").alias("alert_type"), F.lit("HIGH").alias("severity"),
                    text.alias("rule_desc"), F.lit(1.0).cast("float").alias("score"), F.lit(-1).alias("rule_pos"))


def _rule_hits(rules: list, columns: set[str], applies: Column) -> list[Column]:
    return [F.when(applies & compile_rule(rule, columns), F.struct(
        F.lit(rule["rule_id"]).alias("rule_id"), F.lit(rule["type"]).alias("alert_type"), F.lit(rule["severity"]).alias("severity"),
        rule_message(rule, columns).alias("rule_desc"),
        F.lit(SEVERITY_SCORE.get(rule["severity"], DEFAULT_SCORE)).cast("float").alias("score"),
        F.lit(pos).alias("rule_pos"))) for pos, rule in enumerate(rules)]


def _alerts_of(df: DataFrame, hits: list[Column], created_at: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Hits to alert rows; filtered before the explode, as most rows match nothing."""
    if not hits:
        hits = [F.lit(None).cast("struct<rule_id:string,alert_type:string,severity:string,rule_desc:string,score:float,rule_pos:int>")]
    arrays = [F.array_compact(F.array(*hits[i:i + RULES_PER_ARRAY])) for i in range(0, len(hits), RULES_PER_ARRAY)]
    matched = df.select("txn_id", "customer_id", F.col(created_at).alias("created_at"), *keep,
                        (arrays[0] if len(arrays) == 1 else F.concat(*arrays)).alias("hits")).filter(F.size("hits") > 0)
    return matched.select("txn_id", "customer_id", "created_at", *keep, F.explode("hits").alias("h")).select(
        *alert_columns("h."), F.col("h.rule_pos").alias("rule_pos"), *keep)


def evaluate_rules(df: DataFrame, rules: list, created_at: str = "ts") -> DataFrame:
    """All matching rules per row, in rule order, as alert rows (plus ``rule_pos``); the bypass lane is skipped."""
    lane = df.filter(~_is_bypass()) if "route_tag" in df.columns else df
    return _alerts_of(lane, _rule_hits(rules, field_names(df), F.lit(True)), created_at)


def bypass_alerts(df: DataFrame, created_at: str = "ts") -> DataFrame:
    """The bypass lane's CTR alerts alone."""
    return _alerts_of(df.filter(_is_bypass()), [_bypass_hit()], created_at).drop("rule_pos")


def all_alerts(df: DataFrame, rules: list, sanction_alerts: DataFrame | None = None, created_at: str = "ts") -> DataFrame:
    """Bypass and rule alerts from one pass over the rows, and sanction alerts, as one table."""
    hits = [F.when(_is_bypass(), _bypass_hit()), *_rule_hits(rules, field_names(df), ~_is_bypass())]
    out = _alerts_of(df, hits, created_at).drop("rule_pos")
    return out if sanction_alerts is None else out.unionByName(sanction_alerts)


def alerts_of_their_time(df: DataFrame, packs: list[tuple[str, Any, Any, list]], created_at: str = "ts") -> DataFrame:
    """Bypass and rule alerts, each row judged by the pack in force at its own time, with ``version_id``.

    ``packs`` lists (version, from, until, rules), as :func:`txnwatch.operators.versions.validity` finds them; ``until``
    is None for the last one. All packs are compiled side by side, so one pass over the rows serves any number of them.
    Rows before the first pack, or without a time, meet no rule; the bypass lane knows no versions.
    """
    at, columns = F.col(created_at).cast("timestamp"), field_names(df)
    hits = [F.when(_is_bypass(), _bypass_hit())]
    version: Column = F.lit(None).cast("string")
    for name, begin, until, rules in packs:
        inside = at >= F.lit(begin).cast("timestamp")
        if until is not None:
            inside &= at < F.lit(until).cast("timestamp")
        version = F.when(inside, F.lit(name)).otherwise(version)
        hits += _rule_hits(rules, columns, ~_is_bypass() & F.coalesce(inside, F.lit(False)))
    told = df.withColumn("__version", F.when(~_is_bypass(), version))
    return _alerts_of(told, hits, created_at, ("__version",)).drop("rule_pos").withColumnRenamed("__version", "version_id")


def alert_columns(prefix: str = "") -> list[Column]:
    """The alert row; ids follow from (txn, rule), times from the event, so replays repeat it."""
    rule_id = F.col(f"{prefix}rule_id")
    return [
        alert_key(F.col("txn_id"), rule_id).alias("alert_id"), F.col("txn_id"), F.col("customer_id"),
        F.col(f"{prefix}alert_type").alias("alert_type"), F.col(f"{prefix}severity").alias("severity"),
        rule_id.alias("rule_id"), F.col(f"{prefix}rule_desc").alias("rule_desc"), F.col(f"{prefix}score").alias("score"),
        F.lit("NEW").alias("status"), F.col("created_at"), F.col("created_at").alias("updated_at"),
        F.lit(None).cast("string").alias("reviewer_id"), F.lit(None).cast("string").alias("notes"),
    ]


HOURS = 30 * 24


def hourly_baseline(txn: DataFrame, hours: int = HOURS) -> DataFrame:
    """Mean transactions per hour before each active hour of a customer: (__k, __hour, mean_hourly).

    The mean of an hour looks back over the ``hours`` whole hours before the hour that precedes it, so that a trailing
    hour never counts as its own history; hours before the customer's first one are left out of the mean, silent ones
    since then are not. Null where nothing is known from before. The counts are sparse: an hour without transactions
    has no row, and both ends of the look-back come from running sums over a customer's active hours.
    """
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))
    per_hour = txn.filter(F.col("ts").isNotNull()).groupBy(F.struct("customer_id").alias("__k"), hour.alias("__hour")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("__k").orderBy("__hour")

    def before(back: int) -> Column:
        return F.coalesce(F.sum("n").over(order.rangeBetween(Window.unboundedPreceding, -back)), F.lit(0))
    past = before(2) - before(hours + 2)
    known = F.least(F.lit(hours), F.col("__hour") - 1 - F.min("__hour").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return per_hour.select("__k", "__hour", F.when(past > 0, past / known).alias("mean_hourly"))


def frequency_anomaly(counted: DataFrame, baseline: DataFrame, factor: float = 5.0, unknown_mean: float = 1.0) -> DataFrame:
    """Rows whose trailing one-hour count is at least ``factor`` times the customer's mean before it.

    Every row is judged. A customer without history is measured against ``unknown_mean`` per hour; ``mean_hourly`` is
    null for such rows. Rows without a time have no count and are never anomalous.
    """
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000))
    # the rows stay on the left: those of one hour of a hot customer are split at run time
    met = counted.withColumn("__at", F.struct(F.struct("customer_id"), hour)).join(
        baseline.select(F.struct("__k", "__hour").alias("__of"), "mean_hourly"), F.col("__at") == F.col("__of"), "left")
    found = met.filter(F.col("txn_count_1h") >= F.coalesce("mean_hourly", F.lit(unknown_mean)) * F.lit(factor))
    return found.select(*counted.columns, "mean_hourly")


def rapid_in_out(rolled: DataFrame, window: str = "24h", keep_below: float = 0.1) -> DataFrame:
    """Rows whose trailing deposits were withdrawn again but for less than ``keep_below`` of them.

    A customer who withdraws more than came in keeps less than nothing and is the strongest case.
    """
    came, left = F.col(f"in_total_amount_{window}").cast("double"), F.col(f"out_total_amount_{window}").cast("double")
    kept = (came - left) / came
    return rolled.filter((came > 0) & (left > 0) & (kept < F.lit(keep_below)))
