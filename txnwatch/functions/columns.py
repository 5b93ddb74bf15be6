"""Small column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Severity order, severity scores, queue order of unknown values.
SEVERITY_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
SEVERITY_SCORE = {"CRITICAL": 1.0, "HIGH": 0.8, "MEDIUM": 0.5, "LOW": 0.3}
QUEUE_ORDER = {"CRITICAL": 1, "HIGH": 2, "MEDIUM": 3}
QUEUE_LAST = 4


def mapped(col: Column, values: dict, default) -> Column:
    """CASE over literal keys."""
    out = None
    for key, value in values.items():
        out = F.when(col == key, F.lit(value)) if out is None else out.when(col == key, F.lit(value))
    return out.otherwise(F.lit(default))


def severity_rank(col: Column) -> Column:
    """LOW 0 … CRITICAL 3; anything else, null too, is -1."""
    return mapped(col, SEVERITY_RANK, -1)


def severity_name(rank: Column) -> Column:
    """Back from a rank; out-of-range ranks read LOW."""
    return mapped(rank, {3: "CRITICAL", 2: "HIGH", 1: "MEDIUM"}, "LOW")


def queue_order(col: Column) -> Column:
    return mapped(col, QUEUE_ORDER, QUEUE_LAST)


def epoch_micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def utc_day(col: Column) -> Column:
    """Day string used as the ``dt`` partition value."""
    return F.date_format(col, "yyyy-MM-dd")


def alert_key(txn_id: Column, rule_id: Column) -> Column:
    """Deterministic alert id, so that replays write the same rows."""
    return F.sha2(F.concat_ws("|", txn_id, rule_id), 256)


def xml_text(col: Column) -> Column:
    """Escape the five XML special characters; null becomes empty text."""
    out = F.coalesce(col.cast("string"), F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def normalize_name(col: Column) -> Column:
    """Trim control characters and blanks, lower-case, keep [a-z0-9 blank], squeeze blanks.

    The trim comes first, so a blank uncovered by the strip can stay at an end.
    """
    trimmed = F.regexp_replace(col, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    kept = F.regexp_replace(F.lower(trimmed), r"[^a-z0-9\s]", "")
    return F.regexp_replace(kept, r"\s+", " ")


def match_key(name: Column) -> Column:
    """The normalized name, or, where no Latin letter or digit is left, its letters and digits of any script."""
    norm, trimmed = F.trim(normalize_name(name)), F.lower(F.regexp_replace(name, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    every = F.trim(F.regexp_replace(F.regexp_replace(trimmed, r"[^\p{L}\p{M}\p{N}\s]", ""), r"\s+", " "))
    return F.when(norm != "", normalize_name(name)).otherwise(F.nullif(every, F.lit("")))


def bigrams(col: Column) -> Column:
    """Overlapping character pairs; a text shorter than two is its own only gram."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(col) - 1), lambda i: F.substring(col, i, F.lit(2)))
    return F.when(F.length(col) < 2, F.array(col)).otherwise(pairs)


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes elapsed, cut towards zero."""
    micros = epoch_micros(end) - epoch_micros(start)
    return (micros / F.lit(60_000_000)).cast("bigint")
