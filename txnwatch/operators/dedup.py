"""Alert deduplication: fixed windows and windows anchored at the first alert."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.columns import severity_name, severity_rank

_MINUTE = 60_000_000


def _merged(extra: list[str]) -> list[Column]:
    """First alert's fields, worst severity, highest score, number of alerts."""
    first = F.struct("alert_id", "txn_id", "alert_type", *extra)
    return [
        F.min_by(first, F.struct("created_at", "alert_id")).alias("first"),
        F.max(severity_rank(F.col("severity"))).alias("severity_rank"),
        *([F.max("score").alias("score")] if "rule_desc" in extra else []),
        F.min("created_at").alias("created_at"),
        F.count(F.lit(1)).alias("alert_count"),
    ]


def _flat(df: DataFrame, keys: list[str], extra: list[str]) -> DataFrame:
    return df.select(
        *keys, F.col("first.alert_id").alias("alert_id"), F.col("first.txn_id").alias("txn_id"),
        F.col("first.alert_type").alias("alert_type"), *[F.col(f"first.{c}").alias(c) for c in extra],
        severity_name(F.col("severity_rank")).alias("severity"), *(["score"] if "rule_desc" in extra else []),
        F.lit("NEW").alias("status"), "created_at", "alert_count")


def dedup_tumbling(alerts: DataFrame, minutes: int = 30) -> DataFrame:
    """One alert per customer, rule and fixed event-time window; the same on a table and a stream."""
    extra = [c for c in ("rule_desc",) if c in alerts.columns]
    slot = F.window("created_at", f"{minutes} minutes")
    merged = alerts.groupBy("customer_id", "rule_id", slot.alias("w")).agg(*_merged(extra))
    merged = merged.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")})
    return _flat(merged, ["customer_id", "rule_id", "window_start", "window_end"], extra)


KEYS = ["customer_id", "rule_id"]
#: Time blocks are as long as so many groups can be at most.
BLOCK_SPANS = 64


def _whole_runs(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by key and block, in whole runs of one key and block, with the number of each row's run."""
    held: pd.DataFrame | None = None
    for batch in _and_end(batches):
        rows = held if batch is None else batch if held is None else pd.concat([held, batch], ignore_index=True)
        if rows is None or rows.empty:
            continue
        new = np.ones(len(rows), bool)
        new[1:] = False
        for c in (*KEYS, "block"):
            values = rows[c].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        # the last run of a batch may go on in the next one
        cut = len(rows) if batch is None else int(np.flatnonzero(new)[-1])
        held = None if batch is None else rows.iloc[cut:].reset_index(drop=True)
        if cut:
            yield rows.iloc[:cut], np.cumsum(new[:cut]) - 1


def _and_end(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame | None]:
    yield from batches
    yield None


def _places(rows: pd.DataFrame, run: np.ndarray, span: int, spans: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the block, place over all runs, next anchor) per row: -1 where the next anchor lies behind the block."""
    offset = rows["t"].to_numpy(np.int64) - rows["block"].to_numpy(np.int64) * span * spans
    place = run * (span * (spans + 2)) + offset
    onward = np.searchsorted(place, place + span)
    inside = (onward < len(run)) & (run[np.minimum(onward, len(run) - 1)] == run)
    return offset, place, np.where(inside, onward, -1)


def _block_exits(span: int, spans: int = BLOCK_SPANS):
    """For each block of a key: every instant a walk can enter it by, and the time it leaves after.

    The walk reaches a block less than one span after its start, or else by the first instant there is; all entries of
    all blocks jump together, at most once for each group that fits into a block.
    """
    def exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, run in _whole_runs(batches):
            offset, _, onward = _places(rows, run, span, spans)
            before = np.where(np.diff(run, prepend=-1) > 0, -1, np.roll(offset, 1))
            entries = np.flatnonzero(before < span)  # up to the first one that is a span behind the block's start
            at = entries
            while (onward[at] >= 0).any():
                at = np.where(onward[at] >= 0, onward[at], at)
            t = rows["t"].to_numpy(np.int64)
            yield pd.DataFrame({**{k: rows[k].to_numpy()[entries] for k in (*KEYS, "block")}, "entry": t[entries], "leaves": t[at] + span})
    return exits


def _walk_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Follows each key from block to block over the sorted entries and emits the entry used in each block."""
    last, done, limit = None, None, 0
    for batch in batches:
        out = []
        for c, r, block, entry, leaves in zip(*(batch[n].tolist() for n in (*KEYS, "block", "entry", "leaves"))):
            if (c, r) != last:
                last, done, limit = (c, r), None, entry
            if block != done and entry >= limit:
                out.append((c, r, block, entry))
                done, limit = block, leaves
        yield pd.DataFrame(out, columns=[*KEYS, "block", "entry"])


def _block_anchors(span: int, spans: int = BLOCK_SPANS):
    """The anchors of each block from its entry on; blocks that no walk enters have none."""
    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, run in _whole_runs(batches):
            _, _, onward = _places(rows, run, span, spans)
            t = rows["t"].to_numpy(np.int64)
            at = np.flatnonzero(t == rows["entry"].to_numpy(np.int64))
            found = [at]
            while len(at := onward[at][onward[at] >= 0]):
                found.append(at)
            every = np.concatenate(found)
            yield pd.DataFrame({**{k: rows[k].to_numpy()[every] for k in KEYS}, "anchor": t[every]})
    return anchors


def _anchors(instants: DataFrame, span: int, spans: int) -> DataFrame:
    """Group anchors per (customer, rule), for keys of any size alike.

    Keys are cut into time blocks. What a block does to the walk from anchor to anchor is worked out for all blocks at
    once; the walk itself then only visits the blocks' entries, a small part of the instants, and the anchors are again
    found in all blocks at once.
    """
    blocks = instants.withColumn("block", F.floor(F.col("t") / F.lit(span * spans)))
    by_block = [*KEYS, "block"]
    keyed = "customer_id string, rule_id string"
    exits = blocks.repartition(*by_block).sortWithinPartitions(*by_block, "t").mapInPandas(_block_exits(span, spans), f"{keyed}, block bigint, entry bigint, leaves bigint")
    entered = exits.repartition(*KEYS).sortWithinPartitions(*by_block, "entry").mapInPandas(_walk_blocks, f"{keyed}, block bigint, entry bigint")
    key = F.struct(*by_block)
    met = blocks.join(entered.select(key.alias("__b"), "entry"), key == F.col("__b")).drop("__b")
    return met.repartition(*by_block).sortWithinPartitions(*by_block, "t").mapInPandas(_block_anchors(span, spans), f"{keyed}, anchor bigint")


def dedup_anchored(alerts: DataFrame, minutes: int = 30, block_spans: int = BLOCK_SPANS) -> DataFrame:
    """Alerts of a customer and rule join the group whose first alert is at most ``minutes`` whole minutes
    before; the next one starts a new group.

    Only finding the anchors is sequential, so that part sees nothing but distinct instants, reduced before
    the shuffle. Everything else is an equi-join on time slots as long as a group, in each of which at most
    one group starts, and a partial aggregate.
    """
    span = (minutes + 1) * _MINUTE
    timed = alerts.withColumn("t", F.unix_micros(F.col("created_at").cast("timestamp")))
    instants = timed.filter(F.col("t").isNotNull()).select(*KEYS, "t").distinct()
    slot = F.floor(F.col("anchor") / F.lit(span))
    placed = _anchors(instants, span, block_spans).select(
        F.explode(F.array(slot, slot + 1)).alias("s"), F.struct(*KEYS).alias("g"), "anchor")
    t = F.col("t")
    same = ((F.struct(*[F.col(k) for k in KEYS]) == F.col("g")) & (F.floor(t / F.lit(span)) == F.col("s"))
            & (t >= F.col("anchor")) & (t < F.col("anchor") + F.lit(span)))
    extra = [c for c in ("rule_desc",) if c in alerts.columns]
    merged = timed.join(placed, same).groupBy(*KEYS, "anchor").agg(*_merged(extra))
    return _flat(merged, KEYS, extra)


def correlate(alerts: DataFrame, party: str) -> DataFrame:
    """Alert count, number of distinct rules, their names, worst severity and time span per party."""
    per_rule = alerts.groupBy(party, "rule_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(severity_rank(F.col("severity"))).alias("worst"),
        F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))
    return per_rule.groupBy(party).agg(
        F.sum("n").alias("alert_count"), F.count("rule_id").alias("rule_count"),
        F.concat_ws(",", F.array_sort(F.collect_set("rule_id"))).alias("rules"),
        severity_name(F.max("worst")).alias("worst_severity"),
        F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
