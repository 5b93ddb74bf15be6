"""Sharding by a k-d tree over document metadata.

A node of the tree is split at the weighted median of its widest dimension, where the bytes to the left are the share
its shards need, until every leaf is a shard of the target size. The median is exact and distributed: sums of bytes
by the leading digits of the split key, all nodes of a level at once, narrow it down digit by digit.

Metadata are those of a group of equal texts (the smallest source and language in it), and the split key goes on with
a hash of the text: so equal texts fall on one side. It ends with a hash of the document, by which a group is split
only if it is too large for equal shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.common import materialize, partition_bases

SHARDS = 8
#: A cut may miss its goal by this share of a shard.
TOLERANCE = 0.001
#: A group of equal texts up to this share of a shard stays whole.
GROUP = 0.02
DIMENSIONS = ("source", "lang", "bytes")
DIGIT = 16
#: Digits of the two parts of a split key: dimension and text, and document.
FIRST, SECOND = 4, 2


@dataclass
class Node:
    """Shards ``low`` to ``high - 1``, and the key where the right half begins."""

    low: int
    high: int
    rows: Column
    key: Column | None = None
    goal: float = 0.0
    below: float = 0.0
    prefix: int = 0
    cut: tuple[int, int] | None = None
    first: int = 0


def _slim(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Metadata per document; dimensions and hashes are 31-bit numbers."""
    def code(name: str) -> Column:
        return F.shiftrightunsigned(F.crc32(F.col(name).cast("string").cast("binary")), 1) if name in docs.columns else F.lit(0).cast("long")
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long") + 1
    content = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        code("source").cast("long").alias("source"), code("lang").cast("long").alias("lang"),
        F.least(size, F.lit(2**31 - 1).cast("long")).alias("bytes"), F.shiftrightunsigned(content, 33).alias("content"),
        F.shiftrightunsigned(F.xxhash64(F.col(doc_id).cast("long"), content, F.lit(3)), 33).alias("own"))


def _by_group(slim: DataFrame) -> DataFrame:
    """Every document with the metadata of its group of equal texts."""
    groups = slim.groupBy("content", "size").agg(*[F.coalesce(F.min(d), F.lit(0)).cast("long").alias(d) for d in ("source", "lang")])
    return slim.drop("source", "lang").join(groups, ["content", "size"])


def _split(slim: DataFrame, nodes: list[Node], spans: dict[str, float], shard_bytes: float) -> None:
    """Finds the cut of every node; the driver gets a few numbers per node and digit."""
    of = F.lit(None).cast("int")
    for i, n in enumerate(nodes):
        of = F.when(n.rows, i).otherwise(of)
    placed = slim.withColumn("node", of).where("node IS NOT NULL")
    ends = [f(d).alias(f"{name}_{d}") for d in DIMENSIONS for name, f in (("min", F.min), ("max", F.max))]
    told = {r["node"]: r for r in placed.groupBy("node").agg(F.sum("size").alias("size"), *ends).collect()}
    key = F.lit(None).cast("long")
    for i, n in enumerate(nodes):
        r = told.get(i)
        if r is None:
            n.cut = (0, 0)
            n.key = F.lit(0).cast("long")
            continue
        widest = max(DIMENSIONS, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / spans[d])
        n.key = F.shiftleft(F.col(widest), 31).bitwiseOR(F.col("content"))
        n.goal = r["size"] * ((n.high - n.low + 1) // 2) / (n.high - n.low)
        key = F.when(F.col("node") == i, n.key).otherwise(key)
    keyed = placed.select("node", "size", key.alias("first"), "own")
    for part, digits in (("first", FIRST), ("own", SECOND)):
        for step in range(digits - 1, -1, -1):
            open_nodes = [(i, n) for i, n in enumerate(nodes) if n.cut is None]
            if not open_nodes:
                return
            inside = F.lit(False)
            for i, n in open_nodes:
                here = F.col("node") == i
                if part == "own":
                    here &= F.col("first") == n.first
                if step < digits - 1:
                    here &= F.shiftright(part, DIGIT * (step + 1)) == n.prefix
                inside |= here
            digit = F.shiftright(part, DIGIT * step).bitwiseAND(F.lit(2**DIGIT - 1).cast("long"))
            sums = keyed.where(inside).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("size"))
            upto = F.sum("size").over(Window.partitionBy("node").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0))
            goal = F.element_at(F.create_map(*[F.lit(x) for i, n in open_nodes for x in (i, float(n.goal - n.below))]), F.col("node"))
            reached = sums.withColumn("upto", upto).where(F.col("upto") >= goal).groupBy("node").agg(F.min(F.struct("digit", "upto", "size")).alias("at"))
            for r in reached.collect():
                n, at = nodes[r["node"]], r["at"]
                before, after = n.below + at["upto"] - at["size"], n.below + at["upto"]
                last = part == "own" and step == 0
                left = n.goal - before <= after - n.goal
                border = (n.prefix << DIGIT | at["digit"]) + (not left) << DIGIT * step
                whole = part == "first" and step == 0 and at["size"] <= GROUP * shard_bytes
                if last or whole or min(n.goal - before, after - n.goal) <= TOLERANCE * shard_bytes:
                    n.cut = (border, 0) if part == "first" else (n.first, border)
                else:
                    n.prefix, n.below = n.prefix << DIGIT | at["digit"], before
        if part == "first":
            for n in nodes:
                n.first, n.prefix = n.prefix, 0


def kd_shards(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) per document; sizes of shards are nearly equal.

    Null texts have size 1. Equal texts share a shard unless their group is larger than a fiftieth of one and
    stands where a cut has to be; null and empty texts are equal. ``slot`` counts the documents of a shard from 0 without gaps. Null ids and repeated rows
    are documents like others; missing metadata counts as one value; an empty table gives an empty table.
    """
    slim = materialize(_by_group(materialize(_slim(docs, text, doc_id), "metadata")), "group-metadata")
    total = slim.agg(F.sum("size").alias("size"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).head()
    spans = {d: float(total[d] or 0) or 1.0 for d in DIMENSIONS}
    leaves, waiting = [], [Node(0, shards, F.lit(True))]
    while waiting:
        leaves += [n for n in waiting if n.high - n.low == 1]
        waiting = [n for n in waiting if n.high - n.low > 1]
        if waiting and total["size"]:
            _split(slim, waiting, spans, total["size"] / shards)
        halves = []
        for n in waiting:
            middle = n.low + (n.high - n.low + 1) // 2
            a, b = n.cut or (0, 0)
            key = n.key if n.key is not None else F.lit(0).cast("long")
            right = (key > a) | ((key == a) & (F.col("own") >= b))
            halves += [Node(n.low, middle, n.rows & ~right), Node(middle, n.high, n.rows & right)]
        waiting = halves
    shard = F.lit(None).cast("int")
    for n in leaves:
        shard = F.when(n.rows, n.low).otherwise(shard)
    return with_slots(slim.select("doc_id", "size", "text_crc32", shard.alias("shard")), shards)


def with_slots(rows: DataFrame, shards: int) -> DataFrame:
    """``slot`` by a two-pass prefix sum: running counts inside input splits, then what precedes each split."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            local = np.empty(len(shard), np.int64)
            for s in np.unique(shard):
                own = np.flatnonzero(shard == s)
                local[own] = seen[s] + np.arange(len(own))
                seen[s] += len(own)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), part, np.int32)), pa.array(local)],
                                             [*batch.schema.names, "part", "local"])
    schema = "doc_id long, size long, text_crc32 long, shard int, part int, local long"
    counted = materialize(rows.mapInArrow(run, schema), "shard-rows")
    bases = partition_bases(counted.select("shard", "part", F.lit(1).cast("long").alias("n")), "part", "n", ["shard"])
    return counted.join(F.broadcast(bases), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("local")).alias("slot"))
