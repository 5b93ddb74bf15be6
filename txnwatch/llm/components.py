"""Connected components by alternating large and small stars.

Every round is two aggregations with partial sums and two equi-joins on the edge table; no neighbour list is ever
collected, so the centre of a huge component costs a skewed join that run-time splitting handles, never one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.common import materialize, release


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node move to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moved = both.join(_lowest(both), "a").where("b > a")
    return moved.select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of a node, and the node, move to the smallest of them. Needs ``a > b``."""
    low = _lowest(edges)
    moved = edges.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has a single edge to a root that has none itself; such edges are what a round would give back."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").count()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: same orderable type) to (node, root): the root is the smallest node that can be reached.

    Loops, repeated edges and edges with a null end are ignored; nodes without any edge do not appear. The result reads
    the edge table of the last round, which ``release`` removes; those of the rounds before are gone.
    """
    table = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(table):
        old = table
        table = materialize(_small_star(_large_star(table)), "edges")
        release(old)
    roots = table.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = roots.union(table.select(F.col("b"), F.col("b")).distinct())
    found.work_path = table.work_path
    return found
