"""Fund tracing over several hops, for any number of starting customers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.operators.ranking import top_n
from txnwatch.session import cut_lineage

DEFAULT_HOPS, MOST_HOPS, EDGES_PER_HOP = 5, 10, 100


def _ranked_edges(edges: DataFrame, forward: bool, n: int) -> DataFrame:
    """The ``n`` largest payments per customer; all others are dropped before the shuffle, so a hot customer
    stays bounded."""
    near, far = ("customer_id", "counterparty_id") if forward else ("counterparty_id", "customer_id")
    facing = edges.filter(F.col(near).isNotNull() & F.col(far).isNotNull()).select(
        F.col(near).alias("node"), F.col(far).alias("party"), "txn_id", "amount_usd")
    return top_n(facing, ["node"], [F.col("amount_usd").desc(), F.col("txn_id")], n)


def strongest_edges(edges: DataFrame, forward: bool = True, n: int = EDGES_PER_HOP) -> DataFrame:
    """Per customer its ``n`` largest payments out (forward) or in (backward), as one sorted array."""
    return _packed(_ranked_edges(edges, forward, n))


def _packed(ranked: DataFrame) -> DataFrame:
    packed = F.array_sort(F.collect_list(F.struct("rank", "party", "txn_id", "amount_usd")))
    return ranked.groupBy("node").agg(packed.alias("edges"))


def _adjacency(ranked: DataFrame, n: int) -> DataFrame:
    """One array row per customer from its ``n + 1`` largest payments; the last only tells that some were left out.

    Of several payments to one party only the largest can count in a walk.
    """
    nth = F.row_number().over(Window.partitionBy("node", "party").orderBy("rank"))
    kept = ranked.withColumn("nth", nth).filter((F.col("nth") == 1) | (F.col("rank") > n))
    used = F.when((F.col("nth") == 1) & (F.col("rank") <= n), F.struct("rank", "party", "txn_id", "amount_usd"))
    packed = kept.groupBy("node").agg(F.array_sort(F.collect_list(used)).alias("edges"), (F.max("rank") > n).alias("cut"))
    told = F.transform("edges", lambda e: F.struct(*[e[f].alias(f) for f in ("rank", "party", "txn_id", "amount_usd")], F.col("cut").alias("truncated")))
    return packed.select("node", told.alias("edges"))


def trace(starts: DataFrame, edges: DataFrame, hops: int = DEFAULT_HOPS, forward: bool = True, edges_per_hop: int = EDGES_PER_HOP,
          most_hops: int = MOST_HOPS) -> DataFrame:
    """Per start and hop the payments to newly reached parties; the walk continues from the largest one.

    A hop looks at the ``edges_per_hop`` largest payments of the customer it stands at; ``truncated`` tells whether
    that customer has more. More than ``most_hops`` hops are refused, as no walk is cut in silence.

    Each hop is one join of the frontier (a row per start) with one array row per customer. The adjacency is
    checkpointed once and keeps its partitioning, so every hop shuffles the frontier only.
    """
    hops = DEFAULT_HOPS if hops <= 0 else hops
    if hops > most_hops:
        raise ValueError(f"{hops} hops asked for, {most_hops} allowed")
    adjacent = cut_lineage(_adjacency(_ranked_edges(edges, forward, edges_per_hop + 1), edges_per_hop))
    walk = starts.select(F.col("customer_id").alias("start_id")).distinct().withColumns({
        "at": F.col("start_id"), "seen": F.array("start_id")})
    kind = adjacent.schema["edges"].dataType
    for hop in range(1, hops + 1):
        found = walk.join(adjacent, F.col("at") == F.col("node"), "left")
        fresh = F.filter("edges", lambda e: ~F.array_contains(F.col("seen"), e["party"]))
        found = found.withColumn(f"hop{hop}", F.coalesce(fresh, F.array().cast(kind)))
        gained = F.col(f"hop{hop}")
        walk = found.withColumns({
            "at": F.when(F.size(gained) > 0, gained[0]["party"]),
            "seen": F.concat("seen", F.transform(gained, lambda e: e["party"])),
        }).drop("node", "edges")
        if hop % 3 == 0 and hop < hops:
            walk = cut_lineage(walk)

    def numbered(hop: int) -> Column:
        return F.transform(F.col(f"hop{hop}"), lambda e: F.struct(F.lit(hop).cast("bigint").alias("hop"), e.alias("e")))

    every = F.flatten(F.array(*[numbered(hop) for hop in range(1, hops + 1)]))
    return walk.select("start_id", F.explode(every).alias("x")).select(
        "start_id", F.col("x.hop").alias("hop"), F.col("x.e.party").alias("party"),
        F.col("x.e.txn_id").alias("txn_id"), F.col("x.e.amount_usd").alias("amount_usd"), F.col("x.e.truncated").alias("truncated"))


def trace_alerted(alerts: DataFrame, edges: DataFrame, hops: int = DEFAULT_HOPS, forward: bool = True) -> DataFrame:
    """Trace every customer with an alert of MEDIUM severity or worse."""
    risky = alerts.filter(F.col("severity").isin("MEDIUM", "HIGH", "CRITICAL"))
    return trace(risky.select("customer_id"), edges, hops, forward)
