"""Approximate nearest neighbours by inner product through a hierarchical k-means tree.

The tree is fitted on a bounded sample; every vector is then put into a leaf. A query walks the tree best bin first:
a priority queue holds the branches seen so far by the distance of their centre, and leaves are visited in that
order. How many leaves are visited is calibrated: visits widen until queries of a sample, whose true neighbours are
known from a comparison with all rows, find a wanted share of these.

Inner products become distances by one more coordinate that gives all vectors the same length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.common import materialize

#: Expected number of vectors that the tree is fitted on.
SAMPLE = 8_000
BRANCHES, LEAF, ROUNDS = 8, 32, 12
#: Expected number of queries that the number of visits is calibrated on, and the share of neighbours they must find.
CALIBRATION, RECALL = 200, 0.96
#: Vectors of a leaf that one task compares; fuller leaves are split.
CHUNK = 20_000


@dataclass(frozen=True)
class Tree:
    """Centres of nodes, their children (empty for a leaf), and the common length."""

    centres: np.ndarray
    children: list[list[int]]
    length: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.length ** 2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """Leaf per vector, by the nearest centre on each level."""
        x, node = self.lifted(x), np.zeros(len(x), np.int64)
        waiting = np.arange(len(x)) if self.children[0] else np.arange(0)
        while len(waiting):
            for parent in np.unique(node[waiting]):
                own, kids = waiting[node[waiting] == parent], np.array(self.children[parent])
                apart = -2 * x[own] @ self.centres[kids].T + (self.centres[kids] ** 2).sum(axis=1)
                node[own] = kids[apart.argmin(axis=1)]
            waiting = waiting[[bool(self.children[n]) for n in node[waiting]]]
        return node

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves, best bin first."""
        target, found = np.append(query, 0.0), []
        queue: list[tuple[float, int]] = [(0.0, 0)]
        while queue and len(found) < most:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if not kids:
                found.append(node)
                continue
            for apart, kid in zip(((self.centres[kids] - target) ** 2).sum(axis=1).tolist(), kids, strict=True):
                heapq.heappush(queue, (apart, kid))
        return found


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Label per vector; the first centres are drawn far apart."""
    centres = x[[int(rng.integers(len(x)))]]
    for _ in range(k - 1):
        apart = np.min([((x - c) ** 2).sum(axis=1) for c in centres], axis=0)
        if not apart.sum() > 0:
            break
        centres = np.concatenate([centres, x[[int(rng.choice(len(x), p=apart / apart.sum()))]]])
    for _ in range(ROUNDS):
        label = (-2 * x @ centres.T + (centres ** 2).sum(axis=1)).argmin(axis=1)
        held = np.unique(label)
        centres = np.stack([x[label == i].mean(axis=0) for i in held])
    return np.unique(label, return_inverse=True)[1]


def fit_tree(sample: np.ndarray, length: float) -> Tree:
    """Splits until a node has ``LEAF`` vectors or fewer, or only copies of one."""
    tree, rng = Tree(np.empty((0, 0)), [], length), np.random.default_rng(7)
    x = tree.lifted(sample)
    centres, children, waiting = [x.mean(axis=0) if len(x) else np.zeros(1)], [[]], [(0, x)]
    while waiting:
        node, own = waiting.pop(0)
        if len(own) <= LEAF:
            continue
        label = _kmeans(own, BRANCHES, rng)
        if label.max(initial=0) == 0:
            continue
        for i in range(label.max() + 1):
            children[node].append(len(centres))
            centres.append(own[label == i].mean(axis=0))
            children.append([])
            waiting.append((len(centres) - 1, own[label == i]))
    return Tree(np.stack(centres), children, length)


def usable(vector: str) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(good, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 0))


def best_of(queries: np.ndarray, query_ids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, score) of the k nearest rows, ties to smaller ids, without the query's own row.

    A matrix product picks the rows near the k-th best; their scores are then summed in one fixed order, so that
    equal vectors have equal scores.
    """
    rough = queries @ x.T
    rough[query_ids[:, None] == ids[None, :]] = -np.inf
    room = min(k, x.shape[0])
    floor = np.partition(rough, x.shape[0] - room, axis=1)[:, x.shape[0] - room]
    slack = 1e-9 * (1 + np.abs(queries).sum(axis=1) * np.abs(x).max(initial=0))
    at_q, at_x, score = [], [], []
    for q in range(len(queries)):
        near = np.flatnonzero((rough[q] >= floor[q] - slack[q]) & (rough[q] > -np.inf))
        exact = (x[near] * queries[q]).sum(axis=1)
        best = np.lexsort((ids[near], -exact))[:k]
        at_q.append(np.full(len(best), q))
        at_x.append(near[best])
        score.append(exact[best])
    return tuple(np.concatenate(c) if c else np.empty(0, np.int64) for c in (at_q, at_x, score))


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_nearest(rows: DataFrame, queries: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    """(query_id, rank, vec_id, leaf, score) of a bounded set of queries against all rows (vec_id, vector, leaf), in blocks."""
    query_ids, q = queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, leaf = part.column("vec_id").to_numpy(), part.column("leaf").to_numpy()
                a, b, s = best_of(q, query_ids, _matrix(part, "vector"), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[a]), pa.array(ids[b]), pa.array(leaf[b]), pa.array(s, pa.float64())],
                                                 ["query_id", "vec_id", "leaf", "score"])
    return _nearest(rows.select("vec_id", "vector", "leaf").mapInArrow(run, "query_id long, vec_id long, leaf long, score double"), k)


def calibrated_visits(tree: Tree, queries: tuple[np.ndarray, np.ndarray], truth: pd.DataFrame, recall: float) -> int:
    """The fewest visits, doubling, with which the queries find ``recall`` of their true neighbours."""
    leaves = sum(1 for c in tree.children if not c)
    turn = {}
    for i, q in zip(*queries, strict=True):
        turn.update({(int(i), leaf): n for n, leaf in enumerate(tree.visits(q, leaves), 1)})
    needed = np.array([turn[pair] for pair in zip(truth["query_id"].tolist(), truth["leaf"].tolist(), strict=True)])
    visits = 1
    while visits < leaves and len(needed) and (needed <= visits).mean() < recall:
        visits = min(leaves, visits + max(1, visits // 4))
    return visits


def search(vectors: DataFrame, is_query: Column, k: int = 20, recall: float = RECALL, vec_id: str = "vec_id", vector: str = "embedding",
           sample: int = SAMPLE, calibration: int = CALIBRATION) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row for which ``is_query`` holds.

    Null, empty and zero vectors and those with null or non-finite components take no part, nor rows with a null id or
    of another dimension than most. Rows that repeat an id count as one vector, the one that sorts first. Fewer
    candidates than ``k`` give fewer ranks; no query or an empty table gives an empty table.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("query"))
    sizes = good.groupBy(F.size("vector").alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.max(F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).alias("length"))
    shape = sizes.orderBy(F.desc("rows"), "n").head()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape is None:
        return empty
    good = good.where(F.size("vector") == shape["n"]).groupBy("vec_id").agg(F.min(F.struct("vector", "query")).alias("v")).select("vec_id", "v.*")
    drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_003))
    share = int(1_000_003 * min(1.0, sample / shape["rows"])) + 1
    fitted = good.where(drawn < share).select("vec_id", "vector").toPandas().sort_values("vec_id")
    tree = fit_tree(np.array(fitted["vector"].tolist(), np.float64).reshape(len(fitted), -1), float(shape["length"]))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.leaf_of(_matrix(batch, "vector"))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "vector", "query")), pa.array(leaf, pa.int64())], ["vec_id", "vector", "query", "leaf"])
    rows = materialize(good.mapInArrow(assign, "vec_id long, vector array<double>, query boolean, leaf long"), "leaves")
    counts = {r["leaf"]: (r["n"], r["q"]) for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.count_if("query").alias("q")).collect()}
    n_queries = sum(q for _, q in counts.values())
    if not n_queries:
        return empty
    tried = rows.where("query").where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1_000_003)) < int(1_000_003 * min(1.0, calibration / n_queries)) + 1)
    tried = tried.select("vec_id", "vector").toPandas().sort_values("vec_id")
    probes = (tried["vec_id"].to_numpy(np.int64), np.array(tried["vector"].tolist(), np.float64).reshape(len(tried), -1))
    truth = exact_nearest(rows, probes, k).select("query_id", "leaf").toPandas() if len(tried) else pd.DataFrame({"query_id": [], "leaf": []})
    visits = calibrated_visits(tree, probes, truth, recall)
    chunks = {leaf: -(-n // CHUNK) for leaf, (n, _) in counts.items()}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, leaf, chunk = batch.column("vec_id").to_numpy(), [], [], []
            for i, q in enumerate(_matrix(batch, "vector")):
                for target in tree.visits(q, visits):
                    for c in range(chunks.get(target, 0)):
                        at.append(i), leaf.append(target), chunk.append(c)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), batch.column("vector").take(pa.array(at, pa.int64())), pa.array(leaf, pa.int64()), pa.array(chunk, pa.int32())],
                                             ["query_id", "vector", "leaf", "chunk"])
    asked = rows.where("query").select("vec_id", "vector").mapInArrow(walk, "query_id long, vector array<double>, leaf long, chunk int")
    split = {leaf: n for leaf, n in chunks.items() if n > 1}
    parts = F.coalesce(F.create_map(*[F.lit(x) for pair in split.items() for x in pair])[F.col("leaf")], F.lit(1)) if split else F.lit(1)
    stored = rows.select("vec_id", "vector", "leaf", F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("chunk"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        q, x = np.stack(left["vector"].to_numpy()), np.stack(right["vector"].to_numpy())
        query_ids, ids, found = left["query_id"].to_numpy(), right["vec_id"].to_numpy(), []
        for at in range(0, len(q), 256):
            a, b, s = best_of(q[at:at + 256], query_ids[at:at + 256], x, ids, k)
            found.append(pd.DataFrame({"query_id": query_ids[at:at + 256][a], "vec_id": ids[b], "score": s}))
        return pd.concat(found)
    met = asked.groupBy("leaf", "chunk").cogroup(stored.groupBy("leaf", "chunk")).applyInPandas(compare, "query_id long, vec_id long, score double")
    return _nearest(met, k).select("query_id", "rank", "vec_id", "score")
