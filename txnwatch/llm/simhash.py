"""SimHash near-duplicates through a hierarchical index in Gray order.

Documents become 64-bit fingerprints. Distinct fingerprints are dealt to groups that share some bits exactly
(pigeonhole over two levels of bit segments, so no pair within the radius is lost), sorted by Gray rank inside the
group, and joined in an index whose upper nodes hold the bits all entries below them share. A search carries the
differences found so far down the index and drops whole nodes once they exceed the radius. A group reports which
fingerprints hang together, never its pairs; components of these links are the groups of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.common import materialize, row_key, text_slices
from txnwatch.llm.components import connected_components

BITS = 64
FAN_OUT = 16
QUERIES_AT_ONCE = 256
#: Pairs of a query and an entry that a search may hold at once.
FRONTIER = 1_000_000
SEED = 42
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALL = np.uint64(2**64 - 1)


def simhash(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the hashes of word shingles; null and blank texts have 0, short ones a single shingle."""
    words = (text or "").encode().translate(ASCII_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(shingle, len(words))
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - width + 1].tolist()
    digest = xxhash.xxh64_digest
    hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1:].tolist(), strict=True)]
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.frombuffer(b"".join(hashes[at:at + 65536]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc: row key, fingerprint long), a row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = [simhash(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(found, pa.int64())], ["doc", "fingerprint"])
    rows = docs.select(row_key(doc_id, text).alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc struct<id: bigint, content: bigint>, fingerprint long")


def segment_masks(radius: int) -> list[int]:
    """Masks of which every pair within ``radius`` agrees on at least one.

    ``radius`` differences leave one of ``radius + 1`` segments untouched, and again one of ``radius + 1`` parts of
    the other bits. Both together are long enough to keep groups of unrelated fingerprints small.
    """
    parts = radius + 1
    masks = []
    for own in np.array_split(np.arange(BITS), parts):
        rest = np.setdiff1d(np.arange(BITS), own)
        masks += [sum(1 << int(i) for i in (*own, *more)) for more in np.array_split(rest, parts)]
    return masks


def gray_rank(bits: Column) -> Column:
    """Position of a bit pattern in the reflected Gray code.

    Folded over the widths: written out, each step would name the one before twice, 64 copies of ``bits`` in the plan.
    """
    return F.aggregate(F.array(*map(F.lit, (1, 2, 4, 8, 16, 32))), bits, lambda x, by: x.bitwiseXOR(F.call_function("shiftrightunsigned", x, by)))


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


class _Sets:
    """Union-find over positions."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return int(x)

    def link(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)

    def labels(self) -> np.ndarray:
        parent = self.parent
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                return parent
            parent = self.parent = up


def _levels(prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Index over fingerprints in Gray order, entries first: per node, shared bits as (mask, pattern)."""
    levels = [(np.full(len(prints), _ALL), prints)]
    ones, zeros = prints, ~prints
    while len(ones) > FAN_OUT:
        cuts = np.arange(0, len(ones), FAN_OUT)
        ones, zeros = np.bitwise_and.reduceat(ones, cuts), np.bitwise_and.reduceat(zeros, cuts)
        levels.append((ones | zeros, ones))
    return levels


def _uniform(labels: np.ndarray, depth: int) -> list[np.ndarray]:
    """Per level and node: the label that all entries below share, else -1."""
    out = [labels]
    low = high = labels
    for _ in range(depth - 1):
        cuts = np.arange(0, len(low), FAN_OUT)
        low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
        out.append(np.where(low == high, low, -1))
    return out


def linked_labels(prints: np.ndarray, radius: int) -> np.ndarray:
    """Label per fingerprint (distinct, in Gray order): equal where links within ``radius`` connect them.

    A search skips nodes whose accumulated differences exceed the radius, and nodes that are all of the query's
    own component already: these can add no connection.
    """
    sets = _Sets(len(prints))
    for i in np.flatnonzero(np.bitwise_count(prints[1:] ^ prints[:-1]) <= radius):
        sets.link(int(i), int(i) + 1)
    levels = _levels(prints)
    at_once = max(1, min(QUERIES_AT_ONCE, FRONTIER // len(prints)))
    for at in range(0, len(prints), at_once):
        labels = sets.labels()
        if not labels.any():  # all hang together already
            break
        same = _uniform(labels, len(levels))
        top = len(levels) - 1
        mine = np.arange(at, min(at + at_once, len(prints)), dtype=np.int32)
        width = len(levels[top][1])
        query, node = np.repeat(mine, width), np.tile(np.arange(width, dtype=np.int32), len(mine))
        apart = np.zeros(len(query), np.uint8)
        for level in range(top, -1, -1):
            fresh = levels[level][0][node]  # shared bits that the node above didn't have
            if level < top:
                fresh &= ~levels[level + 1][0][node // FAN_OUT]
            fresh &= prints[query] ^ levels[level][1][node]
            apart = apart + np.bitwise_count(fresh)
            keep = (apart <= radius) & (same[level][node] != labels[query])
            query, node, apart = query[keep], node[keep], apart[keep]
            if level:
                node = (node[:, None] * np.int32(FAN_OUT) + np.arange(FAN_OUT, dtype=np.int32)).ravel()
                inside = node < len(levels[level - 1][1])
                query, apart, node = np.repeat(query, FAN_OUT)[inside], np.repeat(apart, FAN_OUT)[inside], node[inside]
        for pair in np.unique(labels[query] * len(prints) + labels[node]).tolist():
            sets.link(*divmod(pair, len(prints)))
    return sets.labels()


def _group_links(radius: int):
    """Links inside each run of equal (part, shared); the input is sorted by (part, shared, Gray rank)."""
    def links(shared: np.ndarray, part: np.ndarray, prints: np.ndarray) -> np.ndarray:
        edge = np.flatnonzero((shared[1:] != shared[:-1]) | (part[1:] != part[:-1])) + 1
        starts, ends = np.concatenate(([0], edge)), np.concatenate((edge, [len(prints)]))
        size = ends - starts
        two = starts[size == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= radius]
        found = [np.stack([prints[two], prints[two + 1]], axis=1)]
        for s, e in zip(starts[size > 2], ends[size > 2], strict=True):
            own = prints[s:e]
            labels = linked_labels(own, radius)
            moved = np.flatnonzero(labels != np.arange(len(own)))
            found.append(np.stack([own[moved], own[labels[moved]]], axis=1))
        return np.concatenate(found).astype(np.int64) if found else np.empty((0, 2), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])
        held: list[list[np.ndarray]] = []
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("shared", "part", "fingerprint")]
            if not len(now[0]):
                continue
            fresh = (now[0] != now[0][-1]) | (now[1] != now[1][-1])
            cut = int(fresh.nonzero()[0][-1]) + 1 if fresh.any() else 0
            if cut:  # the last run may go on in the next batch
                held.append([x[:cut] for x in now])
                full, held = [np.concatenate(x) for x in zip(*held, strict=True)], []
                yield out(links(full[0], full[1], full[2].astype(np.uint64)))
            held.append([x[cut:] for x in now])
        if held:
            full = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield out(links(full[0], full[1], full[2].astype(np.uint64)))
    return run


def link_fingerprints(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Distinct ``fingerprint`` values to (node, root) for those with another within ``radius`` bits, directly or not."""
    masks = segment_masks(radius)
    value = F.col("fingerprint")
    dealt = prints.select(value, F.explode(F.array(*[
        F.struct(F.lit(i).alias("part"), value.bitwiseAND(F.lit(_signed(m))).alias("shared"),
                 gray_rank(value.bitwiseAND(F.lit(_signed(m ^ (2**64 - 1))))).alias("rank"))
        for i, m in enumerate(masks)])).alias("of")).select("fingerprint", "of.*")
    spread = dealt.repartition("part", "shared").sortWithinPartitions("part", "shared", "rank")
    links = spread.mapInArrow(_group_links(radius), "a long, b long")
    return connected_components(links)


def near_copies(docs: DataFrame, radius: int = 2, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, fingerprint, component_id) per document; the component is the smallest id that links can reach.

    Links join fingerprints that differ in ``radius`` bits or fewer. Null, empty and blank texts share fingerprint 0.
    Repeated rows are rows of their own. Ids are compared as numbers; a null id counts as larger than any, and a
    component without any id has null. An empty table gives an empty table.
    """
    rows = materialize(fingerprints(docs, shingle, text, doc_id), "fingerprints")
    prints = rows.groupBy("fingerprint").agg(F.min("doc.id").alias("low"))
    prints = materialize(prints, "distinct-fingerprints")
    roots = link_fingerprints(prints, radius)
    rooted = prints.join(roots, prints.fingerprint == roots.node, "left").select(
        "fingerprint", "low", F.coalesce("root", "fingerprint").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    ids = rooted.join(lowest, "root").select("fingerprint", "component_id")
    return rows.join(ids, "fingerprint", "left").select("doc", "fingerprint", "component_id")


def hex_print(fingerprint: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def drop_near_copies(docs: DataFrame, radius: int = 2, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents, all columns, with one of each group of near copies: the smallest id, of equal ids any one row.

    The choice is made on the slim table; texts move once, to meet the list of rows that stay.
    """
    groups = near_copies(docs, radius, shingle, text, doc_id)
    # the struct order puts null ids first; the flag puts them last
    best = groups.groupBy(F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("of"))
                          .alias("group")).agg(F.min(F.struct(F.col("doc.id").isNull().alias("none"), "doc")).alias("best"))
    stay = best.select(F.col("best.doc").alias("_doc"))
    packed = docs.select(F.struct("*").alias("_row"), row_key(doc_id, text).alias("_doc"))
    one = Window.partitionBy("_doc").orderBy(F.lit(1))
    kept = packed.join(stay, "_doc", "left_semi").withColumn("_nth", F.row_number().over(one)).where("_nth = 1")
    return kept.select("_row.*")
