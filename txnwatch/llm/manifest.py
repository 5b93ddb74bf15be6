"""A Merkle manifest of a table, with nested-interval labels.

Rows are leaves. The leaves of a tree have ranks, and every node carries the interval of leaf ranks that it covers: a
node of level ``l`` covers ``FANOUT ** l`` ranks, the last one of a level fewer. So an ancestor is found by a join on
(tree, level bucket) with containment of intervals, and the siblings on the way are what is left of the parent's
interval without the node's own. Levels shrink geometrically: they are written bottom-up, and ancestors are attached
top-down, each node taking over what its parent has been given already.

The roots of all trees, in the order of their keys, are the leaves of one more tree above them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.common import materialize, partition_bases, release

FANOUT = 3
#: Ancestors of so many levels are attached by one plan.
CUT_LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value: no two rows have the same text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, fields)), 256)


def _digest(parts: Column) -> Column:
    """Digest of the concatenated hex digests of an array."""
    return F.sha2(F.array_join(parts, ""), 256)


def ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (tree, ...) with ``lo``, the rank in the tree from 0, and ``n``, the rows of the tree.

    Ranges of the whole order are sorted apart, so that a tree with a third of all rows is many tasks; a range knows
    from prefix sums over ranges how many rows of the tree precede it. Equal rows are told apart by their place.
    """
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = ["tree", *order, "_tie"]
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    table = materialize(placed.withColumn("_part", F.shiftright("_at", 33)), "manifest-order")
    parts = table.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    bases = partition_bases(parts, "_part", "_n", ["tree"]).withColumnRenamed("base", "_base")
    sizes = parts.groupBy("tree").agg(F.sum("_n").alias("n"))
    known = materialize(parts.drop("_n").join(bases, ["tree", "_part"]).join(sizes, "tree"), "manifest-ranges")
    found = table.join(known, ["tree", "_part"]).withColumn("lo", F.col("_at") - F.col("_first") + F.col("_base"))
    found = materialize(found.drop("_at", "_part", "_first", "_base"), "manifest-leaves")
    release(table, known)
    return found


def _levels(leaves: DataFrame) -> list[DataFrame]:
    """Nodes (tree, n, lo, hi, digest, children) of every level above ``leaves`` (tree, n, lo, digest)."""
    most = leaves.agg(F.max("n")).head()[0] or 0
    below, levels, width = leaves.select("tree", "n", "lo", (F.col("lo") + 1).alias("hi"), "digest"), [], 1
    while width < most:
        bucket = F.expr(f"lo div {width * FANOUT}")
        runs = below.where(F.col("n") > width).groupBy("tree", "n", bucket.alias("bucket")).agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("lo", "hi", "digest"))).alias("children"))
        below = materialize(runs.select("tree", "n", "lo", "hi", _digest(F.col("children.digest")).alias("digest"), "children"), "manifest-level")
        levels.append(below)
        width *= FANOUT
    return levels


def _tops(leaves: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the nodes that cover their whole tree."""
    whole = leaves.where("n = 1").select("tree", "digest")
    for level in levels:
        whole = whole.union(level.where("lo = 0 AND hi = n").select("tree", "digest"))
    return whole


def _attached(leaves: DataFrame, levels: list[DataFrame], crown: DataFrame) -> DataFrame:
    """``leaves`` with what ``crown`` (tree, path, ...) gives to their tree, and their own siblings in front of the path.

    ``path`` has a struct (left, right) per level from the bottom: the joined digests of the siblings on both sides.
    """
    given = [c for c in crown.columns if c not in ("tree", "path")]
    above: DataFrame | None = None
    for level in range(len(levels), -1, -1):
        nodes = leaves.withColumn("hi", F.col("lo") + 1) if level == 0 else levels[level - 1]
        own = nodes.columns
        top = F.col("hi") - F.col("lo") == F.col("n")
        found = nodes.where(top).join(crown, "tree").select(*own, *given, "path")
        if above is not None:
            # the bucket of the next level up, and containment of the interval
            width = FANOUT ** (level + 1)
            parents = above.select(F.col("tree").alias("p_tree"), F.expr(f"lo div {width}").alias("p_bucket"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"),
                                   F.col("children").alias("p_children"), F.col("path").alias("p_path"), *given)
            inside = ((F.col("tree") == F.col("p_tree")) & (F.expr(f"lo div {width}") == F.col("p_bucket"))
                      & (F.col("lo") >= F.col("p_lo")) & (F.col("hi") <= F.col("p_hi")))
            # the parent's interval without the node's own
            left = F.transform(F.filter("p_children", lambda c: c["hi"] <= F.col("lo")), lambda c: c["digest"])
            right = F.transform(F.filter("p_children", lambda c: c["lo"] >= F.col("hi")), lambda c: c["digest"])
            step = F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))
            met = nodes.where(~top).join(parents, inside).select(*own, *given, F.concat(F.array(step), F.col("p_path")).alias("path"))
            found = met.union(found)
        # a written table now and then keeps the plan short, whatever number of levels there is
        above = materialize(found, "manifest-above") if level and level % CUT_LEVELS == 0 else found
    return above


def folded(leaf: Column, path: Column) -> Column:
    """Root that follows from a leaf and the siblings on its way."""
    return F.aggregate(path, leaf, lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda step: F.array(step["left"], step["right"]))), ""), 256)


def build(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` (..., digest) with ``subroot``, ``root`` and ``path``: the manifest and the membership proof of every row.

    A tree per value of the column ``tree``; its leaves ascend by the columns ``order``, nulls first, then by digest.
    Nodes are runs of ``FANOUT`` adjacent nodes, the last one of a level fewer; a single leaf is its own root. Trees
    ascend by their value, null first, strings bytewise. Equal rows are leaves of their own. No rows give no rows.
    """
    named = rows.withColumn("tree", F.struct(F.col(tree).alias("key")))
    leaves = ranked(named, [*order, "digest"])
    levels = _levels(leaves)
    tops = _tops(leaves, levels).select(F.lit(0).alias("tree"), F.col("tree").alias("own"), "digest")
    tops = ranked(tops, ["own"])
    upper = _levels(tops)
    root = _tops(tops, upper).select("tree", F.array().cast("array<struct<left: string, right: string>>").alias("path"), F.col("digest").alias("root"))
    crown = _attached(tops, upper, root).select(F.col("own").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    crown = materialize(crown, "manifest-crown")
    release(tops, *upper)
    return _attached(leaves, levels, crown).drop("tree", "n", "lo", "hi")


def tampered(doc_id: Column) -> Column:
    """Whether the contract alters the text: even checksum of the decimal id; a null id is left alone."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def verified_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents, some of which lose line breaks.

    The manifest is that of the documents as they are. Then rows for which :func:`tampered` holds lose the line breaks
    of their text, and every row is checked with the siblings of the manifest. Null fields are told from empty ones;
    a null source is a source; rows with equal or null ids are leaves of their own, in the order of their digests.
    """
    now = F.when(tampered(F.col("doc_id")) & F.col("text").contains("\n"), F.translate("text", "\n", "")).otherwise(F.col("text"))
    own = [F.col(c) for c in FIELDS]
    leaves = docs.select("doc_id", "source", leaf_digest(own).alias("digest"), leaf_digest([*own[:-1], now]).alias("given"))
    digests = materialize(leaves, "manifest-digests")
    found = build(digests, "source", ["doc_id"])
    release(digests)
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                        folded(F.col("given"), F.col("path")).alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
