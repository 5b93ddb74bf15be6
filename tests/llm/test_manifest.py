"""The manifest against a plain Merkle tree, on nulls, ties, repeated rows, clashing columns and one hot source."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from txnwatch.llm import manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text) -> str:
    said = [row[0], row[3], row[2], row[4], text]
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in said))


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Root, and per node its (left, right) siblings from the bottom."""
    at, paths = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for path, i in zip(paths, at, strict=True):
            path.append(("".join(runs[i // 3][:i % 3]), "".join(runs[i // 3][i % 3 + 1:])))
        nodes, at = [digest(*r) for r in runs], [i // 3 for i in at]
    return nodes[0], paths


def plain(rows: list[tuple]) -> Counter:
    trees = {}
    for r in rows:
        text = r[1]
        if text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        trees.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, text), r[0]))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    subs = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])]) for s in order}
    root, upper = climb([subs[s][0] for s in order])
    found = Counter()
    for s, above in zip(order, upper, strict=True):
        for x, path in zip(sorted(trees[s], key=lambda x: x[:3]), subs[s][1], strict=True):
            way, fold = path + above, x[3]
            for left, right in way:
                fold = digest(left, fold, right)
            found[x[4], x[2], subs[s][0], root, digest("".join(a + b for a, b in way)), fold, fold == root] += 1
    return found


def check(spark, rows):
    frame = spark.createDataFrame(rows, DOCS).repartition(3)
    for name in ("tree", "n", "lo", "hi", "digest", "path", "children", "root"):
        frame = frame.withColumn(name, F.lit("clash"))
    found = manifest.verified_documents(frame)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, found.collect())) == plain(rows)


def test_awkward_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a\nb", "plain", "", None, "é\n中", "x" * 5000]), rng.choice(["en", None]), rng.choice(["hot", "hot", "hot", "b", "Z", "ä", "", None]), rng.choice([None, 7]))
            for i in range(400)]
    check(spark, rows + [(5, "same\n", "en", "hot", 5)] * 7 + [(None, "no id\n", None, None, None), (9, "alone", "en", "lonely", 5), (-3, "below\nzero", "en", "b", 1)])


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_sizes(spark, n):
    check(spark, [(i, f"text\n{i}", "en", "one", i) for i in range(n)])


def test_no_rows(spark):
    assert manifest.verified_documents(spark.createDataFrame([], DOCS)).count() == 0
