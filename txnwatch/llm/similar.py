"""Near copies by SimHash in Gray order, checked by exact Jaccard similarity of word shingles.

Every distinct text gets a SimHash fingerprint of its shingles, and the index of :mod:`txnwatch.llm.simhash` finds all
fingerprints within ``RADIUS`` bits: those that hang together are one bucket. Texts at the wanted similarity may differ
in more bits than any index can search, so each also gets MinHash band keys, tuned to a wanted recall at the similarity.
Texts that share a bucket or a key are compared exactly, without listing the pairs of a bucket, and components of the
links that hold are the groups of near copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.common import materialize, release, row_key, text_slices
from txnwatch.llm.simhash import BITS, link_fingerprints
from txnwatch.llm.substrings import RECALL, SHINGLE, SIMILARITY, band_keys, paragraphs, runs, seeds_of, similar_units, tune_bands

#: Bits in which fingerprints of one bucket's neighbours differ at most.
RADIUS = 3


def fingerprint(codes: np.ndarray, shingle: int = SHINGLE) -> int:
    """Majority bits of the hashes of word shingles, repeats included; no words have 0, few words a single shingle."""
    if not len(codes):
        return 0
    hashes = runs(codes, min(shingle, len(codes)))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at:at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def _texts(bands: int, rows: int, shingle: int):
    """The whole text of every document as one unit, with its words, fingerprint and band keys; texts without words are alike."""
    seeds = seeds_of(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            length, unit, prints, keys = [], [], [], []
            for text in batch.column("text").to_pylist():
                codes = paragraphs(text or "")[0] & ~np.uint64(1)
                n = len(codes)
                length.append(n)
                unit.append(xxhash.xxh64_intdigest(codes.tobytes(), n))
                prints.append(fingerprint(codes, shingle))
                keys.append(band_keys(codes, [(0, n)], seeds, bands, rows, shingle)[0] if n else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(np.zeros(len(length)), pa.int32()), pa.array(length, pa.int32()),
                 pa.array(np.array(unit, np.uint64).astype(np.int64)), pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["doc", "start", "length", "unit", "fingerprint", "keys"])
    return run


_TEXTS = "doc struct<id: bigint, content: bigint>, start int, length int, unit long, fingerprint long, keys array<bigint>"


def _simhash_buckets(distinct: DataFrame, radius: int) -> DataFrame:
    """(unit, key): equal keys where fingerprints within ``radius`` bits connect the texts."""
    roots = link_fingerprints(distinct.select("fingerprint").distinct(), radius)
    key = F.xxhash64(F.coalesce("root", "fingerprint")).alias("key")
    buckets = materialize(distinct.select("unit", "fingerprint").join(roots, F.col("fingerprint") == F.col("node"), "left").select("unit", key), "simhash-buckets")
    release(roots)
    return buckets


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc, root) per document of ``docs`` (doc_id, text): equal where links of ``similarity`` or more connect texts.

    No link between fingerprints within ``radius`` bits is lost; those of other texts are found with ``recall``. Words are compared without case and edge punctuation. A text of fewer than ``shingle`` words is one shingle; null,
    empty and blank texts are one group. Repeated rows are rows of their own. An empty table gives an empty table.
    """
    bands, rows = tune_bands(similarity, recall)
    slim = docs.select(row_key().alias("doc"), "text")
    texts = materialize(slim.mapInArrow(_texts(bands, rows, shingle), _TEXTS), "texts")
    # equal texts, which may be a third of all, are one entry of the index
    first = texts.groupBy("unit").agg(F.min(F.struct("doc", "start", "length", "fingerprint", "keys")).alias("f")).select("unit", "f.*")
    distinct = materialize(first, "distinct-texts")
    buckets = _simhash_buckets(distinct, radius)
    components = similar_units(docs.select("doc_id", "text"), distinct, similarity, shingle, buckets)
    roots = materialize(components, "text-groups")
    release(distinct, buckets, components)
    return texts.select("doc", "unit").join(roots.withColumnRenamed("node", "unit"), "unit", "left").select("doc", F.coalesce("root", "unit").alias("root"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, shingle: int = SHINGLE) -> DataFrame:
    """The documents, all columns, with one of each group of near copies: the smallest id, of equal ids any one row.

    The choice is made on the slim table; texts move once, to meet the list of rows that stay.
    """
    # the struct order puts null ids first; the flag puts them last
    best = near_copies(docs, similarity, recall, shingle).groupBy("root").agg(F.min(F.struct(F.col("doc.id").isNull().alias("none"), "doc")).alias("best"))
    stay = best.select(F.col("best.doc").alias("_doc"))
    packed = docs.select(F.struct("*").alias("_row"), row_key().alias("_doc"))
    one = Window.partitionBy("_doc").orderBy(F.lit(1))
    kept = packed.join(stay, "_doc", "left_semi").withColumn("_nth", F.row_number().over(one)).where("_nth = 1")
    return kept.select("_row.*")
