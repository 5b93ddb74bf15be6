"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability from a linear model over character n-grams of its
words; noisy-or combines them, so one offending sentence is enough. The model is trained from document labels only,
and afterwards points at the sentences that made a document toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.common import kept_in_worker, materialize, row_key, text_slices

#: Expected number of labelled documents per class that train the model, taken by the hash of their id.
SAMPLE_PER_CLASS = 6_000
#: Features of the model.
FEATURES = 4_000
#: A feature must occur in so many sampled documents.
SUPPORT = 5
KEPT_WORDS = 400_000
THRESHOLD = 0.7
_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W_]+")


def grams(word: str) -> set[str]:
    """The word with its borders, and its n-grams of 3 to 5 characters."""
    framed = f"^{word}$"
    return {framed, *(framed[i:i + n] for n in (3, 4, 5) for i in range(len(framed) - n + 1))}


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of the parts between full stops and line breaks that have words."""
    found = ((m.start(), m.end(), _WORD.findall(m.group().lower())) for m in _SENTENCE.finditer(text))
    return [s for s in found if s[2]]


@dataclass(frozen=True)
class Model:
    """Weights of features, and of a sentence without any."""

    weights: dict[str, float]
    bias: float
    name: str

    def word_weight(self, word: str) -> float:
        known = kept_in_worker(f"toxicity {self.name}", dict)
        found = known.get(word)
        if found is None:
            if len(known) >= KEPT_WORDS:
                known.clear()
            get = self.weights.get
            # in a fixed order, as the last bits of a sum depend on it
            found = known[word] = float(sum(get(g, 0.0) for g in sorted(grams(word))))
        return found

    def evidence(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or score of a text, and (start, end, probability) of its offending sentences."""
        words = set(_WORD.findall(text.lower()))
        marked = {w for w in words if self.word_weight(w)}
        idle = float(np.logaddexp(0, self.bias))
        if not marked:
            total = idle * sum(1 for s in _SENTENCE.findall(text) if not s.isspace())
            return 1 - float(np.exp(-total)), []
        bags = sentences(text)
        scores = np.array([self.bias + sum(self.word_weight(w) for w in own if w in marked) for _, _, own in bags])
        chance = 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
        spans = [(bags[i][0], bags[i][1], float(chance[i])) for i in np.flatnonzero(chance >= 0.5)]
        return 1 - float(np.exp(-np.logaddexp(0, scores).sum())), spans


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per feature and label in a partition."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    for batch in text_slices(batches):
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
            seen[label].update({g for w in set(_WORD.findall((text or "").lower())) for g in grams(w)})
    keys = sorted(set(seen[0]) | set(seen[1]))
    for at in range(0, len(keys), 20_000):
        some = keys[at:at + 20_000]
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array([seen[y][k] for k in some], pa.int64()) for y in (0, 1))], ["feature", "clean", "toxic"])


def _bags(index: dict[str, int]):
    """Per sampled document: sentences without features, and the features of the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            idle, bags = [], []
            for text in batch.column("text").to_pylist():
                own = [[index[g] for w in words for g in grams(w) if g in index] for _, _, words in sentences(text or "")]
                bags.append([sorted(x) for x in own if x])
                idle.append(len(own) - len(bags[-1]))
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("order"), pa.array(idle, pa.int32()), pa.array(bags, pa.list_(pa.list_(pa.int32())))],
                                             ["label", "order", "idle", "bags"])
    return run


def _fit(label: np.ndarray, idle: np.ndarray, bag_doc: np.ndarray, entry_bag: np.ndarray, entry_feature: np.ndarray, n: int,
         steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on the noisy-or likelihood; both classes weigh the same."""
    docs, bags = len(label), len(bag_doc)
    share = np.where(label == 1, 0.5 / max(1, (label == 1).sum()), 0.5 / max(1, (label == 0).sum()))
    x, first, second = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    x[n] = -5.0
    for step in range(1, steps + 1):
        z = np.bincount(entry_bag, weights=x[entry_feature], minlength=bags) + x[n]
        total = np.bincount(bag_doc, weights=np.logaddexp(0, z), minlength=docs) + idle * np.logaddexp(0, x[n])
        slope = share * np.where(label == 1, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0)
        per_bag = slope[bag_doc] / (1 + np.exp(-np.clip(z, -500, 500)))
        grad = np.append(np.bincount(entry_feature, weights=per_bag[entry_bag], minlength=n),
                         per_bag.sum() + (slope * idle).sum() / (1 + np.exp(-x[n])))
        grad[:n] += decay * x[:n]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad ** 2
        x = x - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return x[:n], float(x[n])


def train(docs: DataFrame, known: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, features: int = FEATURES) -> Model:
    """Model from ``docs`` (doc_id, text) and ``known`` (doc_id, label 0/1), one row per id.

    Of each class a sample of expected size ``sample_per_class`` is taken by the hash of the id. That bounds the ids
    sent to the executors, the texts that are written for training, and what the driver gets: features found in them.
    Without toxic or clean rows the model knows no feature and scores 0 or nearly so. Rows with a null label or id
    are left out; equal rows count once.
    """
    rows = known.where("label IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, -30.0, f"none {sizes}")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003))
    kept = F.lit(False)
    for y, n in sizes.items():
        kept |= (F.col("label") == y) & (drawn < int(1_000_003 * min(1.0, sample_per_class / n)) + 1)
    texts = docs.select("doc_id", "text").join(F.broadcast(rows.where(kept)), "doc_id")
    sample = materialize(texts.withColumn("order", F.xxhash64("doc_id", "text")), "toxicity-sample")
    counted = (sample.select("text", "label").mapInArrow(_count_features, "feature string, clean long, toxic long")
               .groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    size = [min(n, sample_per_class) for _, n in sorted(sizes.items())]
    p, q = (F.col("toxic") + 0.5) / (size[1] + 1), (F.col("clean") + 0.5) / (size[0] + 1)
    best = (counted.where(F.col("toxic") + F.col("clean") >= min(SUPPORT, max(1, size[1] // 10)))
            .where(p > 2 * q).select("feature", ((p - q) / F.sqrt(p * (1 - F.least(p, F.lit(0.999))) / size[1] + q / size[0])).alias("z"))
            .orderBy(F.desc("z"), "feature").limit(features))
    index = {f: i for i, f in enumerate(sorted(r["feature"] for r in best.collect()))}
    bags = sample.mapInArrow(_bags(index), "label int, order long, idle int, bags array<array<int>>").toPandas().sort_values("order", kind="stable").drop_duplicates("order")
    own = list(bags["bags"])
    per_doc = np.array([len(b) for b in own], np.int64)
    flat = [x for b in own for x in b]
    per_bag = np.array([len(x) for x in flat], np.int64)
    entries = np.concatenate([np.asarray(x, np.int64) for x in flat]) if flat else np.empty(0, np.int64)
    weights, bias = _fit(bags["label"].to_numpy(), bags["idle"].to_numpy().astype(float), np.repeat(np.arange(len(own)), per_doc),
                         np.repeat(np.arange(len(flat)), per_bag), entries, len(index))
    held = {f: round(float(weights[i]), 6) for f, i in index.items() if abs(weights[i]) > 1e-3}
    return Model(held, round(bias, 6), f"{len(held)} {bias} {hash(tuple(sorted(held.items())))}")


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, score, spans) per row: probability of the label, and the offending sentences with theirs.

    Null, empty and wordless texts score 0 and have no span; repeated rows are scored alike; whole texts are read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in text_slices(batches):
            found = [model.evidence(t) if t else (0.0, []) for t in batch.column("text").to_pylist()]
            spans = [[{"start": s, "end": e, "score": p} for s, e, p in own] for _, own in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([f[0] for f in found], pa.float64()), pa.array(spans, kind)],
                                             ["doc", "score", "spans"])
    rows = docs.select(row_key(doc_id, text).alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc struct<id: bigint, content: bigint>, score double, spans array<struct<start: int, end: int, score: double>>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The documents that score below ``threshold``, all columns."""
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    schema = packed.select("_row").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            stay = [not t or model.evidence(t)[0] < threshold for t in batch.column("_text").to_pylist()]
            yield batch.filter(pa.array(stay, pa.bool_())).select(["_row"])
    return packed.mapInArrow(run, schema).select("_row.*")


def held_out(doc_id: str = "doc_id"):
    """One third of the ids, by checksum; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train_on_open_labels(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from the rows of ``labels`` (doc_id, toxic) whose ids are not held out. Several labels of an id: the highest."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    return train(docs, known)
