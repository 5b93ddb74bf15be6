"""Quality rules: statistics of texts, and learned decision lists over them.

A pass over the texts leaves a slim table of counts. Labelled rows of it train an ordered list of rules by sequential
covering: a rule is a conjunction of thresholds that is grown on one part of the labels and pruned on another, rows
that it covers are put aside, and the next rule is learned from the rest. A rule that the second part doesn't confirm
ends the list. The list becomes one ordered conditional expression, so applying it needs no Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.common import materialize, text_slices

#: Expected number of labelled rows per class that rules are learned from, by the hash of their id.
SAMPLE_PER_CLASS = 30_000
#: A rule must be right on so large a share, smoothed, of the labelled rows that it was not grown on.
PRECISION = 0.9
MOST_CONDITIONS, MOST_RULES = 4, 16
LEAST_WORDS, MOST_REPEATED = 50, 50
_WORDS = re.compile(r"[^ \t-\r]+").findall
_SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_distinct_words")


#: What rules speak about, as SQL over the counts.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)", "upper_case_words": "n_upper_words / greatest(n_words, 1)",
    "duplicate_lines": "n_dup_lines / greatest(n_lines, 1)", "repeated_words": "n_repeat_words / greatest(n_words, 1)",
    "distinct_words": "n_distinct_words / greatest(n_words, 1)", "word_length": "word_chars / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)", "words": "CAST(n_words AS DOUBLE)"}


def repeated_words(ids: np.ndarray) -> int:
    """Places of ``ids`` that lie in a run of three which stands twice or more."""
    n = len(ids) - 2
    if n < 2:
        return 0
    span = int(ids.max()) + 1
    first = ids[:-1] * span + ids[1:]
    if span > 1_000_000:  # else three numbers fit into 63 bits
        first = np.unique(first, return_inverse=True)[1].astype(np.int64)
    _, group, size = np.unique(first[:-1] * span + ids[2:], return_inverse=True, return_counts=True)
    again = size[group] > 1
    inside = np.zeros(len(ids), bool)
    for k in range(3):
        inside[k:k + n] |= again
    return int(inside.sum())


def text_counts(text: str) -> tuple[int, ...]:
    """The :data:`COUNTS` of a text. Words stand between ASCII white space; lines without a word are not counted."""
    words = _WORDS(text)
    if not words:
        return (0, 0, sum(map(text.count, _SYMBOLS)), 0, 0, 0, 0, 0)
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return (len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(ids), len(lines),
            sum(map(str.isupper, words)), len(index))


def text_statistics(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, *COUNTS) per row. Null texts have no words; whole texts are read; repeated rows are rows of their own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = np.array([text_counts(t or "") for t in batch.column("text").to_pylist()], np.int64).reshape(batch.num_rows, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in found.T)], ["doc_id", *COUNTS])
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS)]))


def base_failed() -> Column:
    """Fewer than 50 words, or more than half of them in repeated runs of three."""
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    """``feature`` is at most ``threshold``, or greater."""

    feature: str
    at_most: bool
    threshold: float

    def holds(self, rows: pd.DataFrame) -> np.ndarray:
        values = rows[self.feature].to_numpy()
        return values <= self.threshold if self.at_most else values > self.threshold

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value <= self.threshold if self.at_most else value > self.threshold


Rule = tuple[Condition, ...]


def covered(rule: Rule, rows: pd.DataFrame) -> np.ndarray:
    found = np.ones(len(rows), bool)
    for condition in rule:
        found &= condition.holds(rows)
    return found


def between(low: float, high: float) -> float:
    """The shortest decimal from ``low`` on and below ``high``."""
    for digits in range(16):
        middle = round((low + high) / 2, digits)
        if low <= middle < high:
            return middle
    return low


def _best_condition(rows: pd.DataFrame, bad: np.ndarray) -> Condition | None:
    """The threshold of the largest information gain for the bad rows that stay covered."""
    p0, n0 = int(bad.sum()), int((~bad).sum())
    best, gain = None, 1e-9
    for feature in FEATURES:
        order = np.argsort(rows[feature].to_numpy(), kind="stable")
        values, hit = rows[feature].to_numpy()[order], np.cumsum(bad[order])
        cut = np.flatnonzero(values[:-1] < values[1:])
        if not len(cut):
            continue
        for at_most in (True, False):
            p = hit[cut] if at_most else p0 - hit[cut]
            n = (cut + 1 if at_most else len(values) - cut - 1) - p
            with np.errstate(divide="ignore", invalid="ignore"):
                worth = np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), 0)
            k = int(worth.argmax())
            if worth[k] > gain:
                best, gain = Condition(feature, at_most, between(float(values[cut[k]]), float(values[cut[k] + 1]))), worth[k]
    return best


def grow(rows: pd.DataFrame, bad: np.ndarray) -> Rule:
    """Conditions one after the other, until only bad rows are covered or nothing is gained."""
    rule: Rule = ()
    while len(rule) < MOST_CONDITIONS and bad.any() and not bad.all():
        condition = _best_condition(rows, bad)
        if condition is None:
            break
        rule += (condition,)
        inside = condition.holds(rows)
        rows, bad = rows[inside], bad[inside]
    return rule


def _told(rule: Rule, rows: pd.DataFrame, bad: np.ndarray) -> tuple[int, int]:
    inside = covered(rule, rows)
    return int((inside & bad).sum()), int((inside & ~bad).sum())


def prune(rule: Rule, rows: pd.DataFrame, bad: np.ndarray, precision: float) -> Rule:
    """The front part of a rule that does best on rows it was not grown on; of equal ones the shortest.

    Of parts that are precise enough, that is the one that rejects most bad rows net of good ones; else the most precise.
    """
    def worth(front: Rule) -> tuple[bool, float, int]:
        p, n = _told(front, rows, bad)
        share = (p + 1) / (p + n + 2)
        return share >= precision, p - n if share >= precision else share, -len(front)
    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)


def learn(rows: pd.DataFrame, bad: np.ndarray, growing: np.ndarray, precision: float = PRECISION) -> list[Rule]:
    """Ordered rules for bad rows, by sequential covering. ``growing`` marks the rows that rules are grown on."""
    rules: list[Rule] = []
    while len(rules) < MOST_RULES:
        rule = grow(rows[growing], bad[growing])
        if not rule:
            break
        rule = prune(rule, rows[~growing], bad[~growing], precision)
        p, n = _told(rule, rows[~growing], bad[~growing])
        if (p + 1) / (p + n + 2) < precision:
            break
        rules.append(rule)
        inside = covered(rule, rows)
        rows, bad, growing = rows[~inside], bad[~inside], growing[~inside]
    return rules


def learn_rules(statistics: DataFrame, labels: DataFrame, sample_per_class: int = SAMPLE_PER_CLASS, precision: float = PRECISION) -> list[Rule]:
    """Rules from ``statistics`` (doc_id, *COUNTS) of rows that pass the base rules and ``labels`` (doc_id, quality: 1 good, 0 bad).

    Other and null labels, ids with labels of both kinds and null ids take no part. The driver gets counts of a sample
    of expected size ``sample_per_class`` per class, no texts. Too few labels, or one class alone, give no rule.
    """
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("quality").alias("low"), F.max("quality").alias("quality")).where("low = quality").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    sizes = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return []
    drawn, kept = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)), F.lit(False)
    for quality, n in sizes.items():
        kept |= (F.col("quality") == quality) & (drawn < int(1_000_003 * min(1.0, sample_per_class / n)) + 1)
    rows = statistics.where(~base_failed()).join(known.where(kept), "doc_id")
    growing = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) > 0
    found = rows.select("doc_id", (F.col("quality") == 0).alias("bad"), growing.alias("growing"), *(F.expr(c).alias(n) for n, c in FEATURES.items())).toPandas()
    found = found.sort_values(["doc_id", *FEATURES], ignore_index=True)
    return learn(found[[*FEATURES]], found["bad"].to_numpy(bool), found["growing"].to_numpy(bool), precision)


def fired_rule(rules: list[Rule]) -> Column:
    """Number from 1 of the first rule that holds, else null: one ordered conditional expression."""
    told = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        holds = rule[0].column()
        for condition in rule[1:]:
            holds &= condition.column()
        told = F.when(holds, F.lit(number)).otherwise(told)
    return told


def rule_texts(rules: list[Rule]) -> list[str]:
    """The rules in words."""
    return [" and ".join(f"{c.feature} {'<=' if c.at_most else '>'} {c.threshold:g}" for c in rule) for rule in rules]


def judge(statistics: DataFrame, rules: list[Rule]) -> DataFrame:
    """``statistics`` with ``base_failed``, ``rule`` (the learned rule that rejects, if any) and ``kept``."""
    told = statistics.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), fired_rule(rules)))
    return told.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, *COUNTS, base_failed, rule, kept) per document, by rules learned from the labels of these documents."""
    statistics = materialize(text_statistics(docs), "text-statistics")
    return judge(statistics, learn_rules(statistics, labels))


def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The documents, all columns, that pass the base rules and all learned ones."""
    packed = docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    schema = packed.select("_row", *(F.lit(0).cast("long").alias(c) for c in COUNTS)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            found = np.array([text_counts(t or "") for t in batch.column("_text").to_pylist()], np.int64).reshape(batch.num_rows, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *(pa.array(c) for c in found.T)], ["_row", *COUNTS])
    return judge(packed.mapInArrow(run, schema), rules).where("kept").select("_row.*")
