"""Text counts against plain Python, and learned rules against planted ones, a plain threshold search and held-out labels."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from txnwatch.llm import quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_counts(text: str | None) -> tuple[int, ...]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def texts() -> list[str | None]:
    rng = random.Random(8)
    parts = ["a", "b", "c", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\xa0", "é", "#", "|", "a b c", "A", "\n\n", "中"]
    found = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return [*found, None, "", " ", "one", "a b", "a b c", "a b c a b c", "x y z\nx y z", " ".join(str(i % 7000) for i in range(15000)), "w " * 20000, "x" * 50000]


def test_counts_equal_plain_python(spark):
    rows = [(i if i % 50 else None, t, "en", "s", 1) for i, t in enumerate(texts())] + [(7, "same row " * 9, "en", "s", 1)] * 3
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("n_words", "quality", "rule", "kept", "words"):
        frame = frame.withColumn(name, F.lit("clash"))
    found = quality.judge(quality.text_statistics(frame), []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    expected = Counter()
    for r in rows:
        counts = plain_counts(r[1])
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        expected[(r[0], *counts, failed, not failed)] += 1
    assert Counter(map(tuple, found.collect())) == expected


def test_windows_of_many_distinct_words():
    rng = np.random.default_rng(1)
    ids = np.concatenate([np.arange(1_000_050), rng.integers(0, 9, 400)])
    windows = Counter(zip(ids.tolist(), ids[1:].tolist(), ids[2:].tolist(), strict=False))
    inside = {i + k for i, w in enumerate(zip(ids.tolist(), ids[1:].tolist(), ids[2:].tolist(), strict=False)) if windows[w] > 1 for k in range(3)}
    assert quality.repeated_words(ids) == len(inside)


def labelled(n: int, seed: int, noise: float = 0.01) -> tuple[pd.DataFrame, np.ndarray]:
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({f: rng.random(n) for f in quality.FEATURES})
    bad = (rows["symbols_per_word"] > 0.8).to_numpy() | ((rows["upper_case_words"] > 0.6) & (rows["word_length"] <= 0.3)).to_numpy()
    return rows, bad ^ (rng.random(n) < noise)


def test_planted_rules_are_learned():
    rows, bad = labelled(6000, 1)
    rules = quality.learn(rows, bad, np.arange(6000) % 3 > 0)
    fresh, truth = labelled(4000, 2, noise=0)
    told = np.any([quality.covered(r, fresh) for r in rules], axis=0)
    assert (told & truth).sum() / told.sum() > 0.95 and (told & truth).sum() / truth.sum() > 0.95
    assert all(1 <= len(r) <= quality.MOST_CONDITIONS for r in rules)


def test_noise_gives_no_rule():
    rows, _ = labelled(3000, 3)
    assert quality.learn(rows, np.random.default_rng(4).random(3000) < 0.2, np.arange(3000) % 3 > 0) == []
    assert quality.learn(rows[:0], np.zeros(0, bool), np.zeros(0, bool)) == []


def test_best_condition_equals_all_thresholds():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        rows = pd.DataFrame({f: rng.integers(0, 6, 40) / 4 for f in quality.FEATURES})
        bad = rng.random(40) < 0.4

        def gain(condition, rows=rows, bad=bad):
            inside = condition.holds(rows)
            p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
            return p * (math.log2(p / (p + n)) - math.log2(bad.mean())) if p else 0.0
        every = [quality.Condition(f, s, t) for f in rows for s in (True, False) for t in np.unique(rows[f])[:-1]]
        assert math.isclose(gain(quality._best_condition(rows, bad)), max(map(gain, every)))


def test_list_is_one_ordered_conditional(spark):
    rules = [(quality.Condition("symbols_per_word", False, 0.5),), (quality.Condition("words", True, 60), quality.Condition("word_length", False, 2.0))]
    texts_ = {1: "word# " * 4 + " ".join(f"w{i}#" for i in range(60)), 2: " ".join(f"word{i}" for i in range(55)), 3: " ".join(f"word{i}" for i in range(90)), 4: "few"}
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts_.items()], DOCS)
    told = {r["doc_id"]: (r["rule"], r["kept"], r["base_failed"]) for r in quality.judge(quality.text_statistics(frame), rules).collect()}
    assert told == {1: (1, False, False), 2: (2, False, False), 3: (None, True, False), 4: (None, False, True)}
    assert quality.keep_good(frame, rules).collect() == [tuple(r) for r in frame.where("doc_id = 3").collect()]
    assert quality.rule_texts(rules) == ["symbols_per_word > 0.5", "words <= 60 and word_length > 2"]


def test_rules_of_the_labels_hold_on_other_documents(spark):
    """Half of the labels train; the other half tells."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    statistics = quality.text_statistics(docs)
    rules = quality.learn_rules(statistics, labels.where("doc_id % 2 = 0"))
    told = quality.judge(statistics, rules).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").groupBy("quality", "kept").count().collect()
    count = {(r["quality"], r["kept"]): r["count"] for r in told}
    assert count.get((1, False), 0) <= 0.02 * count[1, True]
    print(count, quality.rule_texts(rules))


def test_labels_that_say_nothing(spark):
    docs = spark.createDataFrame([(1, "a " * 60, "en", "s", 1), (2, " ".join(map(str, range(80))), "en", "s", 1)], DOCS)
    for rows in ([], [(1, 1)], [(1, 0), (1, 1), (2, None), (None, 0)], [(1, 0), (2, 1)]):
        found = quality.judge_documents(docs, spark.createDataFrame(rows, "doc_id long, quality int"))
        assert {r["doc_id"]: r["kept"] for r in found.collect()} == {1: False, 2: True}
    assert quality.judge_documents(docs.limit(0), spark.createDataFrame([(1, 0)], "doc_id long, quality int")).count() == 0
