"""License scan as an exact set-similarity join, in DataFrame functions only.

Templates are sets of words, text blocks are sentences or lines. A block meets a template if it holds at least a
threshold share of the template's words. So does a span of words no longer than the template and what it may lack,
across any line breaks and across as many sentence ends as the template itself has inside: hard-wrapped text. Words are ordered by their frequency in all documents, rarest first; then a
block can only meet a template if it holds one of the template's first few words (prefix filter), if it has enough
template words at all (length filter), and if enough words follow the common one in both (positional filter).
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.common import row_key

THRESHOLD = 0.9
#: Phrases that always count, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Public license statements.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "You can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("reserved", "All rights reserved."),
]
_APART = r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+"
_BLOCK = r"\n|(?<=[.;!?])\s+"
_SENTENCE = r"(?<=[.;!?])\s+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def spaced(text: Column) -> Column:
    """The words of a text with single spaces around each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lowered(text), _APART, " ")), F.lit(" "))


def _count(text: Column, what: str) -> Column:
    return (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(what)))).cast("long")


def phrase_columns(words: str, phrases: dict[str, str]) -> dict[str, Column]:
    """n_words, n_base, first_word, last_word and base labels from a column made by :func:`spaced`."""
    text = F.col(words)
    n = F.when(text == "  ", F.lit(0).cast("long")).otherwise(_count(text, " ") - 1)
    n_base, starts, ends, labels = F.lit(0).cast("long"), [], [], []
    for phrase, label in phrases.items():
        mark, here = f" {phrase} ", text.contains(f" {phrase} ")
        n_base = n_base + F.when(here, F.size(F.split(text, f" {re.escape(phrase)}(?= )")) - 1).otherwise(0)
        starts.append(F.when(here, _count(F.substring_index(text, mark, 1), " ")))
        ends.append(F.when(here, n - _count(F.substring_index(text, mark, -1), " ") - len(phrase.split())))
        labels.append(F.when(here, label))
    every = [F.lit(None).cast("long")]  # least and greatest want two columns
    return {"n_words": n, "n_base": n_base.cast("long"), "first_word": F.least(*starts, *every, *every), "last_word": F.greatest(*ends, *every, *every),
            "base": F.array_compact(F.array(*labels).cast("array<string>"))}


def _table(spark, rows: list[Column]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*rows)))


#: Kind of a block that counts as a whole; other kinds are the sentence ends inside a run.
_WHOLE = -1


def _runs(sentences: Column, ends: int) -> Column:
    """All runs of ``ends + 1`` adjacent sentences; fewer sentences are one run."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(sentences) - ends, F.lit(1))), lambda i: F.array_join(F.slice(sentences, i, F.lit(ends + 1)), " "))


def _of_kind(blocks: Column, kind: int) -> Column:
    return F.transform(blocks, lambda block: F.struct(F.lit(kind).alias("kind"), block.alias("block")))


def _holds(words: Column, tokens: set[str]) -> Column:
    return F.arrays_overlap(words, F.array(*map(F.lit, sorted(tokens))))


def template_matches(docs: DataFrame, templates: list[tuple[str, str]], threshold: float = THRESHOLD) -> DataFrame:
    """(doc, found, share): labels of the templates that blocks or spans of a document meet, and the largest share.

    ``docs`` has (doc, text). What the driver reads are the frequencies of the templates' words, one number each.
    """
    listed = [(label, [w for w in re.split(_APART, text.lower()) if w], len(re.split(_SENTENCE, text.strip())) - 1) for label, text in templates]
    sets = sorted({(label, tuple(sorted(set(words))), len(words), ends) for label, words, ends in listed})
    vocabulary = sorted({w for _, words, _, _ in sets for w in words})
    spark = docs.sparkSession
    if not vocabulary:
        return docs.limit(0).select("doc", F.array().cast("array<string>").alias("found"), F.lit(0.0).alias("share"))
    known = F.array(*map(F.lit, vocabulary))
    words = F.split(F.col("spaced"), " ")
    wide = docs.select("doc", "text", spaced(F.col("text")).alias("spaced"))
    seen = {r["word"]: r["n"] for r in wide.select(F.explode(F.array_intersect(words, known)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    ordered = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    place = {w: i for i, w in enumerate(ordered)}
    rows, needed, prefixes = [], [], {}
    for label, own, n_words, ends in sets:
        own = sorted(own, key=place.__getitem__)
        need = math.ceil(threshold * len(own) - 1e-9)
        needed.append(need)
        for at, token in enumerate(own[:len(own) - need + 1]):
            prefixes.setdefault(ends, set()).add(token)
            for kind in (_WHOLE, ends):
                rows.append(F.named_struct(F.lit("token"), F.lit(token), F.lit("kind"), F.lit(kind), F.lit("label"), F.lit(label), F.lit("own"), F.array(*map(F.lit, own)),
                                           F.lit("t_at"), F.lit(at), F.lit("need"), F.lit(need), F.lit("reach"), F.lit(n_words + len(own) - need)))
    index = _table(spark, rows)
    # whole blocks, and for spans the runs of sentences that a template with so many sentence ends can stand in
    blocks = _of_kind(F.split("text", _BLOCK), _WHOLE)
    for ends, tokens in sorted(prefixes.items()):
        runs = _of_kind(_runs(F.split("text", _SENTENCE), ends), ends)
        if not ends:  # one sentence on one line is a block already
            runs = F.filter(runs, lambda r: r["block"].contains("\n"))
        blocks = F.concat(blocks, F.when(_holds(words, tokens), runs).otherwise(F.array().cast("array<struct<kind:int,block:string>>")))
    blocks = wide.where(_holds(words, set().union(*prefixes.values()))).select("doc", F.explode(blocks).alias("b")).select("doc", "b.*")
    blocks = blocks.select("doc", "kind", F.split(F.trim(spaced(F.col("block"))), " ").alias("block"))
    blocks = blocks.withColumn("held", F.array_intersect(F.array(*map(F.lit, ordered)), "block")).where(F.size("held") >= min(needed))
    met = blocks.select("doc", "kind", "block", "held", F.posexplode("held").alias("b_at", "token")).join(index, ["token", "kind"])
    met = met.where((F.least(F.size("own") - F.col("t_at"), F.size("held") - F.col("b_at")) >= F.col("need"))
                    & (F.size(F.array_intersect(F.slice("own", F.lit(1), F.col("t_at")), "held")) == 0))
    met = met.where(F.size(F.array_intersect("own", "held")) >= F.col("need"))
    # the most template words in a span; the best span starts at one of them
    starts = F.filter(F.sequence(F.lit(1), F.size("block")), lambda i: F.array_contains("own", F.get("block", i - 1)))
    span = F.array_max(F.transform(starts, lambda i: F.size(F.array_intersect("own", F.slice("block", i, F.col("reach"))))))
    met = met.withColumn("both", F.when(F.col("kind") == _WHOLE, F.size(F.array_intersect("own", "held"))).otherwise(span))
    met = met.where(F.col("both") >= F.col("need")).select("doc", "label", (F.col("both") / F.size("own")).alias("share"))
    return met.groupBy("doc").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD,
         text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places where a phrase's words stand consecutively, ``first_word`` and ``last_word`` are the
    smallest and largest start; ``labels`` adds those of templates that a block meets. ``score`` is 1 where a phrase
    stands, else the largest share of a template's words that a block holds if it reaches the threshold, else 0.

    Null, empty and wordless texts have 0 words, no labels and score 0; repeated rows are scanned alike.
    """
    rows = docs.select(row_key(doc_id, text).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = template_matches(rows, templates, threshold)
    # the one-element array keeps the words from being worked out again for every column
    base = rows.select("doc", F.explode(F.array(spaced(F.col("text")))).alias("spaced"))
    base = base.select("doc", *(c.alias(n) for n, c in phrase_columns("spaced", phrases).items()))
    both = base.join(found, "doc", "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    return both.select(F.col("doc.id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
                       F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
                       F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))
