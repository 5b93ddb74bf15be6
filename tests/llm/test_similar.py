"""The pipeline's near-copy stage against all pairs."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np

import corpus_pipeline
from txnwatch.llm import similar, substrings


def test_near_copy_stage_equals_all_pairs(spark):
    """Copies with scattered edits, on both sides of 0.8, chains, exact copies, short and empty texts, null ids."""
    rng, table = random.Random(21), []
    for family in range(40):
        words = [f"w{rng.randrange(400)}" for _ in range(200)]
        for edits in (0, 1, 2, 3, 4, 5, 6):
            own = words.copy()
            for at in rng.sample(range(200), edits):
                own[at] = f"x{rng.randrange(10**6)}"
            table.append((len(table), " ".join(own)))
    table += [(1000, table[0][1]), (1001, table[0][1].upper()), (1002, None), (1003, ""), (1004, " \n"), (1005, "two words"), (1006, "Two words."),
              (1007, "other words"), (None, "two words"), (None, "alone without an id")]
    sets = []
    for _, text in table:
        words = [w.lower().strip(".") for w in (text or "").split()]
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))})
    near = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    label = np.arange(len(table))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    groups = {}
    for (i, _), x in zip(table, label.tolist(), strict=True):
        groups.setdefault(x, []).append(i)
    want = Counter(min((i for i in g if i is not None), default=None) for g in groups.values())
    assert 45 < len(groups) < 280  # some copies hang together, some edits are too many
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(table, "doc_id long, text string").repartition(4), "")
    assert kept.columns == ["doc_id", "text"]
    assert Counter(r["doc_id"] for r in kept.collect()) == want
    assert corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0


def test_short_units_have_band_keys():
    codes = np.arange(2, 20, 2, dtype=np.uint64)
    seeds = substrings.seeds_of(3, 2)
    keys = substrings.band_keys(codes, [(0, 2), (2, 7), (0, 2)], seeds, 3, 2, 5)
    assert keys.shape == (3, 3) and (keys[0] == keys[2]).all() and (keys[0] != keys[1]).all()


def test_neighbours_by_fingerprint_are_compared(spark):
    """With hardly any band keys, all links between fingerprints within the radius are found, and no others are made."""
    rng, texts = random.Random(5), []
    for _ in range(60):
        words = [f"w{rng.randrange(400)}" for _ in range(300)]
        own = words.copy()
        own[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts += [" ".join(words), " ".join(own)]
    codes = [substrings.paragraphs(t)[0] & ~np.uint64(1) for t in texts]
    prints = [similar.fingerprint(c) for c in codes]
    hashes = substrings.shingles(codes[0]).tolist()  # all distinct here
    assert len(hashes) == 296 and prints[0] % 2**64 == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    near = [i for i in range(0, 120, 2) if ((prints[i] ^ prints[i + 1]) % 2**64).bit_count() <= similar.RADIUS]
    assert len(near) > 30
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    root = {r.doc.id: r.root for r in similar.near_copies(docs, recall=0.001).collect()}
    assert all(root[i] == root[i + 1] for i in near) and len(set(root.values())) <= 120 - len(near)
    assert all(root[i] != root[j] for i in range(120) for j in range(i) if i // 2 != j // 2)
