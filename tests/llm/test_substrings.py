"""Repeats without sentences, in hard-wrapped paragraphs, and in short lines."""

from __future__ import annotations

import random
import textwrap

import numpy as np
import pyarrow as pa

from txnwatch.llm import substrings


def plain(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_every_run_of_fifty_words_is_removed_whole(spark):
    table, runs = [], {}
    for i in range(60):
        runs[i] = plain(i, 50 + i % 12)
        table += [(i, f"{plain(1000 + i, 70)} {runs[i]} {plain(2000 + i, 41)}"), (100 + i, f"{plain(3000 + i, 30 + i)} {runs[i]} {plain(4000 + i, 60)}")]
    cleaned = {r["doc_id"]: r["text"] for r in substrings.remove_repeats(spark.createDataFrame(table, "doc_id long, text string")).collect()}
    assert all(cleaned[i] == table[2 * i][1] for i in range(60))
    assert all(cleaned[100 + i].split() == f"{plain(3000 + i, 30 + i)} {plain(4000 + i, 60)}".split() for i in range(60))


def test_wrapped_and_short_paragraphs(spark):
    near = plain(1, 90).split()
    edited = [w if i % 50 else f"x{i}" for i, w in enumerate(near)]
    table = [(1, plain(2, 40) + "\n\n" + textwrap.fill(" ".join(near), 70)), (2, textwrap.fill(" ".join(edited), 55) + "\n\n" + plain(3, 40)),
             (3, plain(4, 30) + "\none line of five words\n" + plain(5, 30)), (4, plain(6, 9) + "\nOne line of five words."), (5, "only four words here"), (6, "only four words here")]
    frame = spark.createDataFrame(table, "doc_id long, text string")
    found = {(r["id"], r["cluster_doc"]) for r in substrings.repeated_passages(frame).where("removed AND kind = 'paragraph'").select("doc.id", "cluster_doc").collect()}
    assert found == {(2, 1), (4, 3)}
    cleaned = {r["doc_id"]: r["text"].split() for r in substrings.remove_repeats(frame).collect()}
    assert cleaned[2] == plain(3, 40).split() and cleaned[4] == plain(6, 9).split() and cleaned[5] == cleaned[6]


def test_lowest_of_every_span():
    hashes = np.random.default_rng(1).integers(0, 50, 300)
    found = substrings.lowest(hashes, 27)
    assert found.tolist() == sorted({i + int(hashes[i:i + 27].argmin()) for i in range(274)})
    assert len(substrings.lowest(hashes[:0], 27)) == 0 and len(substrings.lowest(hashes[:5], 27)) == 1


def test_equal_places_become_one(spark):
    place = "struct<id: bigint, content: bigint>"
    rows = [((2, 7), 3, 9, "paragraph", (1, 5), 0, True)] * 2 + [((2, 7), 3, 9, "paragraph", (1, 5), 40, True), ((2, 7), 3, 8, "paragraph", (1, 5), 0, True)]
    rows += [((2, 7), at, 24, "passage", (1, 5), at + 4, True) for at in (0, 0, 20, 44, 90)]
    found = spark.createDataFrame(rows, f"doc {place}, start int, length int, kind string, to_doc {place}, to int, removed boolean")
    joined = sorted((r["kind"], r["start"], r["length"], r["to"]) for r in substrings._joined(found).collect())
    assert joined == [("paragraph", 3, 8, 0), ("paragraph", 3, 9, 0), ("paragraph", 3, 9, 40), ("passage", 0, 68, 4), ("passage", 90, 24, 94)]


def test_pairs_are_compared_once_and_by_size_first(spark):
    rng = random.Random(4)
    sets = {u: sorted(rng.sample(range(14), rng.randrange(1, 14))) for u in range(60)}
    frame = spark.createDataFrame([(u, s, len(s)) for u, s in sets.items()], "unit long, sh array<bigint>, n int")
    pairs = [(a, b) for a in sets for b in sets if a < b]
    for similarity in (0.5, 0.8, 1.0):
        found = substrings._jaccard(spark.createDataFrame(pairs, "a long, b long"), frame, similarity)
        assert "array_intersect" in (plan := found._jdf.queryExecution().optimizedPlan().toString())
        assert plan.count("array_intersect") == 1
        both = {p: len(set(sets[p[0]]) & set(sets[p[1]])) for p in pairs}
        assert {(r["a"], r["b"]) for r in found.collect()} == {
            (a, b) for (a, b), n in both.items() if n >= similarity * (len(sets[a]) + len(sets[b]) - n)}


def test_places_of_a_cluster_are_not_tied_to_its_first(spark, monkeypatch):
    written = []
    monkeypatch.setattr(substrings, "materialize", lambda df, label, do=substrings.materialize: written.append(label) or do(df, label))
    table = [(i, plain(i, 30) + "\n" + plain(999, 60)) for i in range(4)]
    found = substrings.repeated_passages(spark.createDataFrame(table, "doc_id long, text string")).collect()
    assert "first-places" in written and {r["doc"]["id"] for r in found if r["removed"]} == {1, 2, 3}


def test_python_gets_few_texts_at_once_and_only_keys_are_broadcast(spark, monkeypatch):
    sent = []

    def watched(make):
        def made(*args):
            run = make(*args)

            def bounded(batches):
                def checked():
                    for batch in batches:
                        assert batch.num_rows <= 256, batch.num_rows
                        yield batch
                yield from run(checked())
            return bounded
        return made
    for name in ("_units", "_shingle_sets", "_sides"):
        monkeypatch.setattr(substrings, name, watched(getattr(substrings, name)))
    monkeypatch.setattr(substrings, "_bounded", lambda slim, do=substrings._bounded: sent.append(slim.columns) or do(slim))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    table = [(i, f"{plain(i, 30)} {plain(10**6 + i // 2, 60)}\n{plain(2 * 10**6 + i // 2, 8)}") for i in range(1200)]
    frame = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    removed = substrings.repeated_passages(frame).where("removed").select("doc.id", "kind").collect()
    assert {(r["id"], r["kind"]) for r in removed} == {(i, kind) for i in range(1, 1200, 2) for kind in ("paragraph", "passage")}
    assert sent == [["key"], ["unit"]] and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def documents(texts: list[str | None]) -> pa.RecordBatch:
    doc = pa.array([{"id": i, "content": i} for i in range(len(texts))], pa.struct([("id", pa.int64()), ("content", pa.int64())]))
    return pa.RecordBatch.from_arrays([doc, pa.array(texts, pa.string())], ["doc", "text"])


def test_words_of_many_texts_are_coded_from_their_bytes(monkeypatch):
    rng = random.Random(8)
    signs = [*"aAbZ09.,;:!?\"'()[] \n\t\r\x1c\x00-_ÄßΣİ漢😀\u0085   ​   　", "  ", "\n\n"]
    texts = [None, "", " ", "\n", "...", "a.\") b", "x" * 31 + " " + "Y" * 32 + "\n" + "z" * 70, *("".join(rng.choices(signs, k=rng.randrange(90))) for _ in range(700))]
    texts += [" ".join(chr(c + k) for k in range(64) if not 0xD800 <= c + k < 0xE000) for c in range(1, 0x10400, 64)]
    for at in range(0, len(texts), 256):
        part = texts[at:at + 256]
        coded = substrings.coded_texts(pa.array(["cut", *part, "off"], pa.string()).slice(1, len(part)))
        for i, text in enumerate(part):
            codes, lines = substrings.paragraphs(text or "")
            assert coded.codes[coded.base[i]:coded.base[i + 1]].tolist() == codes.tolist()
            assert [(s - coded.base[i], n) for s, n, of in zip(coded.starts, coded.sizes, coded.of, strict=True) if of == i and n] == lines
            assert (coded.of == i).sum() == (text or "").count("\n") + 1
    monkeypatch.setattr(substrings, "_word_codes", None)  # no word of these becomes a string
    batch = documents([f"Größe und {plain(i, 70)}. Élan ÜBER «{plain(i, 9)}»" for i in range(20)])
    (units,) = substrings._units(10, 3, 24, 5)(iter([batch]))
    assert all(units.column("window_start").value_lengths().to_numpy() > 0)


def test_marks_rule_out_no_similar_pair(spark):
    rng = random.Random(3)
    texts = [plain(i // 2, 400) for i in range(60)]
    edited = [" ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in t.split()) for t, share in zip(texts, [0.0, 0.01, 0.02, 0.04, 0.3] * 12, strict=True)]
    wanted = [[{"unit": i, "start": 0, "length": 400 - i}] for i in range(60)]
    kind = pa.list_(pa.struct([("unit", pa.int64()), ("start", pa.int32()), ("length", pa.int32())]))
    (made,) = substrings._shingle_sets(5)(iter([pa.RecordBatch.from_arrays([pa.array(edited), pa.array(wanted, kind)], ["text", "wanted"])]))
    sets = {r["unit"]: set(r["sh"]) for r in made.to_pylist()}
    frame = spark.createDataFrame([(r["unit"], r["sh"], len(r["sh"]), r["marks"]) for r in made.to_pylist()], "unit long, sh array<bigint>, n int, marks array<bigint>")
    pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
    like = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    left = {(r["a"], r["b"]) for r in substrings._comparable(pairs, frame, 0.8).collect()}
    assert like and like <= left and len(left) < 200  # of 1770
    assert {(r["a"], r["b"]) for r in substrings._jaccard(pairs, frame, 0.8).collect()} == like


def test_keys_of_one_hash_are_told_apart_across_batches():
    rng = random.Random(6)
    place = pa.struct([("id", pa.int64()), ("content", pa.int64())])
    rows = [{"doc": {"id": rng.choice([1, None]), "content": 7}, "passage": rng.random() < 0.7, "to_doc": {"id": 0, "content": rng.randrange(2)}, "removed": rng.random() < 0.5,
             "start": rng.randrange(300), "length": 24, "to": 0, "run": rng.choice([-5, 3])} for _ in range(400)]
    for r in rows:
        r["to"] = r["start"] + rng.choice([0, 9])
    rows.sort(key=lambda r: r["run"])

    def group(r, *more):
        return (r["doc"]["id"], r["passage"], r["to_doc"]["content"], r["removed"], r["to"] - r["start"] if r["passage"] else None, *more)
    expected = {(group(r, r["start"]), r["to"], 24) for r in rows if not r["passage"]}
    for key in {group(r, r["run"]) for r in rows if r["passage"]}:
        at = sorted({r["start"] for r in rows if r["passage"] and group(r, r["run"]) == key})
        heads = [i for i in range(len(at)) if not i or at[i] > at[i - 1] + 24]
        expected |= {((*key[:-1], at[i]), at[i] + key[4], at[j - 1] + 24 - at[i]) for i, j in zip(heads, [*heads[1:], len(at)], strict=True)}
    schema = pa.schema([("doc", place), ("passage", pa.bool_()), ("to_doc", place), ("removed", pa.bool_()), ("start", pa.int32()), ("length", pa.int32()), ("to", pa.int32()), ("run", pa.int64())])
    for size in (7, 130, 400):
        batches = [pa.RecordBatch.from_pylist(rows[at:at + size], schema) for at in range(0, len(rows), size)]
        found = [r for b in substrings._merged(iter(batches)) for r in b.to_pylist()]
        assert {(group(r, r["start"]), r["to"], r["length"]) for r in found} == expected
