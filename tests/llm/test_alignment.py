"""The alignment against tokens of whole texts: bytes of characters, byte fallback, odd spaces, special strings, rare pairs."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from txnwatch.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PARTS = [*"ab 'é\n\t .12\xa0\x1c　!s", "<|endoftext|>", " the", " \n", "don't", "中", "ǆ", "́", "x,", "y.", "▁", "<s>", "<0x0A>", "😀", "𓀀", "ቐ", "  ", " w", "\nq", "​",
         "﻿", "\r\n", " a b c", " ", "ﬁ", "½"]


class Plain:
    """Whole texts by both libraries, and loops over all pairs of tokens."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.byte = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in kept)}

    def tokens(self, text):
        if not text:
            return None
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        given = (" " + text).encode()
        return (a, b) if b"".join(x[1] for x in a) == given == b"".join(x[1] for x in b) else None

    def aligned(self, text):
        """(n_a, n_b, groups, links)"""
        found = self.tokens(text)
        if found is None:
            return 0, 0, [], []
        ranges = []
        for side in found:
            at, own = 0, []
            for i, b in side:
                own.append((i, at, at + len(b)))
                at += len(b)
            ranges.append(own)
        links = [(i, k) for i, s, e in ranges[0] for k, x, y in ranges[1] if max(s, x) < min(e, y)]
        cuts = sorted({e for _, _, e in ranges[0]} & {e for _, _, e in ranges[1]})
        groups = [tuple([i for i, s, e in side if lo <= s < hi] for side in ranges) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        return len(ranges[0]), len(ranges[1]), groups, links


@pytest.fixture(scope="module")
def plain():
    return Plain()


def said(groups) -> str:
    return ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)


def random_texts(n: int) -> list[str]:
    rng = random.Random(11)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 40))) for _ in range(n)]


def test_spans_are_the_bytes_of_the_tokens(plain):
    tool = alignment.Aligner(A, B)
    seen = 0
    for text in random_texts(1500):
        found, expected = tool.spans(" " + text), plain.tokens(text)
        assert (found is None) == (expected is None)
        if found:
            for ids, ends, side in zip(found[::2], found[1::2], expected, strict=True):
                assert ids.tolist() == [i for i, _ in side]
                assert ends.tolist() == [sum(len(b) for _, b in side[:k + 1]) for k in range(len(side))], (text, side)
            seen += 1
    assert seen > 500


def test_chunks_equal_whole_texts(plain):
    tool = alignment.Aligner(A, B)
    texts = [*random_texts(1500), "plain words and more.\nA line, and the end", "", None, " ", "\n", "x" * 300, "中文" * 80]
    for _ in range(2):  # the second time from memory
        for text, own in zip(texts, alignment.text_entries(tool, texts), strict=True):
            n_a, n_b, groups, links = plain.aligned(text)
            assert b";".join(e[2] for e in own).decode() == said(groups), text
            codes = b"".join(e[1] for e in own)
            assert Counter(map(tuple, map(lambda c: divmod(c, len(tool.b_bytes)), memoryview(codes).cast("I").tolist()))) == Counter(links)
    assert sum(len(t) > alignment.KEPT_LENGTH for t in tool.young) == 0


def test_memory_of_chunks_is_bounded(monkeypatch, plain):
    monkeypatch.setattr(alignment, "KEPT_CHUNKS", 8)
    tool, rng = alignment.Aligner(A, B), random.Random(2)
    for _ in range(50):
        text = " ".join(rng.choice(["one", "two", "drei", "quatre", "x9", "é", "中", "…", "ten", "elf", "yes"]) for _ in range(9))
        own = next(alignment.text_entries(tool, [text]))
        assert b";".join(e[2] for e in own).decode() == said(plain.aligned(text)[2])
        assert len(tool.young) + len(tool.old) <= 8 + 18


def rows() -> list[tuple]:
    long = " ".join(random_texts(400))
    base = [(i if i % 9 else None, t) for i, t in enumerate(random_texts(60))] + [(100, None), (101, ""), (102, long), (103, "the same the same"), (103, "the same the same"),
                                                                             (104, "a▁b"), (None, None), (105, "The quick brown fox.\nAnd more of the same")]
    return [(i, t, "en", "s", 1) for i, t in base]


def expected(plain, table) -> Counter:
    found = [(r[0], *plain.aligned(r[1])) for r in table]
    count = Counter(p for *_, links in found for p in set(links))
    most = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    return Counter((i, n_a, n_b, len(groups), len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(said(groups).encode()).hexdigest() if groups else "") for i, n_a, n_b, groups, links in found)


@pytest.mark.parametrize("heavy", [0, 40, 1_000_000])
def test_documents_equal_brute_force(spark, plain, heavy):
    table = rows()
    frame = spark.createDataFrame(table, DOCS).repartition(4)
    for name in ("row", "codes", "n", "best", "rare", "a", "count_sum"):
        frame = frame.withColumn(name, F.lit("clash"))
    found = alignment.align_documents(frame, A, B, heavy=heavy)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, found.collect())) == expected(plain, table)


def test_groups_and_their_text(spark, plain):
    frame = spark.createDataFrame(rows(), DOCS)
    groups = alignment.token_groups(frame, A, B).where("doc_id = 105").orderBy("at").collect()
    whole = b" The quick brown fox.\nAnd more of the same"
    assert [(r["a_ids"], r["b_ids"]) for r in groups] == [tuple(g) for g in plain.aligned(whole[1:].decode())[2]]
    assert [r["start"] for r in groups] == [0, *(r["end"] for r in groups[:-1])] and groups[-1]["end"] == len(whole)
    text = alignment.aligned_texts(frame, A, B, with_groups=True).where("doc_id = 105").head()["groups"]
    assert text == said([(r["a_ids"], r["b_ids"]) for r in groups])


def test_no_rows(spark):
    assert alignment.align_documents(spark.createDataFrame([], DOCS), A, B).count() == 0
