"""Packing by concatenating and cutting.

First pass: every input split tokenizes its documents and keeps running token totals. Second pass: a prefix sum over
the totals of the splits turns them into global offsets, and each document cuts itself at the fixed windows it
crosses. Pieces that touch a window's border are the boundary records; no row ever moves to its neighbours.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.common import kept_in_worker, materialize, partition_bases, row_key, text_slices

#: Distinct words whose ids a worker remembers; the memory is emptied when it is full.
KEPT_WORDS = 500_000
#: Longer words are encoded each time.
KEPT_LENGTH = 48
#: Fixed value: the pattern by which byte-level pre-tokenizers cut texts.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Letters, digits and white space on which all regular-expression libraries agree.
_COMMON = re.compile("[\t\n\r -\u024f]*").fullmatch


class _Ids(dict):
    """Ids as little-endian bytes, by word. A word stands for itself after a space, or, with a leading line break, after that."""

    def __init__(self, encode: Callable[[str], list[int]]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(word) > 1 and word[-1] in ".," and word[-2].isalpha():  # a cut always stands there
            ids = self[word[:-1]] + array("I", self.encode(word[-1])).tobytes()
        else:
            ids = array("I", self.encode(word if word[:1] == "\n" else " " + word)).tobytes()
        if len(word) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = ids
        return ids


def byte_level_encoder(path: str) -> Callable[[str], bytes]:
    """Ids (little-endian, four bytes each) of a text by a byte-level BPE file of the tokenizers library.

    A text is cut before white space that follows something else, where the pre-tokenizer always cuts, and a word
    is encoded once. Words of common letters go through an encoder that is faster for single words and is built from
    the same file, as its merges are in the order of the ids; anything else goes through the tokenizers library.
    Raises for files of another kind.
    """
    def make():
        import tiktoken
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pre, vocab, added = spec["pre_tokenizer"] or {}, spec["model"]["vocab"], spec["added_tokens"]
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("the file has no plain byte-level pre-tokenizer")
        if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] for t in added) or merged != sorted(merged):
            raise ValueError("an added token holds white space, or the merges are not in the order of the ids")
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        special = {t["content"]: t["id"] for t in added}
        ranks = {bytes(map(byte.__getitem__, w)): i for w, i in vocab.items() if w not in special}
        fast = tiktoken.Encoding("words", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)
        whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()

        def encode(text: str) -> list[int]:
            if _COMMON(text):
                return fast.encode(text, allowed_special="all")
            return whole.encode(text, add_special_tokens=False).ids
        return _Ids(encode)
    known = kept_in_worker(f"byte-level {path}", make)

    def ids(text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or _OTHER_SPACE.search(text):
            return array("I", known.encode(text)).tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        return array("I", known.encode(first)).tobytes() + b"".join(map(known.__getitem__, rest))
    return ids


def file_encoder(path: str) -> Callable[[], Callable[[str], bytes]]:
    """What :func:`pack` takes as ``encoder``: makes the encoder in the worker."""
    return lambda: byte_level_encoder(path)


def tokenize(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], end_id: int,
             text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, doc, part, before, n, ids): little-endian ids of each document, ``end_id`` last.

    ``part`` is the input split and ``before`` the tokens that precede the document in it. Written once: later
    passes read the same split numbers, whatever tasks are run again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before, end = encoder(), TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        for batch in text_slices(batches):
            ids = [np.frombuffer(encode(t or "") + end, "<u4") for t in batch.column("text").to_pylist()]
            n = np.array([len(x) for x in ids], np.int64)
            starts = before + np.concatenate(([0], np.cumsum(n)[:-1]))
            before = int(starts[-1] + n[-1]) if len(n) else before
            # ids below 65,536 are kept in two bytes
            packed = [x.astype("<u2").tobytes() if x.max() < 65536 else b"\0" + x.astype("<u4").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), pa.array(packed, pa.binary())],
                ["doc", "part", "before", "n", "ids"])
    rows = docs.select(row_key(doc_id, text).alias("doc"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc struct<id: bigint, content: bigint>, part int, before long, n long, ids binary")


def unpacked(ids: bytes) -> np.ndarray:
    """Token ids of a stored document."""
    return np.frombuffer(ids, "<u2").astype("<u4") if len(ids) % 2 == 0 else np.frombuffer(ids, "<u4", offset=1)


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], end_id: int = 0, window: int = 1024,
         text: str = "text", doc_id: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences of exactly ``window`` tokens, but for the last sequence.

    (doc_id, start, length, doc_tokens, sequence_id, offset, boundary, ids_crc32[, ids]): ``start`` tokens of the
    document precede the piece, which stands at ``offset`` in its sequence; ``boundary`` tells whether the piece
    goes on from or into another sequence. Only the last sequence can need padding, fewer than ``window`` tokens.

    A null text is an empty one and gives the end id alone; null ids and repeated rows are documents like others;
    very long texts become many pieces; an empty table gives an empty table.
    """
    tokens = materialize(tokenize(docs, encoder, end_id, text, doc_id), "tokens")
    bases = partition_bases(tokens.select("part", F.struct("n").alias("t")).select("part", "t.n"), "part", "n")
    placed = tokens.join(F.broadcast(bases), "part").select(
        F.col("doc.id").alias("doc_id"), (F.col("base") + F.col("before")).alias("at"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            doc, start, at, whole, crc, kept = [], [], [], [], [], []
            for d, g, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids")), strict=True):
                cuts = [0, *range(window - g % window, n, window), n]
                content = unpacked(ids).tobytes()
                for s, e in zip(cuts, cuts[1:], strict=False):
                    piece = content[4 * s:4 * e]
                    doc.append(d), start.append(s), at.append(g + s), whole.append(n), crc.append(zlib.crc32(piece))
                    if with_ids:
                        kept.append(piece)
            s, n = np.array(start, np.int64), np.array(whole, np.int64)
            g = np.array(at, np.int64)
            length = np.minimum(n - s, window - g % window)
            columns = {
                "doc_id": pa.array(doc, pa.int64()), "start": pa.array(s), "length": pa.array(length), "doc_tokens": pa.array(n),
                "sequence_id": pa.array(g // window), "offset": pa.array(g % window), "boundary": pa.array((s > 0) | (s + length < n)),
                "ids_crc32": pa.array(crc, pa.int64())} | ({"ids": pa.array(kept, pa.binary())} if with_ids else {})
            yield pa.RecordBatch.from_pydict(columns)
    return placed.mapInArrow(cut, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, "
                             "boundary boolean, ids_crc32 long" + ", ids binary" * with_ids)
