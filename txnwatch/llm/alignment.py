"""Alignment of two tokenizers over the same bytes.

Both tokenizers tell where their tokens stand: one in characters, the other in bytes of the text. These spans are coarse
cuts. Where tokens share a character, or stand for a part of it, the bytes behind the tokens tell the true ends. Places
where tokens of both end cut a text into groups, and every stretch between two neighbouring ends of either is one link.

A text falls into chunks at single spaces and line breaks between other characters, where both tokenizers always cut.
Chunks that a worker has seen are not encoded again; new ones are encoded together, many in one call.

How many documents hold a pair of ids is counted over the whole corpus. Frequent pairs, a bounded number of them, are
sent to all executors; the others, which no document has many of, meet their counts by a join.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.common import kept_in_worker, materialize, release, text_slices

#: Chunks that a worker remembers at most, in two halves, and the length up to which they are remembered.
KEPT_CHUNKS, KEPT_LENGTH = 400_000, 48
#: Chunks that are encoded in one call.
TOGETHER = 1_000
#: Frequent pairs that are sent to all executors: 24 bytes each.
HEAVY = 1_000_000
#: Pairs a task holds before it adds them up.
BUFFERED = 2_000_000
SPACE = chr(0x2581)
#: White space and characters that are near to it in some library: no chunk begins or ends beside them.
_WIDE = [(0x1680, 0x1680), (0x180E, 0x180E), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x206F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)]
_SPACES = r"\s\x00-\x20\x7f-\xa0\xad" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _WIDE)
_CUT = re.compile(rf"(?<=[^{_SPACES}])(?=[ \n][^{_SPACES}])")
_REGULAR = re.compile(rf"[ \n][^{_SPACES}](?:.*[^{_SPACES}])?", re.DOTALL).fullmatch
_ODD = re.compile(rf"(?![ \n])[{_SPACES}]").search

#: What is known of a chunk: tokens of either side and groups (three 4-byte numbers), pairs, groups as text.
Entry = tuple[bytes, bytes, bytes]


class Aligner:
    """Aligns a byte-level file of the tokenizers library (A) with a sentencepiece model (B) that puts a space in front."""

    def __init__(self, byte_level: str, pieces: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        with open(byte_level, encoding="utf-8") as file:
            special = {t["id"] for t in json.load(file)["added_tokens"]}
        size = max(self.a.get_vocab(with_added_tokens=True).values()) + 1
        self.a_bytes = [b""] * size
        for token, i in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[i] = token.encode() if i in special else bytes(map(byte.__getitem__, token))
        self.b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace(SPACE, " ").encode()
                        for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.codes = np.dtype("<u4" if size * len(self.b_bytes) < 2**32 else "<u8")
        self.a_names, self.b_names = list(map(str, range(size))), list(map(str, range(len(self.b_bytes))))
        self.young: dict[str, Entry | None] = {}
        self.old: dict[str, Entry | None] = {}

    def a_ends(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Ids of a text, the ends of their bytes, and the bytes of all of them."""
        found = self.a.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        spans = np.array(found.offsets, np.int64).reshape(-1, 2)
        whole = b"".join(map(self.a_bytes.__getitem__, found.ids))
        if text.isascii():
            return ids, spans[:, 1], whole
        # coarse: the end of the last character; fine: the length of the bytes, where tokens share a character
        width = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.concatenate(([0], np.cumsum(1 + (width > 0x7F) + (width > 0x7FF) + (width > 0xFFFF))))
        ends = at[spans[:, 1]]
        shared = np.zeros(len(ids), bool)
        shared[:-1] = spans[1:, 0] < spans[:-1, 1]
        return ids, _refined(ends, self.a_size[ids], shared), whole

    def b_ends(self, text: str) -> tuple[np.ndarray, np.ndarray, bytes]:
        """The same for the other side, with the space that it puts in front of a text."""
        pieces = self.b.encode(text, return_type="proto").pieces
        ids = np.array([p.id for p in pieces], np.int64)
        # spans are bytes of the text without that space; bytes of one character have one span, or an empty one
        ends = np.array([p.end for p in pieces], np.int64) + 1
        shared = np.zeros(len(ids), bool)
        shared[:-1] = [p.begin >= q.begin for p, q in zip(pieces, pieces[1:], strict=False)]
        shared |= np.array([p.begin == p.end for p in pieces], bool)
        whole = b"".join(map(self.b_bytes.__getitem__, ids.tolist()))
        return ids, _refined(ends, self.b_size[ids], shared), whole

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """(ids of A, their ends, ids of B, their ends) in the bytes of a text that starts with a space; None if either loses bytes."""
        a, a_ends, a_whole = self.a_ends(text)
        b, b_ends, b_whole = self.b_ends(text[1:])
        given = text.encode()
        return (a, a_ends, b, b_ends) if a_whole == b_whole == given else None

    def entries(self, text: str, ends: list[int] | None = None) -> list[Entry] | None:
        """What is known of the parts of ``text`` that end at the byte positions ``ends``, or of the whole text.

        None if a side loses bytes or a token reaches across an end.
        """
        found = self.spans(text)
        if found is None:
            return None
        a, a_ends, b, b_ends = found
        groups = np.intersect1d(a_ends, b_ends, assume_unique=True)
        stops = np.array(ends if ends is not None else [len(text.encode())], np.int64)
        if not len(groups) or (groups[np.minimum(np.searchsorted(groups, stops), len(groups) - 1)] != stops).any():
            return None
        # between two neighbouring ends of either side lie one token of each
        links = np.union1d(a_ends, b_ends)
        codes = (a[np.searchsorted(a_ends, links)] * len(self.b_bytes) + b[np.searchsorted(b_ends, links)]).astype(self.codes)
        of_a, of_b = (np.concatenate(([0], np.searchsorted(e, groups, "right"))).tolist() for e in (a_ends, b_ends))
        a_text, b_text = ([names[i] for i in ids.tolist()] for names, ids in ((self.a_names, a), (self.b_names, b)))
        said = [f"{','.join(a_text[i:k])}|{','.join(b_text[m:n])}" for i, k, m, n in zip(of_a, of_a[1:], of_b, of_b[1:], strict=False)]
        cut = [np.concatenate(([0], np.searchsorted(e, stops, "right"))) for e in (a_ends, b_ends, groups, links)]
        counts = np.stack([np.diff(c) for c in cut[:3]], axis=1).astype("<u4")
        g, x = cut[2].tolist(), cut[3].tolist()
        return [(counts[i].tobytes(), codes[x[i]:x[i + 1]].tobytes(), ";".join(said[g[i]:g[i + 1]]).encode()) for i in range(len(stops))]

    def chunks(self, text: str) -> list[str]:
        """Chunks of a text behind a space. A chunk stands without its space; other ones keep all their characters.

        So a chunk starts with a line break, with a space if it is irregular, and else with its first letter.
        """
        if not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n" or _ODD(text)):
            return text.replace("\n", " \n").split(" ")
        return [c[1:] if c[0] == " " and _REGULAR(c) else c for c in _CUT.split(" " + text)]

    def learn(self, chunks: Iterable[str]) -> dict[str, Entry | None]:
        """Entries of all chunks; None for those that a side can't give back."""
        known: dict[str, Entry | None] = {}
        fresh = []
        for chunk in set(chunks):
            if chunk in self.young:
                known[chunk] = self.young[chunk]
            elif chunk in self.old:
                known[chunk] = self.young[chunk] = self.old[chunk]
            else:
                fresh.append(chunk)
        regular = [c for c in fresh if c[0] != " " and (c[0] != "\n" or _REGULAR(c))]
        for at in range(0, len(regular), TOGETHER):
            some = regular[at:at + TOGETHER]
            # the space in front is one word's that is left out again
            parts = [" a", *(c if c[0] == "\n" else " " + c for c in some)]
            ends = np.cumsum([len(p.encode()) for p in parts]).tolist()
            found = self.entries("".join(parts), ends)
            known.update(zip(some, found[1:], strict=True) if found else ((c, self.alone(c)) for c in some))
        for chunk in fresh:
            if chunk not in known:
                known[chunk] = self.alone(chunk)
        for chunk in fresh:
            if len(chunk) <= KEPT_LENGTH:
                self.young[chunk] = known[chunk]
        if len(self.young) > KEPT_CHUNKS // 2:
            self.old, self.young = self.young, {}
        return known

    def alone(self, chunk: str) -> Entry | None:
        if chunk[0] == "\n":  # behind a word that is left out again
            found = self.entries(" a" + chunk, [2, 2 + len(chunk.encode())])
            return found[1] if found else None
        found = self.entries(chunk if chunk[0] == " " else " " + chunk)
        return found[0] if found else None

    def whole(self, text: str) -> Entry | None:
        """The entry of a whole text, without cutting it."""
        found = self.entries(" " + text)
        return found[0] if found else None


def _refined(ends: np.ndarray, sizes: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """``ends``, but where a token shares a character with the next one: the end that its bytes tell."""
    return np.where(shared, np.cumsum(sizes), ends) if shared.any() else ends


def aligner(byte_level: str, pieces: str) -> Aligner:
    return kept_in_worker(f"alignment {byte_level} {pieces}", lambda: Aligner(byte_level, pieces))


def text_entries(tool: Aligner, texts: list[str | None]) -> Iterator[list[Entry]]:
    """Entries of every text, in order; none for null and empty texts and those that a side can't give back."""
    cut = [tool.chunks(t) if t else [] for t in texts]
    known = tool.learn(c for chunks in cut for c in chunks)
    for text, chunks in zip(texts, cut, strict=True):
        own = [known[c] for c in chunks]
        if None in own:  # bytes that one chunk lacks could only stand in its neighbour
            again = tool.whole(text)
            own = [again] if again else []
        yield own


_PAIRS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary"


def aligned_texts(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", doc_id: str = "doc_id", with_groups: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, codes, times[, groups]) per row of ``docs``.

    ``codes`` are the distinct linked pairs, id of A times the size of B's vocabulary plus id of B, little-endian, and
    ``times`` how often each is linked (4 bytes). ``groups`` is the alignment as text, ``a1,a2|b1;a3|b2,b3``, and
    ``groups_sha256`` its digest, '' without tokens.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(byte_level, pieces)
        for batch in text_slices(batches):
            out: list[list] = [[] for _ in range(8)]
            for own in text_entries(tool, batch.column("text").to_pylist()):
                counts = np.frombuffer(b"".join([e[0] for e in own]), "<u4").reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
                codes = np.frombuffer(b"".join([e[1] for e in own]), tool.codes)
                groups = b";".join([e[2] for e in own])
                kinds, times = np.unique(codes, return_counts=True)
                for column, value in zip(out, [*counts, len(codes), hashlib.sha256(groups).hexdigest() if own else "", kinds.tobytes(), times.astype("<u4").tobytes(),
                                               groups.decode() if with_groups else None], strict=True):
                    column.append(value)
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary(), pa.binary(), pa.string()]
            columns = [batch.column("row"), batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns[:None if with_groups else -1], names[:None if with_groups else -1])
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times", "groups"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _PAIRS + ", groups string" * with_groups)


def token_groups(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, at, start, end, a_ids, b_ids): the groups of every text, with their bytes in the text behind a space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(byte_level, pieces)
        kind = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))])
        for batch in text_slices(batches):
            out = []
            for i, own in zip(batch.column("doc_id").to_pylist(), text_entries(tool, batch.column("text").to_pylist()), strict=True):
                end = 0
                for at, group in enumerate(g for e in own for g in e[2].decode().split(";")):
                    a, b = ([int(x) for x in side.split(",")] for side in group.split("|"))
                    start, end = end, end + sum(len(tool.a_bytes[x]) for x in a)
                    out.append({"doc_id": i, "at": at, "start": start, "end": end, "a_ids": a, "b_ids": b})
            yield pa.RecordBatch.from_pylist(out, kind)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, at int, start long, end long, a_ids array<int>, b_ids array<int>")


def pair_counts(aligned: DataFrame, codes: str) -> DataFrame:
    """(code, n): documents that hold each pair. Tasks add up before they send."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = (np.empty(0, np.int64), np.empty(0, np.int64)), []

        def added(held, waiting):
            more, n = np.unique(np.concatenate(waiting), return_counts=True) if waiting else (np.empty(0, np.int64), np.empty(0, np.int64))
            kinds, at = np.unique(np.concatenate([held[0], more]), return_inverse=True)
            return kinds, np.bincount(at, weights=np.concatenate([held[1], n]), minlength=len(kinds)).astype(np.int64)
        size = 0
        for batch in batches:
            for value in batch.column("codes").to_pylist():
                waiting.append(np.frombuffer(value, codes).astype(np.int64))
                size += len(waiting[-1])
                if size >= BUFFERED:
                    held, waiting, size = added(held, waiting), [], 0
                    if len(held[0]) >= BUFFERED:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], ["code", "n"])
                        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        held = added(held, waiting)
        for at in range(0, len(held[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[at:at + 50_000]) for c in held], ["code", "n"])
    return aligned.select("codes").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _frequent(pairs: DataFrame, most: int) -> int:
    """The smallest power of two so that no more than ``most`` pairs have so many documents."""
    sizes = {r["b"]: r["n"] for r in pairs.groupBy(F.floor(F.log2("n") + 1e-9).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    least, held = max(sizes, default=0) + 1, 0
    while least and held + sizes.get(least - 1, 0) <= most:
        least -= 1
        held += sizes.get(least, 0)
    return 2 ** least


def align_documents(docs: DataFrame, byte_level: str, pieces: str, heavy: int = HEAVY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs``.

    A pair's count is the number of rows that hold it linked; ``n_best`` are the links whose count is the highest of
    their A id in the whole corpus, ties included, and ``count_sum`` is the sum of the counts of all links.

    Null and empty texts, and those that either tokenizer doesn't give back byte for byte, have no tokens. Rows with
    equal or null ids are rows of their own; no rows give no rows. ``heavy`` bounds what is sent to the executors; the
    result doesn't depend on it.
    """
    spark = docs.sparkSession
    tool = Aligner(byte_level, pieces)
    vocabulary, codes = len(tool.b_bytes), tool.codes.str
    aligned = materialize(aligned_texts(docs, byte_level, pieces, text, doc_id), "alignments")
    counted = materialize(pair_counts(aligned, codes), "pair-counts")
    a_id = F.expr(f"code div {vocabulary}").alias("a")
    best = counted.groupBy(a_id).agg(F.max("n").alias("most"))
    pairs = materialize(counted.withColumn("a", a_id).join(best, "a").select("code", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    least = _frequent(pairs, heavy)
    held = pairs.where(F.col("n") >= least).toPandas().sort_values("code")
    sent = spark.sparkContext.broadcast((held["code"].to_numpy(np.int64), held["n"].to_numpy(np.int64), held["best"].to_numpy(bool)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for batch in text_slices(batches):
            out: list[list] = [[], [], [], []]
            for own, times in zip(batch.column("codes").to_pylist(), batch.column("times").to_pylist(), strict=True):
                own, times = np.frombuffer(own, codes).astype(np.int64), np.frombuffer(times, "<u4").astype(np.int64)
                at = np.minimum(np.searchsorted(known, own), max(len(known) - 1, 0))
                met = known[at] == own if len(known) else np.zeros(len(own), bool)
                at, t = at[met], times[met]
                for column, value in zip(out, (int((t * n[at]).sum()), int(t[best[at]].sum()), own[~met], times[~met]), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in plain] + [pa.array(c, pa.int64()) for c in out[:2]] + [pa.array(c, pa.list_(pa.int64())) for c in out[2:]],
                [*plain, "count_sum", "n_best", "rare", "rare_times"])
    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    summed = aligned.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
                                     "count_sum long, n_best long, rare array<long>, rare_times array<long>")
    result = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    if least <= 1:  # every pair was sent
        release(counted, pairs)
        return summed.select(*result)
    summed = materialize(summed, "frequent-sums")
    rare = summed.select("row", F.explode(F.arrays_zip("rare", "rare_times")).alias("r")).select("row", F.col("r.rare").alias("code"), F.col("r.rare_times").alias("times"))
    more = rare.join(pairs.where(F.col("n") < least), "code").groupBy("row").agg(
        F.sum(F.col("times") * F.col("n")).alias("more_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"))
    release(counted, aligned)
    both = summed.join(more, "row", "left")
    zero = F.lit(0).cast("long")
    return both.withColumn("count_sum", F.col("count_sum") + F.coalesce("more_sum", zero)).withColumn(
        "n_best", F.col("n_best") + F.coalesce("more_best", zero)).select(*result)
