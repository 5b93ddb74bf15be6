"""Token counts at every prefix of a text, by dynamic programming over prefixes.

A byte-pair encoding of a prefix is the encoding of a shorter prefix plus one last token: the only token that ends
there and stays next to its predecessor when the two are encoded together. So a text is walked once, keeping the
last token of every prefix, and the token count of each prefix is the count of the shorter one plus one.

The table of a document is the change of the count with each character, two bytes each. It answers how many tokens
any prefix has and where a token budget is used up, without encoding anything again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from operator import sub

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnwatch.llm.common import kept_in_worker, text_slices

KEPT_WORDS, KEPT_WALKS, KEPT_PAIRS = 500_000, 200_000, 500_000
KEPT_LENGTH = 48
SPACE = "▁"
_SHORT = (3, 2)
_SPACES = re.compile("[ ▁]+")


class PrefixCounter:
    """Prefix counts for one byte-pair model of the sentencepiece library with byte fallback and no normalization."""

    def __init__(self, path: str) -> None:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = range(model.get_piece_size())
        usual = [i for i in pieces if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {model.id_to_piece(i): model.get_score(i) for i in usual}
        spaces = {p for p in self.score if not p.strip(SPACE)}
        inner = {p for p in self.score if SPACE in p[1:]} - spaces
        ranks = [s for p, s in self.score.items() if len(p) > 1 and p not in spaces]
        probe = " A  ﬁ½\t"
        if inner or len(set(ranks)) < len(ranks) or sum(map(model.is_byte, pieces)) < 256 or model.decode(model.encode(probe)) != probe:
            raise ValueError("only byte-pair models with byte fallback, distinct merges and no normalization are handled")
        if spaces and max((self.score[p] for p in spaces if len(p) > 1), default=-np.inf) >= min(ranks):
            raise ValueError("runs of spaces must merge last")
        self.inside = {p[i:i + 2] for p in self.score for i in range(len(p) - 1)}
        # sizes of tokens of four characters and more by their last four, the longest first
        ends: dict[str, set[int]] = {}
        for p in self.score:
            if len(p) > 3:
                ends.setdefault(p[-4:], set()).add(len(p))
        self.sizes = {e: (*sorted(n, reverse=True), 3, 2) for e, n in ends.items()}
        # tokens that are their own encoding; the others are never reached by merging
        self.whole = {p for p in self.score if self.merge(p) == [p]}
        self.runs: list[int] = [0]
        self.stack: list[int] = []
        # one object per token, whatever number of walks hold it
        self.piece = {p: p for p in self.score}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.kept_pairs = 0
        self.walks: dict[str, tuple[list[str], list[int]]] = {}
        # words in two halves: those asked for since the last change of halves, and before
        self.words: dict[str, tuple[int, bytes]] = {}
        self.old_words: dict[str, tuple[int, bytes]] = {}
        # tokens of a space and a word, by the word; in two halves too
        self.counted: dict[str, int] = {}
        self.old_counted: dict[str, int] = {}

    def merge(self, text: str) -> list[str]:
        """Tokens of a short text: the best pair first, of equal ones the leftmost."""
        parts, score, none = list(text), self.score.get, -np.inf
        worth = [score(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while worth:
            best = max(worth)
            if best == none:
                break
            at = worth.index(best)
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            del worth[at]
            if at:
                worth[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(worth):
                worth[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def adjoin(self, left: str, right: str) -> bool:
        """Whether both tokens stay as they are when encoded next to each other."""
        row = self.pairs.get(left)
        if row is None or right not in row:
            if self.kept_pairs >= KEPT_PAIRS:
                self.pairs.clear()
                self.kept_pairs = 0
            row = self.pairs.setdefault(left, {})
            row[right] = self.merge(left + right) == [left, right]
            self.kept_pairs += 1
        return row[right]

    def width(self, token: str) -> int:
        """Tokens that a token of the walk counts for: a character outside the vocabulary is written as its bytes."""
        return 1 if token in self.score else len(token.encode())

    def onward(self, chunk: str, last: list[str], counts: list[int]) -> None:
        """Adds the last token and the count of the prefixes of a chunk that are longer than those given.

        Candidates for the last token are tried longest first; only sizes of tokens that end in the same four
        characters come into question, and three and two.
        """
        piece, sizes, pairs, score = self.piece.get, self.sizes.get, self.pairs.get, self.score
        if not last:
            first = piece(chunk[0], chunk[0])
            last.append(first)
            counts.append(self.width(first))
        for end in range(len(last) + 1, len(chunk) + 1):
            for size in sizes(chunk[end - 4:end], _SHORT) if end > 3 else _SHORT:
                if size > end:
                    continue
                at = end - size
                token = piece(chunk[at:end])
                if token is None:
                    continue
                if not at:
                    if token in self.whole:
                        break
                    continue
                before = last[at - 1]
                row = pairs(before)
                fits = None if row is None else row.get(token)
                if fits or fits is None and self.adjoin(before, token):
                    break
            else:  # the last character alone
                at = end - 1
                token = piece(chunk[at], chunk[at])
            last.append(token)
            counts.append((counts[at - 1] if at else 0) + (1 if token in score else self.width(token)))

    def walk(self, chunk: str) -> tuple[list[str], list[int]]:
        """Last token and count of all prefixes of a chunk but the empty one."""
        walks = self.walks
        known = walks.get(chunk)
        if known is not None:
            return known
        # a shorter chunk that was walked before is where this one starts
        for cut in range(len(chunk) - 1, max(1, len(chunk) - 6), -1):
            if (known := walks.get(chunk[:cut])) is not None:
                last, counts = known[0].copy(), known[1].copy()
                break
        else:
            last, counts = [], []
        self.onward(chunk, last, counts)
        if len(chunk) <= KEPT_LENGTH:
            if len(walks) >= KEPT_WALKS:
                walks.clear()
            walks[chunk] = (last, counts)
        return last, counts

    def bare(self, last: list[str]) -> list[bool]:
        """Whether the first character of each prefix is a token of its own."""
        out: list[bool] = []
        for end, token in enumerate(last, 1):
            out.append(out[end - len(token) - 1] if len(token) < end else len(token) == 1)
        return out

    def run(self, n: int) -> int:
        """Tokens of ``n`` spaces: pairs merge from the left, so the runs of all lengths come from one walk."""
        while len(self.runs) <= n:
            self.stack.append(1)
            while len(self.stack) > 1 and SPACE * (self.stack[-2] + self.stack[-1]) in self.score:
                self.stack[-2:] = [self.stack[-2] + self.stack[-1]]
            self.runs.append(len(self.stack))
        return self.runs[n]

    def chunks(self, word: str) -> list[str]:
        """Cuts a word where no token holds both neighbours: nothing can ever merge across."""
        inside = self.inside
        cuts = [i for i in range(1, len(word)) if word[i - 1:i + 1] not in inside]
        if not cuts:
            return [word]
        return [word[s:e] for s, e in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def steps(self, chunk: str) -> bytes:
        counts = self.walk(chunk)[1]
        return array("h", map(sub, counts, [0, *counts])).tobytes()

    def after_run(self, word: str, body: str) -> bytes:
        """Two or more spaces and what follows: the last space may belong to the word or to the run."""
        n = len(word) - len(body)
        totals = [self.run(i) for i in range(1, n + 1)]
        if not body:
            return array("h", map(sub, totals, [0, *totals])).tobytes()
        first, *rest = self.chunks(SPACE + body)
        apart, joined = self.run(n) - 1, self.run(n - 1)
        last, counts = self.walk(first)
        totals[-1:] = [c + (apart if b else joined) for c, b in zip(counts, self.bare(last), strict=True)]
        return array("h", map(sub, totals, [0, *totals])).tobytes() + b"".join(map(self.steps, rest))

    def word(self, word: str) -> tuple[int, bytes]:
        """Tokens of spaces followed by other characters, and the changes of the count, a character each."""
        known = self.words.get(word)
        if known is None:
            known = self.old_words.get(word)
            if known is None:
                known = self.made(word)
            if len(word) <= KEPT_LENGTH:
                if len(self.words) >= KEPT_WORDS // 2:
                    self.old_words, self.words = self.words, {}
                self.words[word] = known
        return known

    def made(self, word: str) -> tuple[int, bytes]:
        if word[-1] in ".," and len(word) > 1 and word[-2:] not in self.inside:
            (n, front), (m, back) = self.word(word[:-1]), self.word(word[-1])
            return n + m, front + back
        if word.startswith(SPACE * 2):
            table = self.after_run(word, word.lstrip(SPACE))
        else:
            table = b"".join(map(self.steps, self.chunks(word)))
        return sum(memoryview(table).cast("h")), table

    def entries(self, text: str) -> list[tuple[int, bytes]]:
        """(tokens, changes) of the words of a text that isn't empty, behind the space that the library puts in front."""
        plain = SPACE + text.replace(" ", SPACE)
        if SPACE + SPACE in plain or plain.endswith(SPACE):
            starts = [m.start() for m in re.finditer(f"(?<!{SPACE}){SPACE}", plain)]
            return list(map(self.word, [plain[s:e] for s, e in zip(starts, [*starts[1:], None], strict=True)]))
        get, make = self.words.get, self.word
        return [get(w) or make(w) for w in map(SPACE.__add__, plain[1:].split(SPACE))]

    def totals(self, chunks: list[str]) -> Iterator[int]:
        """Tokens of chunks in sorted order: each walk goes on where it parts from the one before."""
        before, last, counts = "", [], []
        for chunk in chunks:
            same = 0
            for a, b in zip(before, chunk, strict=False):
                if a != b:
                    break
                same += 1
            del last[same:], counts[same:]
            self.onward(chunk, last, counts)
            before = chunk
            yield counts[-1]

    def count(self, words: set[str]) -> dict[str, int]:
        """Tokens of a space and each of the words, which hold no spaces; the others in the result are from before."""
        if len(self.counted) >= KEPT_WORDS // 2:
            self.old_counted, self.counted = self.counted, {}
        known, old, inside = self.counted, self.old_counted, self.inside
        fresh, bare, marked = words - known.keys(), [], []
        for word in fresh:
            if (n := old.get(word)) is not None:
                known[word] = n
            elif len(word) > 1 and word[-1] in ".," and word[-2:] not in inside:
                marked.append(word)
            else:
                bare.append(word)
        bare = sorted({*bare, *[w[:-1] for w in marked if w[:-1] not in known]})
        known.update(zip(bare, self.totals([SPACE + w for w in bare]), strict=True))
        known.update([(w, known[w[:-1]] + self.width(w[-1])) for w in marked])
        return known

    def answers(self, texts: list[str], budget: int) -> list[tuple[int, int]]:
        """(tokens, characters of the longest prefix within the budget) per text.

        A whole text needs the last entries of its words only, the place of the cut the entries of one word besides.
        """
        # words behind single spaces; texts with other spaces are counted each for itself
        split = [t.split(" ") if t and SPACE not in t and "  " not in t and t[0] != " " and t[-1] != " " else None for t in texts]
        known = self.count({w for words in split if words for w in words})
        out = []
        for text, words in zip(texts, split, strict=True):
            each = [e[0] for e in self.entries(text)] if words is None and text else list(map(known.__getitem__, words or ()))
            total = sum(each)
            if total <= budget:
                out.append((total, len(text)))
            elif words is None:
                out.append((total, truncation_point(self.changes(text), budget)))
            else:
                out.append((total, self.cut(words, each, budget)))
        for word in [w for words in split if words for w in words if len(w) > KEPT_LENGTH]:
            known.pop(word, None)
        return out

    def cut(self, words: list[str], each: list[int], budget: int) -> int:
        """Characters of the longest prefix within the budget; every prefix of a word and its space has a token or more."""
        before = np.cumsum([0, *each])
        for i in range(int(np.searchsorted(before[:-1], budget)) - 1, -1, -1):
            within = np.flatnonzero(before[i] + prefix_counts(self.word(SPACE + words[i])[1])[1:] <= budget)
            if len(within):
                return sum(map(len, words[:i])) + i + int(within[-1])
        return 0

    def changes(self, text: str) -> bytes:
        """The table of a text: little-endian 16-bit changes of the token count, a character each."""
        if not text:
            return b""
        table = b"".join([e[1] for e in self.entries(text)])
        # the space that the library puts in front has no place in the text
        head = int.from_bytes(table[:2], "little", signed=True) + int.from_bytes(table[2:4], "little", signed=True)
        return head.to_bytes(2, "little", signed=True) + table[4:]


def prefix_counter(path: str) -> PrefixCounter:
    return kept_in_worker(f"prefix counts {path}", lambda: PrefixCounter(path))


def prefix_counts(changes: bytes) -> np.ndarray:
    """Tokens of every prefix, the empty one first."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(changes, "<i2"), dtype=np.int64)))


def truncation_point(changes: bytes, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_counts(changes) <= budget)[-1])


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), size.alias("n_bytes"), F.col(text).alias("text"))


def token_tables(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, changes): the prefix table of every whole text. Null and empty texts have an empty table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in text_slices(batches):
            found = [counter.changes(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.binary())],
                                             ["doc_id", "n_bytes", "changes"])
    return _texts(docs, text, doc_id).mapInArrow(run, "doc_id long, n_bytes long, changes binary")


def _answers(doc_id: pa.Array, n_bytes: pa.Array, total: list[int], fits: list[int], budget: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [doc_id, n_bytes, pa.array(total, pa.int64()), pa.array([n > budget for n in total], pa.bool_()), pa.array(fits, pa.int64())],
        ["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"])


_ANSWERS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long"


def budgets(tables: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fits_chars): answers from stored tables alone.

    ``fits_chars`` are the characters of the longest prefix within ``budget`` tokens. A null id stays null; repeated
    rows are counted each; an empty table gives an empty table.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            tables = batch.column("changes").to_pylist()
            total = [int(np.frombuffer(c, "<i2").sum(dtype=np.int64)) for c in tables]
            fits = [truncation_point(c, budget) if n > budget else len(c) // 2 for c, n in zip(tables, total, strict=True)]
            yield _answers(batch.column("doc_id"), batch.column("n_bytes"), total, fits, budget)
    return tables.mapInArrow(run, _ANSWERS)


def count_tokens(docs: DataFrame, path: str, budget: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """What :func:`budgets` says about the tables of ``docs``, which are used where they are made and not stored.

    The words of many texts are walked in sorted order, so that equal beginnings are walked once.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(path)
        for batch in text_slices(batches):
            found = counter.answers([t or "" for t in batch.column("text").to_pylist()], budget)
            yield _answers(batch.column("doc_id"), batch.column("n_bytes"), [n for n, _ in found], [f for _, f in found], budget)
    return _texts(docs, text, doc_id).mapInArrow(run, _ANSWERS)
