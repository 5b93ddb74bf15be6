"""Substring deduplication on paragraphs.

Natural paragraphs (lines, and lines up to a blank line as one) are compared by MinHash banding: bands are tuned to a
wanted recall, paragraphs that collide are joined, the exact Jaccard similarity of their shingles is computed, and
components of the links are clusters. Passages that stand inside other paragraphs are compared verbatim: windows of
fixed length start at every sentence and at the smallest hash of every ``SPAN`` adjacent starts, so that equal runs of
``WINDOW + SPAN - 1`` words share a window whatever is in them; hits are extended to the whole run. Of each cluster the
first occurrence stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.common import arrow_rows, kept_in_worker, materialize, release, row_key, text_slices
from txnwatch.llm.components import connected_components

#: Words of a paragraph window.
WINDOW = 24
#: Adjacent windows of which the one with the smallest hash is compared.
SPAN = 27
SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.999
#: Similarity of unrelated paragraphs, and how many of a million such pairs may collide.
BACKGROUND, COLLISIONS = 0.01, 20
KEPT_WORDS = 400_000
#: Rows of two or three numbers that are sent to all executors; larger tables are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Texts that Python gets at once.
TEXTS_AT_ONCE = 256
#: Numbers of 64 bits that tell dissimilar sets apart.
MARKS = 4
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EDGES = " .,;:!?\"'()[]"
_CLOSING, _STOPS = "\"')]", ".!?"
_TOKEN = re.compile(r"\S+")


def tune_bands(similarity: float = SIMILARITY, recall: float = RECALL, background: float = BACKGROUND,
               collisions: float = COLLISIONS) -> tuple[int, int]:
    """(bands, rows): the fewest bands that find pairs of ``similarity`` with probability ``recall``.

    Rows are as few as keep the collisions among a million pairs of ``background`` similarity below ``collisions``.
    """
    for rows in range(1, 33):
        bands = int(np.ceil(np.log(1 - recall) / np.log1p(-(similarity ** rows))))
        if 1e6 * -np.expm1(bands * np.log1p(-(background ** rows))) <= collisions:
            return bands, rows
    raise ValueError("no banding meets these figures")


class _Codes(dict):
    """Codes by word; the memory is emptied when it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        bare = word.lower().strip(_EDGES) or word
        code = self[word] = xxhash.xxh64_intdigest(bare.encode()) & ~1 | (word.rstrip(_CLOSING)[-1:] in {*_STOPS})
        return code


def _word_codes(words: list[str]) -> np.ndarray:
    """64-bit code per word without case and edge punctuation; the lowest bit tells whether a sentence ends there."""
    known = kept_in_worker("paragraph words", _Codes)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    out = x >> np.uint64(31)
    out ^= x
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def runs(codes: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` codes: a polynomial in them, built by doubling the run."""
    total, width = codes, 1
    for bit in f"{length:b}"[1:]:
        total, width = total[:-width] * np.uint64(pow(int(_MIX), width, 2**64)) + total[width:], 2 * width
        if bit == "1":
            total, width = total[:-1] * _MIX + codes[width:], width + 1
    return _mixed(total)


def shingles(codes: np.ndarray, length: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes; a shorter paragraph is one shingle."""
    return np.unique(runs(codes, min(length, len(codes)))) if len(codes) else np.empty(0, np.uint64)


def paragraphs(text: str) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Word codes of a text, and (first word, words) of its lines."""
    words: list[str] = []
    lines = []
    for line in text.split("\n"):
        if own := line.split():
            lines.append((len(words), len(own)))
            words += own
    return _word_codes(words), lines


def _among(chars: str) -> np.ndarray:
    """Per byte, whether it is one of these characters."""
    return np.isin(np.arange(256), np.frombuffer(chars.encode(), np.uint8))


_IS_SPACE, _IS_EDGE, _IS_CLOSING, _IS_STOP = map(_among, ("\t\n\v\f\r\x1c\x1d\x1e\x1f ", _EDGES, _CLOSING, _STOPS))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def _small_letters() -> np.ndarray:
    """The small letter of every character of up to three bytes; -1 where it depends on its neighbours, or has another size."""
    out = np.full(0x10000, -1, np.int32)
    for code in (*range(0xD800), *range(0xE000, 0x10000)):
        char = chr(code)
        small = char.lower()
        if len(small) == 1 and len(small.encode()) == len(char.encode()) and char != "\u03a3":  # a sigma may be a last one
            out[code] = ord(small)
    return out


_SMALL = _small_letters()
#: White space of more than one byte by its first two bytes, and which third ones follow.
_WIDE_SPACES = [(0xC2, 0x85, ()), (0xC2, 0xA0, ()), (0xE1, 0x9A, (0x80,)), (0xE2, 0x80, (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, 0x81, (0x9F,)),
                (0xE3, 0x80, (0x80,))]


def _spaces(data: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Per byte of UTF-8 text whether it belongs to white space; ``wide`` has the positions of bytes beyond ASCII. Three bytes must follow."""
    space = _IS_SPACE[data]
    if len(wide):
        lead, second, third = data[wide], data[wide + 1], data[wide + 2]
        for one, two, thirds in _WIDE_SPACES:
            at = wide[(lead == one) & (second == two) & (np.isin(third, thirds) if thirds else True)]
            for k in range(3 if thirds else 2):
                space[at + k] = True
    return space


def _lowered(data: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 text in small letters, and the positions of characters for which that takes more than replacing them."""
    out, strange = _LOWER[data], [wide[data[wide] >= 0xF0]]
    for least, size in ((0xC2, 2), (0xE0, 3)):
        at = wide[(data[wide] >= least) & (data[wide] < (0xE0 if size == 2 else 0xF0))]
        code = data[at].astype(np.int32) & (0x1F if size == 2 else 0x0F)
        for k in range(1, size):
            code = code << 6 | data[at + k] & 0x3F
        small = _SMALL[code]
        strange.append(at[small < 0])
        new = (small >= 0) & (small != code)
        at, small = at[new], small[new]
        for k in range(size - 1, 0, -1):
            out[at + k], small = 0x80 | small & 0x3F, small >> 6
        out[at] = (0xC0 if size == 2 else 0xE0) | small
    return out, np.sort(np.concatenate(strange))


_P1, _P2, _P3, _P4, _P5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 of pieces of ``data``, those of one size at once. Eight bytes must follow the last piece."""
    out = np.empty(len(starts), np.uint64)
    eight, four = (np.ndarray(len(data) - width + 1, f"<u{width}", data, strides=(1,)) for width in (8, 4))
    short = np.minimum(sizes, 32).astype(np.uint8)
    order = np.argsort(short, kind="stable")
    cuts = np.searchsorted(short[order], np.arange(34))
    for size in range(32):
        of = order[cuts[size]:cuts[size + 1]]
        if not len(of):
            continue
        at, left = starts[of], size
        h = np.full(len(of), _P5 + np.uint64(size))
        while left >= 8:
            h ^= _rotated(eight[at] * _P2, 31) * _P1
            h = _rotated(h, 27) * _P1 + _P4
            at, left = at + 8, left - 8
        if left >= 4:
            h ^= four[at].astype(np.uint64) * _P1
            h = _rotated(h, 23) * _P2 + _P3
            at, left = at + 4, left - 4
        for k in range(left):
            h ^= data[at + k].astype(np.uint64) * _P5
            h = _rotated(h, 11) * _P1
        h ^= h >> np.uint64(33)
        h *= _P2
        h ^= h >> np.uint64(29)
        h *= _P3
        out[of] = h ^ h >> np.uint64(32)
    for i in order[cuts[32]:]:
        out[i] = xxhash.xxh64_intdigest(data[starts[i]:starts[i] + sizes[i]])
    return out


class Coded(NamedTuple):
    """Texts one after the other."""
    #: A code per word, as in :func:`paragraphs`.
    codes: np.ndarray
    #: The first word of every text, and the number of words at last.
    base: np.ndarray
    #: First word, words and text of every line, blank ones too.
    starts: np.ndarray
    sizes: np.ndarray
    of: np.ndarray


def coded_texts(texts: pa.StringArray) -> Coded:
    """Word codes of many texts at once, straight from their bytes; null is an empty text.

    Only words whose small letters are not found by replacing characters become strings.
    """
    texts = texts.cast(pa.string()).fill_null("")
    cuts = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.zeros(cuts[-1] - cuts[0] + 8, np.uint8)
    if held is not None:
        data[:-8] = np.frombuffer(held, np.uint8)[cuts[0]:cuts[-1]]
    cuts -= cuts[0]
    wide = np.flatnonzero(data >= 0x80)
    inside = ~_spaces(data, wide)
    inside[-8:] = False
    parted = np.zeros(len(data), bool)  # a text begins here
    parted[cuts] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | parted[1:]
    ends[:-1] &= ~inside[1:] | parted[1:]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    # lines
    breaks = np.flatnonzero(data == 10) + 1
    owner = np.searchsorted(cuts, breaks - 1, "right") - 1
    heads = np.concatenate([cuts[:-1], breaks])
    order = np.lexsort([heads, of := np.concatenate([np.arange(len(texts)), owner])])
    # a line that begins where the next text does is blank
    starts, of = np.searchsorted(begins, heads[order]), of[order]
    base = np.searchsorted(begins, cuts)
    starts = np.minimum(starts, base[of + 1])
    sizes = np.diff(np.append(starts, len(begins)))
    # words without the signs around them
    first, last = begins.copy(), ends.copy()
    more = np.flatnonzero(_IS_EDGE[data[first]])
    while len(more):
        first[more] += 1
        more = more[(first[more] < last[more]) & _IS_EDGE[data[first[more]]]]
    more = np.flatnonzero((first < last) & _IS_EDGE[data[last - 1]])
    while len(more):
        last[more] -= 1
        more = more[_IS_EDGE[data[last[more] - 1]]]
    signs = first == last
    first[signs], last[signs] = begins[signs], ends[signs]
    lower, strange = _lowered(data, wide)
    codes = _xxh64(lower, first, last - first) & ~np.uint64(1)
    final = ends - 1
    more = np.flatnonzero(_IS_CLOSING[data[final]])
    while len(more):
        final[more] -= 1
        more = more[final[more] >= begins[more]]
        more = more[_IS_CLOSING[data[final[more]]]]
    codes |= ((final >= begins) & _IS_STOP[data[np.maximum(final, 0)]]).astype(np.uint64)
    if len(strange):
        strange = np.unique(np.searchsorted(begins, strange, "right") - 1)
        strange = strange[strange >= 0]
        codes[strange] = _word_codes([data[b:e].tobytes().decode() for b, e in zip(begins[strange].tolist(), ends[strange].tolist(), strict=True)])
    return Coded(codes, base, starts, sizes, of)


def wrapped(lines: Coded) -> np.ndarray:
    """(first word, words, text) of the paragraphs of two lines or more, which blank lines part."""
    filled = np.flatnonzero(lines.sizes)
    if not len(filled):
        return np.empty((0, 3), np.int64)
    new = np.flatnonzero(np.concatenate(([True], (np.diff(filled) > 1) | (np.diff(lines.of[filled]) > 0))))
    last = np.append(new[1:], len(filled)) - 1
    several = last > new
    first, last = filled[new[several]], filled[last[several]]
    return np.stack([lines.starts[first], lines.starts[last] + lines.sizes[last] - lines.starts[first], lines.of[first]], axis=1)


def _lowest_of_each(hashes: np.ndarray, span: int) -> np.ndarray:
    """Position of the smallest of ``span`` adjacent hashes for every start, of equal ones the first."""
    low, at, width = hashes, np.arange(len(hashes)), 1
    while width < span:
        step = min(width, span - width)
        less = low[step:] < low[:-step]
        low, at, width = np.where(less, low[step:], low[:-step]), np.where(less, at[step:], at[:-step]), width + step
    return at


def lowest(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions of the smallest of every ``span`` adjacent hashes, of equal ones the first."""
    return np.unique(_lowest_of_each(hashes, min(span, len(hashes))))


#: Numbers that are mixed at once: what fits into a core's cache.
_AT_ONCE = 131_072


def _lows(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The smallest hash under each seed in every range, which may overlap: a row per seed.

    Hashes are compared before the last step of :func:`_mixed`, and the first one is taken out of the loop.
    """
    cuts = np.stack([begins, ends], axis=1).ravel()
    spread, turns = (np.append(x ^ x >> np.uint64(31), np.uint64(0)) for x in (hashes, seeds))
    out = np.empty((len(seeds), len(begins)), np.uint64)
    step = min(max(1, _AT_ONCE // len(spread)), len(seeds))
    room = np.empty((step, len(spread)), np.uint64)
    for k in range(0, len(seeds), step):
        mixed = np.bitwise_xor(spread[None, :], turns[k:min(k + step, len(seeds)), None], out=room[:len(seeds) - k])
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed[:, -1] = np.uint64(2**64 - 1)
        out[k:k + step] = np.minimum.reduceat(mixed, cuts, axis=1)[:, ::2]
    out ^= out >> np.uint64(29)
    return out


def band_keys(codes: np.ndarray, lines: list[tuple[int, int]], seeds: np.ndarray, bands: int, rows: int, shingle: int) -> np.ndarray:
    """A row of band keys per line: the smallest shingle hash for each seed, ``rows`` of them and the band to a key."""
    starts, sizes = np.array(lines, np.int64).reshape(-1, 2).T
    if (sizes >= shingle).all():  # lines may overlap: their shingles are hashed once
        hashes, begins, ends = runs(codes, shingle), starts, starts + sizes - shingle + 1
    else:
        counts = np.maximum(sizes - shingle, 0) + 1
        ends = np.cumsum(counts)
        hashes, begins = np.concatenate([runs(codes[s:s + n], min(shingle, n)) for s, n in lines]), ends - counts
    lows = _lows(hashes, begins, ends, seeds)
    total = np.repeat(np.arange(1, bands + 1, dtype=np.uint64)[:, None], len(lines), axis=1)
    for r in range(rows):
        total = total * _MIX + lows[r::rows]
    return _mixed(total).T.astype(np.int64)


def seeds_of(bands: int, rows: int) -> np.ndarray:
    """A seed per row of every band."""
    return _mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * _MIX)


def _lists(values: np.ndarray, of: np.ndarray, n: int, kind: np.dtype) -> pa.ListArray:
    """``n`` lists; ``of`` tells in ascending order whose a value is."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), pa.array(values.astype(kind)))


def _window_starts(texts: Coded, hashes: np.ndarray, window: int) -> np.ndarray:
    """Where windows of texts start: at sentences, at lines and at the smallest of every ``SPAN`` adjacent hashes of a text."""
    codes, base = texts.codes, texts.base
    rest = np.repeat(base[1:], np.diff(base)) - np.arange(len(codes))  # words from here to the end of the text
    chosen = np.concatenate(([True], (codes[:-1] & np.uint64(1)).astype(bool)))
    chosen[texts.starts[texts.sizes > 0]] = True
    if len(hashes) >= SPAN:
        at = _lowest_of_each(hashes, SPAN)
        chosen[at[rest[:len(at)] >= SPAN - 1 + window]] = True
    sizes = np.diff(base)
    for i in np.flatnonzero((sizes >= window) & (sizes < SPAN - 1 + window)):
        own = hashes[base[i]:base[i + 1] - window + 1]
        chosen[base[i] + own.argmin()] = True
    return np.flatnonzero(chosen & (rest >= window))


def _units(bands: int, rows: int, window: int, shingle: int):
    """Per document: places and hashes of its lines, their band keys one after the other, and places and hashes of its windows."""
    seeds = seeds_of(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            n = batch.num_rows
            texts = coded_texts(batch.column("text"))
            bare = texts.codes & ~np.uint64(1)
            lines = np.concatenate([np.stack([texts.starts, texts.sizes, texts.of], axis=1), wrapped(texts)])
            lines = lines[lines[:, 1] >= shingle]
            lines = lines[np.argsort(lines[:, 2], kind="stable")]
            places, of = lines[:, :2], lines[:, 2]
            keys = band_keys(bare, places, seeds, bands, rows, shingle).ravel() if len(places) else np.empty(0, np.int64)
            held = memoryview(bare).cast("B") if len(bare) else b""
            names = np.array([xxhash.xxh64_intdigest(held[8 * s:8 * (s + size)], size) for s, size in places.tolist()], np.uint64)
            hashes = runs(bare, window) if len(bare) >= window else np.empty(0, np.uint64)
            starts = _window_starts(texts, hashes, window) if len(hashes) else np.empty(0, np.int64)
            owner = np.searchsorted(texts.base, starts, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), _lists(places[:, 0] - texts.base[of], of, n, np.int32), _lists(places[:, 1], of, n, np.int32), _lists(names.view(np.int64), of, n, np.int64),
                 _lists(keys, np.repeat(of, bands), n, np.int64), _lists(starts - texts.base[owner], owner, n, np.int32), _lists(hashes[starts].view(np.int64), owner, n, np.int64)],
                ["doc", "line_start", "line_length", "line_unit", "line_keys", "window_start", "window_unit"])
    return run


_UNITS = ("doc struct<id: bigint, content: bigint>, line_start array<int>, line_length array<int>, line_unit array<bigint>, line_keys array<bigint>, "
          "window_start array<int>, window_unit array<bigint>")


def _line_keys(units: DataFrame, bands: int) -> DataFrame:
    """(unit, key) per line and band."""
    each = units.select("line_unit", F.posexplode("line_keys").alias("i", "key"))
    return each.select(F.col("line_unit")[F.floor(F.col("i") / bands).cast("int")].alias("unit"), "key")


def _places(units: DataFrame, window: int) -> DataFrame:
    """(doc, start, length, unit, line) per line and per window."""
    def each(start: str, length: Column, unit: str, line: bool, *more: str) -> DataFrame:
        return units.select("doc", F.explode(F.arrays_zip(start, unit, *more)).alias("p")).select(
            "doc", F.col(f"p.{start}").alias("start"), length.alias("length"), F.col(f"p.{unit}").alias("unit"), F.lit(line).alias("line"))
    return each("line_start", F.col("p.line_length"), "line_unit", True, "line_length").union(each("window_start", F.lit(window), "window_unit", False))


def _inside(lists: pa.ListArray) -> tuple[np.ndarray, list[pa.Array]]:
    """Whose each struct of lists without nulls is, and the structs' fields."""
    return np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().flatten()


def _segments(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ranges, one range after the other, and where each begins among them, with the end at last."""
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    return np.arange(cuts[-1]) + np.repeat(starts - cuts[:-1], sizes), cuts


def _marks(hashes: np.ndarray) -> np.ndarray:
    """One bit in ``MARKS`` numbers for every hash: a row per number."""
    bit = np.uint64(1) << (hashes & np.uint64(63))
    return np.where(hashes >> np.uint64(6) & np.uint64(MARKS - 1) == np.arange(MARKS, dtype=np.uint64)[:, None], bit, np.uint64(0))


def _shingle_sets(shingle: int):
    """Shingles of the wanted lines of a document, and of which bits of ``_marks`` they have an odd number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = coded_texts(batch.column("text"))
            bare = texts.codes & ~np.uint64(1)
            of, wanted = _inside(batch.column("wanted"))
            unit, start, length = (x.to_numpy(zero_copy_only=False) for x in wanted)
            start = texts.base[of] + start
            hashes = runs(bare, shingle) if len(bare) >= shingle else np.empty(0, np.uint64)
            long = length >= shingle
            at, cuts = _segments(start, np.where(long, length - shingle + 1, np.minimum(length, 1)))
            sets = np.empty(len(at), np.uint64)
            fresh = np.ones(len(at), bool)
            for i in range(len(unit)):
                own = sets[cuts[i]:cuts[i + 1]]
                own[:] = hashes[at[cuts[i]:cuts[i + 1]]] if long[i] else shingles(bare[start[i]:start[i] + length[i]], shingle)
                own.sort()
            fresh[1:] = sets[1:] != sets[:-1]
            fresh[cuts[:-1][cuts[:-1] < len(at)]] = True
            kept = np.concatenate(([0], np.cumsum(fresh)))[cuts]
            sets = sets[fresh]
            sums = np.concatenate([np.zeros((MARKS, 1), np.uint64), np.bitwise_xor.accumulate(_marks(sets), axis=1)], axis=1)
            marks = (sums[:, kept[1:]] ^ sums[:, kept[:-1]]).T.ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(unit, pa.int64()), pa.ListArray.from_arrays(pa.array(kept, pa.int32()), pa.array(sets.view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(unit) + 1) * MARKS, pa.int32()), pa.array(marks))], ["unit", "sh", "marks"])
    return run


def _shared(sizes: Column, similarity: float) -> Column:
    """How many members two sets of so many in all share at the similarity, but for rounding."""
    return F.floor(similarity * sizes / (1 + similarity)).cast("int")


def _may_be_alike(a: str, b: str, sizes: Column, similarity: float) -> Column:
    """False for sets that differ in more members than similar ones do: every mark that differs is at least one of them."""
    differing = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(MARKS)]
    return sum(differing[1:], differing[0]) <= sizes - 2 * _shared(sizes, similarity) + 2


def _alike(a: str, b: str, similarity: float) -> Column:
    """Whether two sets of shingles reach the similarity: they share at least as many as sets of their sizes must.

    That number is the smallest that holds in ``n >= similarity * (sizes - n)``, so that the sets are intersected once.
    """
    sizes = F.size(a) + F.size(b)
    near = _shared(sizes, similarity)
    least = near + 2
    for n in (near + 1, near, near - 1):
        least = F.when(n >= similarity * (sizes - n), n).otherwise(least)
    return F.size(F.array_intersect(a, b)) >= least


def _comparable(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) that sizes and marks of the sets (unit, n, and marks if there are) don't rule out; no set moves."""
    slim = [c for c in ("n", "marks") if c in sets.columns]
    n_a, n_b = (sets.select(F.col("unit").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in slim]) for c in ("a", "b"))
    near = F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")
    if "marks" in slim:
        near &= _may_be_alike("marks_a", "marks_b", F.col("n_a") + F.col("n_b"), similarity)
    return pairs.join(n_a, "a").join(n_b, "b").where(near).select("a", "b")


def _compared(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose sets (unit, sh) reach the similarity."""
    left, right = (sets.select(F.col("unit").alias(c), F.col("sh").alias(f"sh_{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where(_alike("sh_a", "sh_b", similarity)).select("a", "b")


def _jaccard(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets (unit, sh, n of them, and marks if there are) reach the similarity."""
    return _compared(_comparable(pairs, sets, similarity), sets, similarity)


def _bounded(slim: DataFrame) -> DataFrame:
    """A written table of numbers, to be broadcast if its size, which is counted, allows it."""
    return F.broadcast(slim) if slim.count() <= BROADCAST_ROWS else slim


def similar_units(docs: DataFrame, lines: DataFrame, similarity: float, shingle: int, more: DataFrame | None = None, slots: DataFrame | None = None) -> DataFrame:
    """(node, root) for distinct lines, or other units of the documents, that are similar to others, directly or through others.

    Lines (doc, start, length, unit) that share a key are a bucket: ``slots`` has (unit, key), or else ``lines`` have ``keys``.
    ``more`` (unit, key) names further buckets, in which a line stands once.

    Buckets never list their pairs. First every line meets three centres of its bucket, the smallest, the largest and
    the smallest by the other half; the links that hold give components. Then, in buckets of more lines than that compares, only lines of a
    bucket's minor components meet the bucket's lines of other components, so that no link between components is lost
    while a bucket full of near copies costs three comparisons a line.
    """
    slots = lines.select("unit", F.explode("keys").alias("key")) if slots is None else slots
    slots = slots if more is None else slots.union(more)
    def turned(unit: str) -> Column:  # its halves change places
        return F.shiftleft(unit, 32).bitwiseOR(F.shiftrightunsigned(unit, 32))
    buckets = slots.groupBy("key").agg(F.min("unit").alias("low"), F.max("unit").alias("high"), F.min(turned("unit")).alias("some")).where("low < high")
    shared = materialize(buckets.select("key", F.array_distinct(F.array("low", "high", turned("some"))).alias("centres")), "buckets")
    # only keys go to every executor; the centres meet the few lines that are left
    slots = slots.join(_bounded(shared.select("key")), "key", "left_semi").distinct()
    slots = materialize(slots.join(shared, "key").select("key", "unit", "centres"), "colliding-lines")
    release(shared)
    colliding = materialize(slots.select("unit").distinct(), "colliding-units")
    few = colliding.count() <= BROADCAST_ROWS
    some = lines.select("unit", "doc", "start", "length").join(F.broadcast(colliding) if few else colliding, "unit").groupBy("unit").agg(
        F.min(F.struct("doc", "start", "length")).alias("place"))
    wanted = materialize(some.select("unit", "place.*").groupBy("doc").agg(F.collect_list(F.struct("unit", "start", "length")).alias("wanted")), "wanted-lines")
    # ``wanted`` lists every colliding line once
    texts = docs.select(row_key().alias("doc"), "text").join(F.broadcast(wanted) if few else wanted, "doc")
    sets = texts.select("text", "wanted").mapInArrow(_shingle_sets(shingle), "unit long, sh array<bigint>, marks array<bigint>")
    with arrow_rows(docs.sparkSession, TEXTS_AT_ONCE):
        sets = materialize(sets.dropDuplicates(["unit"]).withColumn("n", F.size("sh")), "shingle-sets")
    release(colliding, wanted)
    stars = slots.select("unit", F.explode("centres").alias("centre")).where("unit <> centre").select(
        F.least("unit", "centre").alias("a"), F.greatest("unit", "centre").alias("b")).distinct()
    pairs = materialize(_comparable(stars, sets, similarity), "star-pairs")
    met = pairs.select(F.col("a").alias("unit")).union(pairs.select("b")).distinct()
    met = sets.join(F.broadcast(met) if pairs.count() <= BROADCAST_ROWS else met, "unit", "left_semi")
    links = materialize(_compared(pairs, met, similarity), "star-links")
    release(pairs)
    roots = connected_components(links)
    rooted = slots.join(roots.withColumnRenamed("node", "unit"), "unit", "left").select(
        "unit", "key", F.coalesce("root", "unit").alias("root"), F.size("centres").alias("n_centres"))
    rooted = materialize(rooted, "rooted-lines")
    # a bucket with no more than one line besides its centres has been compared already
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.max("n_centres").alias("n_centres"))
    major = sizes.groupBy("key").agg(F.max_by("root", "n").alias("major"), F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.max("n_centres").alias("n_centres"))
    major = major.where("kinds > 1 AND n > n_centres + 1").select("key", "major")
    mixed = materialize(rooted.drop("n_centres").join(major, "key"), "mixed-lines")
    crossing = materialize(mixed.select("unit").distinct(), "mixed-units")
    met = F.broadcast(crossing) if crossing.count() <= BROADCAST_ROWS else crossing
    told = slots.join(met, "unit", "left_semi").groupBy("unit").agg(F.collect_list("key").alias("keys")).join(sets.drop("n").join(met, "unit", "left_semi"), "unit")
    told = materialize(mixed.join(told, "unit"), "mixed-buckets")
    release(mixed, crossing)
    mixed = told
    minor, other = (mixed.select("key", *[F.col(c).alias(f"{side}_{c}") for c in ("unit", "root", "keys", "sh", "marks")], *more)
                    for side, more in (("x", ["root", "major"]), ("y", [])))
    n_x, n_y = F.size("x_sh"), F.size("y_sh")
    # a pair is compared in the first bucket it shares, and inside the join: only links come out
    link = ((F.col("x_root") != F.col("y_root")) & (F.least(n_x, n_y) >= similarity * F.greatest(n_x, n_y)) & _may_be_alike("x_marks", "y_marks", n_x + n_y, similarity)
            & (F.array_min(F.array_intersect("x_keys", "y_keys")) == minor["key"]) & _alike("x_sh", "y_sh", similarity))
    minor = minor.where("root <> major").drop("root", "major")
    more = minor.join(other, (minor["key"] == other["key"]) & link).select(F.least("x_unit", "y_unit").alias("a"), F.greatest("x_unit", "y_unit").alias("b")).distinct()
    found = connected_components(links.union(more))
    release(slots, sets, links, roots, rooted, mixed)
    return found


def repeated_passages(docs: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL, shingle: int = SHINGLE, window: int = WINDOW) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that repeat: (doc, start, length, kind, cluster_doc, cluster_start, removed).

    ``start`` and ``length`` count words between white space. ``cluster_doc`` and ``cluster_start`` name the first
    occurrence (smallest id, then position), which has ``removed`` false; the others are removed. ``kind`` is
    ``paragraph`` for similar lines, or lines up to a blank line as one, and ``passage`` for verbatim runs. Overlapping
    runs are joined, and removed ones reach as far as the words agree with the first occurrence.

    Paragraphs of ``shingle`` words or more are compared, and verbatim runs of ``window + SPAN - 1`` words or more are
    found for sure. All that is found is removed but for the first occurrence, short paragraphs too. Shorter
    paragraphs, null and empty texts take no part. A null id comes after all
    others. Equal rows are one occurrence, so that neither loses its text because of the other; near-duplicate
    removal of whole documents is another operator. An empty table gives an empty table.
    """
    bands, rows = tune_bands(similarity, recall)
    slim = docs.select(row_key().alias("doc"), "text")
    with arrow_rows(docs.sparkSession, TEXTS_AT_ONCE):
        units = materialize(slim.mapInArrow(_units(bands, rows, window, shingle), _UNITS), "units")
    components = similar_units(docs, _places(units, window).where("line"), similarity, shingle, slots=_line_keys(units, bands))
    roots = materialize(components, "line-clusters")
    release(components)
    # most windows stand in one place only: hashes alone are counted, and only places of repeated ones are written
    hashes = units.select(F.explode("line_unit").alias("unit")).union(units.select(F.explode("window_unit")))
    again = hashes.groupBy("unit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("unit")
    again = materialize(again.union(roots.select("node")).distinct(), "repeated-units")
    kept = materialize(_places(units, window).join(_bounded(again), "unit").select("doc", "start", "length", "unit", "line"), "repeated-places")
    release(units, again)
    place = F.struct(F.col("doc.id").isNull().alias("none"), "doc", "start").alias("place")
    lined = kept.where("line").join(roots.withColumnRenamed("node", "unit"), "unit", "left")
    # a single number is the key of every sort: more columns, structs and strings are slow to compare
    placed = lined.select(F.coalesce("root", "unit").alias("of"), "line", "doc", "start", "length").union(
        kept.where("NOT line").select(F.col("unit").alias("of"), "line", "doc", "start", "length"))
    first = placed.groupBy("of").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("of", "first")
    # written, so that the places of one frequent cluster are not tied to the task that found its first
    first = materialize(first, "first-places")
    found = placed.join(first, "of").select(
        "doc", "start", "length", F.when(F.col("line"), "paragraph").otherwise("passage").alias("kind"), F.col("first.doc").alias("to_doc"),
        F.col("first.start").alias("to"), (place != F.col("first")).alias("removed"))
    found = materialize(_joined(found), "joined-passages")
    release(kept, roots, first)
    longer, sides = _extended(docs, found)
    result = materialize(longer.select("doc", "start", "length", "kind", F.col("to_doc.id").alias("cluster_doc"),
                                                F.col("to").alias("cluster_start"), "removed"), "repeated-passages")
    release(found, sides)
    return result


def _sides(reach: int):
    """Words in front of each wanted place, the nearest first, and behind it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            texts = coded_texts(batch.column("text"))
            codes = (texts.codes & ~np.uint64(1)).view(np.int64)
            of, (start, length, *to) = _inside(batch.column("places"))
            begin = texts.base[of] + start.to_numpy()
            end = begin + length.to_numpy()
            n_before, n_after = np.minimum(start.to_numpy(), reach), np.minimum(texts.base[of + 1] - end, reach)
            at, cuts = _segments(np.zeros(len(of), np.int64), n_before)
            before = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(codes[np.repeat(begin - 1, n_before) - at]))
            at, cuts = _segments(end, n_after)
            after = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(codes[at]))
            yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(of)), start, length, *to, before, after], ["doc", "start", "length", "to_doc", "to", "before", "after"])
    return run


def _extended(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``found`` with removed passages that go as far as the words at both ends agree with the first occurrence, and the written sides.

    A run of equal words goes on for fewer than ``SPAN`` words beyond its first and last common window, for else
    there would be another one: so few words a side are compared. Passages get their sides where their text is read;
    only those of first occurrences, of which there are few, are joined to them.
    """
    key = "struct<id: bigint, content: bigint>"
    passages = found.where("kind = 'passage' AND removed").select("doc", "start", "length", "to_doc", "to")
    firsts = passages.select(F.col("to_doc").alias("doc"), F.col("to").alias("start"), "length").distinct()
    places = passages.union(firsts.select("doc", "start", "length", F.lit(None).cast(key), F.lit(None).cast("int")))
    places = places.groupBy("doc").agg(F.collect_list(F.struct("start", "length", "to_doc", "to")).alias("places"))
    one = Window.partitionBy("doc").orderBy(F.lit(1))
    texts = docs.select(row_key().alias("doc"), "text").join(places, "doc").withColumn("nth", F.row_number().over(one)).where("nth = 1")
    sides = texts.select("doc", "text", "places").mapInArrow(
        _sides(SPAN), f"doc {key}, start int, length int, to_doc {key}, to int, before array<bigint>, after array<bigint>")
    with arrow_rows(docs.sparkSession, TEXTS_AT_ONCE):
        sides = materialize(sides, "passage-sides")
    own = sides.where(F.col("to").isNotNull()).withColumn("at", F.xxhash64("to_doc", "to", "length"))
    other = sides.where(F.col("to").isNull()).select(F.xxhash64("doc", "start", "length").alias("at"), F.col("doc").alias("to_doc"), F.col("start").alias("to"), "length",
                                             F.col("before").alias("to_before"), F.col("after").alias("to_after"))
    both = own.join(other, ["at", "to_doc", "to", "length"])

    def agree(a: str, b: str) -> Column:
        stop = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
        return F.when(stop == 0, F.size(a)).otherwise(stop - 1).cast("int")
    more = both.withColumn("front", agree("before", "to_before")).withColumn("behind", agree("after", "to_after"))
    more = more.select("doc", (F.col("start") - F.col("front")).alias("start"), (F.col("length") + F.col("front") + F.col("behind")).alias("length"),
                       F.lit("passage").alias("kind"), "to_doc", (F.col("to") - F.col("front")).alias("to"), F.lit(True).alias("removed"))
    return _joined(more).unionByName(found.where("NOT (kind = 'passage' AND removed)")), sides


def _numbers(column: pa.Array) -> list[np.ndarray]:
    """A column, or the fields of structs, as whether null and the number."""
    if pa.types.is_struct(column.type):
        return [x for part in column.flatten() for x in _numbers(part)]
    filled = column.fill_null(False if pa.types.is_boolean(column.type) else 0)
    return [column.is_null().to_numpy(zero_copy_only=False), filled.to_numpy(zero_copy_only=False)]


def _islands(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The first row, with the length of all, of each island of overlapping passages and of equal paragraphs.

    Rows are sorted by ``run``, which is a hash: two keys in one run are sorted apart.
    """
    rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    run, start, length, to = (rows.column(c).to_numpy() for c in ("run", "start", "length", "to"))
    passage = rows.column("passage").to_numpy(zero_copy_only=False)
    key = [passage, np.where(passage, to - start, 0), *(x for c in ("doc", "to_doc", "removed") for x in _numbers(rows.column(c)))]

    def differs(numbers: list[np.ndarray]) -> np.ndarray:
        return np.logical_or.reduce([x[1:] != x[:-1] for x in numbers])
    other = differs(key)
    order = np.lexsort([to, length, start, *(key if (other & (run[1:] == run[:-1])).any() else []), run])
    rows = rows.take(pa.array(order))
    passage, start, length, to, *key = (x[order] for x in (passage, start, length, to, *key))
    other = differs(key)
    end = start.astype(np.int64) + length
    group = np.concatenate(([0], np.cumsum(other))) << 32
    apart = np.where(passage[1:], np.maximum.accumulate(end + group)[:-1] - group[1:] < start[1:], differs([start, length, to]))
    first = np.flatnonzero(np.concatenate(([True], other | apart)))
    reach = np.maximum.reduceat(end, first) - start[first]
    kept = rows.take(pa.array(first)).select(["doc", "passage", "to_doc", "removed", "start", "to"])
    return kept.append_column("length", pa.array(reach, pa.int32()))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`_islands` of whole runs."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            run = batch.column("run").to_numpy()
            last = int(np.searchsorted(run, run[-1]))  # the last run may go on in the next batch
            if last or held and held[-1].column("run")[0].as_py() != run[0]:
                if whole := [b for b in (*held, batch.slice(0, last)) if b.num_rows]:
                    yield _islands(whole)
                held = []
            held.append(batch.slice(last))
    if held:
        yield _islands(held)


def _joined(found: DataFrame) -> DataFrame:
    """Overlapping runs of a document with the same source at the same distance become one, and so do equal rows."""
    passage = F.col("kind") == "passage"
    run = F.xxhash64("doc", passage, "to_doc", "removed", F.when(passage, F.col("to") - F.col("start")))
    keyed = found.select("doc", passage.alias("passage"), "to_doc", "removed", "start", "length", "to", run.alias("run"))
    key = "struct<id: bigint, content: bigint>"
    merged = keyed.repartition("run").sortWithinPartitions("run").mapInArrow(
        _merged, f"doc {key}, passage boolean, to_doc {key}, removed boolean, start int, to int, length int")
    return merged.withColumn("kind", F.when(F.col("passage"), "passage").otherwise("paragraph")).drop("passage")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given runs of words, and without the white space behind each."""
    tokens = [m.start() for m in _TOKEN.finditer(text)] + [len(text)]
    gone = np.zeros(len(tokens) + 1, np.int64)
    for start, length in spans:
        gone[start] += 1
        gone[min(start + length, len(tokens) - 1)] -= 1
    inside = np.cumsum(gone)[:len(tokens) - 1] > 0
    out, at = [text[:tokens[0]]], 0
    for i, drop in enumerate(inside):
        if not drop:
            out.append(text[tokens[i]:tokens[i + 1]])
    return "".join(out)


def remove_repeats(docs: DataFrame, **options) -> DataFrame:
    """The documents, all columns, without repeated passages; documents of which nothing is left go.

    ``n_chars`` follows the new text where the column exists. Documents without repeats are returned as they are.
    """
    removed = repeated_passages(docs.select("doc_id", "text"), **options).where("removed").groupBy("doc").agg(
        F.collect_list(F.struct("start", "length")).alias("_spans"))
    packed = docs.select(F.struct("*").alias("_row"), row_key().alias("doc"), F.col("text").alias("_text")).join(removed, "doc", "left")
    packed = packed.select("_row", "_text", "_spans")
    schema = packed.select("_row", "_text", F.col("_spans").isNotNull().alias("_cut")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            spans = batch.column("_spans").to_pylist()
            texts = [t if s is None else without_words(t, [(x["start"], x["length"]) for x in s]) for t, s in
                     zip(batch.column("_text").to_pylist(), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), pa.array([s is not None for s in spans])],
                                             ["_row", "_text", "_cut"])
    cut = packed.mapInArrow(run, schema).where("NOT _cut OR trim(_text) <> ''")
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_cut"), F.length("_text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
           if "n_chars" in docs.columns else None}
    return cut.select(*[(new[c] if c in new else F.col("_row")[c]).alias(c) for c in docs.columns])
