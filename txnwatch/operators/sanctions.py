"""Screening names against sanctions lists: exact, fuzzy and by edit distance.

The fuzzy join never compares every name with every listed name. Jaro-Winkler at a threshold puts a floor
under the number of characters two names share, and that floor makes an equi-join that loses nothing:

* for pairs with at most two leading characters in common Winkler's bonus is at most 0.2, so jaro must reach
  (threshold - 0.2) / 0.8 and the names share at least ``ceil((3 jaro - 1) * l1 * l2 / (l1 + l2))`` characters,
  counted with repeats. With both names' characters in one fixed rarest-first order, the two prefixes that leave
  out fewer characters than the floor must meet in at least one of them. Pairs meet on (length, length, such a
  character);
* for any other pair the bonus is at most 0.4 and jaro must reach (threshold - 0.4) / 0.6: pairs meet on the three
  leading characters as well as on lengths and a rare character.

Cheap bounds on the joined pairs then leave few for the similarity function itself.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnwatch.functions.columns import bigrams, match_key, normalize_name
from txnwatch.functions.similarity import jaro_winkler
from txnwatch.operators.rules import alert_columns

THRESHOLD = 0.85
RULE_ID = "SAN-001"
_EPS = 1e-9
# Any fixed order of the normalized alphabet is correct; rare characters first makes the join selective.
_RARE_FIRST = "0123456789zqxjkvbpygfwmucldrhsnioate "
_STRIDE = 64


def merge_lists(*sources: DataFrame) -> DataFrame:
    """Several list sources as one; equal normalized names keep the first source, then the first position.

    Names that normalize to nothing are equal if their letters of any script are; without any they stay apart.
    """
    tagged = [s.select("pos", "name", "list_source", F.lit(i).alias("src")) for i, s in enumerate(sources)]
    whole = tagged[0]
    for part in tagged[1:]:
        whole = whole.unionByName(part)
    first = F.min_by(F.struct("pos", "name", "list_source", "src"), F.struct("src", "pos", "name")).alias("f")
    norm = normalize_name(F.col("name"))
    grouped = whole.groupBy(norm.alias("norm"), F.coalesce(match_key(F.col("name")), F.col("name")).alias("__key")).agg(first)
    return grouped.select("norm", "f.*")


def screening_candidates(names: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct names of two or more normalized characters that share a bigram with the lists.

    All bigrams are drawn from 37 characters, so the lists' bigrams are at most 1,369 values: one bounded
    array, whatever the size of the lists.
    """
    grams = listed.select(F.explode(bigrams(normalize_name(F.col("name")))).alias("g")).filter(F.length("g") > 0)
    known = grams.agg(F.collect_set("g").alias("known"))
    distinct = names.groupBy("name").agg(F.count(F.lit(1)).alias("uses")).withColumn("norm", normalize_name(F.col("name")))
    overlap = F.arrays_overlap(bigrams(F.col("norm")), known.scalar())
    # The mention of the count keeps Spark from running this costly test on every row before they are made distinct.
    passes = F.when(F.col("uses") > 0, (F.length("norm") >= 2) & overlap)
    return distinct.filter(passes).select("name", "norm")


def _rare_first_chars(text: Column) -> Column:
    """Each character with its repeat number as one integer, rarest first; unique within a text."""
    def coded(i: Column) -> Column:
        char = F.substring(text, i, F.lit(1))
        head = F.substring(text, F.lit(1), i)
        repeat = F.length(head) - F.length(F.replace(head, char, F.lit("")))
        return F.instr(F.lit(_RARE_FIRST), char) - repeat * F.lit(_STRIDE)

    return F.array_sort(F.transform(F.sequence(F.lit(1), F.length(text)), coded))


def _floor_factor(threshold: float, bonus: float = 0.2) -> float:
    """Share factor for pairs whose leading characters add at most ``bonus`` of what jaro leaves."""
    return 3.0 * (threshold - bonus) / (1.0 - bonus) - 1.0


def _shared_floor(len_a: Column, len_b: Column, factor: float) -> Column:
    return F.ceil(F.lit(factor) * len_a * len_b / (len_a + len_b) - F.lit(_EPS))


def _join_keys(df: DataFrame, text: str, factor: float, head_factor: float, own: str, other: str, partners: Column | None = None) -> DataFrame:
    """One row per join key: (own length, partner length, character), the character alone or behind the name's head.

    ``partners`` lists the lengths that occur on the other side.
    """
    size = F.col("size")
    coded = df.withColumns({"size": F.length(text), "chars": _rare_first_chars(F.col(text))})
    head = F.concat(F.substring(text, 1, 3), F.lit("|"))

    def reach(share: float) -> Column:
        lengths = F.sequence(F.ceil(size * F.lit(share - 1.0) - F.lit(_EPS)).cast("int"),
                             F.floor(size / F.lit(share - 1.0) + F.lit(_EPS)).cast("int"))
        return lengths if partners is None else F.array_intersect(lengths, partners)

    def by_char(lengths: str, share: float, before: Column) -> Column:
        return F.flatten(F.transform(
            F.filter(F.col(lengths), lambda n: (n >= 1) & (_shared_floor(size, n, share) <= F.least(size, n))),
            lambda n: F.transform(
                F.slice(F.col("chars"), F.lit(1), (size - _shared_floor(size, n, share) + 1).cast("int")),
                lambda c: F.struct(size.alias(own), n.alias(other), F.concat(before, c.cast("string")).alias("part")))))

    coded = coded.withColumns({"lengths": reach(factor), "head_lengths": reach(head_factor)})
    plain = by_char("lengths", factor, F.lit(""))
    keys = F.when(size >= 3, F.concat(plain, by_char("head_lengths", head_factor, head))).otherwise(plain)
    return coded.withColumn("key", F.explode(keys)).select("*", "key.*").drop("key", "lengths", "head_lengths")


def similar_pairs(names: DataFrame, listed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every (norm, listed norm) pair with similarity at or above the threshold; both sides distinct on ``norm``."""
    if not 0.5 <= threshold <= 1.0:
        raise ValueError("the candidate bound needs a threshold from 0.5 to 1")
    factor = _floor_factor(threshold)
    head_factor = _floor_factor(threshold, 0.4)
    if min(factor, head_factor) <= 1.0:
        raise ValueError("the candidate bound needs a threshold above 0.8")
    lengths = listed.agg(F.collect_set(F.length("norm"))).scalar()
    left = _join_keys(names.select("norm"), "norm", factor, head_factor, "len_a", "len_b", lengths).withColumnsRenamed({"size": "size_a", "chars": "chars_a"})
    right = (_join_keys(listed.select(F.col("norm").alias("listed_norm")), "listed_norm", factor, head_factor, "len_b", "len_a")
             .withColumnsRenamed({"size": "size_b", "chars": "chars_b"}))
    met = left.join(right, ["len_a", "len_b", "part"])
    a, b = F.col("norm"), F.col("listed_norm")
    shared = F.array_intersect("chars_a", "chars_b")
    prefix = sum(((F.substring(a, 1, i) == F.substring(b, 1, i)) & (F.least("size_a", "size_b") >= i)).cast("int") for i in range(1, 5))
    best_jaro = (F.size(shared) / F.col("size_a") + F.size(shared) / F.col("size_b") + 1.0) / 3.0
    reachable = best_jaro + prefix * 0.1 * (1.0 - best_jaro) >= threshold - _EPS
    # A pair that meets on several keys is kept at one: its rarest shared character, behind the head if they share it.
    rarest = F.element_at(shared, 1).cast("string")
    once = F.col("part") == F.when(prefix >= 3, F.concat(F.substring(a, 1, 3), F.lit("|"), rarest)).otherwise(rarest)
    close = met.filter(once & reachable).select("norm", "listed_norm")
    return close.withColumn("similarity", jaro_winkler("norm", "listed_norm")).filter(F.col("similarity") >= threshold)


def best_matches(names: DataFrame, listed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per distinct name its most similar listed name; the earlier list position wins a tie."""
    listed_once = merge_lists(listed)
    candidates = screening_candidates(names, listed)
    pairs = similar_pairs(candidates.select("norm").distinct(), listed_once.filter(F.length("norm") > 0), threshold)
    found = pairs.join(listed_once.withColumnsRenamed({"norm": "listed_norm", "name": "matched_name"}), "listed_norm")
    best = F.max_by(F.struct("matched_name", "list_source", "pos", "similarity"), F.struct("similarity", -F.col("pos"))).alias("m")
    return candidates.join(found.groupBy("norm").agg(best), "norm").select("name", "m.*")


def screen(df: DataFrame, listed: DataFrame, column: str, threshold: float = THRESHOLD) -> DataFrame:
    """Rows whose ``column`` matches a listed name, with the match; only distinct names are compared."""
    hits = best_matches(df.select(F.col(column).alias("name")), listed, threshold)
    return df.join(hits.withColumnRenamed("name", "__name"), F.col(column) == F.col("__name")).drop("__name")


def sanction_alerts(screened: DataFrame, created_at: str = "ts") -> DataFrame:
    text = F.concat(F.lit("Sanctions match: '"), F.col("matched_name"), F.lit("' (similarity: "),
                    F.format_string("%.2f", "similarity"), F.lit(")"))
    return screened.select(
        "txn_id", "customer_id", F.col(created_at).alias("created_at"), F.lit(RULE_ID).alias("rule_id"),
        F.lit("SANCTION").alias("alert_type"), F.lit("CRITICAL").alias("severity"), text.alias("rule_desc"),
        F.col("similarity").cast("float").alias("score")).select(*alert_columns())


def sanction_hits(screened: DataFrame, created_at: str = "ts") -> DataFrame:
    """The hit event: who was matched to which list entry, how closely."""
    return screened.select(
        F.sha2(F.concat_ws("|", "txn_id", F.lit("HIT")), 256).alias("hit_id"), "txn_id", "customer_id", "counterparty_id",
        "matched_name", "list_source", "similarity", F.col(created_at).alias("created_at"))


def exact_matches(names: DataFrame, listed: DataFrame) -> DataFrame:
    """Names whose normalized form is listed; names of other scripts match by their own letters, nothing matches nothing."""
    known = listed.select(match_key(F.col("name")).alias("norm")).distinct()
    return names.select("name", match_key(F.col("name")).alias("norm")).join(known, "norm", "left_semi")


def close_spellings(names: DataFrame, listed: DataFrame, distance: int = 2) -> DataFrame:
    """Pairs within an edit distance, found without comparing all pairs.

    An edit distance of at most d leaves one of d + 1 equal-sized pieces of the listed name untouched and
    moved by at most d, so pairs meet on (listed length, piece number, piece text). Listed names of d or fewer
    characters have no such pieces; they meet on length alone, among names of at most 2 d characters.
    """
    left = names.select("name", match_key(F.col("name")).alias("norm")).where("norm IS NOT NULL").distinct()
    right = listed.select(F.col("name").alias("matched_name"), "pos", match_key(F.col("name")).alias("listed_norm")).where("listed_norm IS NOT NULL")
    pieces = distance + 1

    def piece(size: Column, k: int) -> tuple[Column, Column]:
        start = F.floor(size * k / F.lit(pieces))
        return start, F.floor(size * (k + 1) / F.lit(pieces)) - start

    size_b = F.length("listed_norm")
    listed_keys = []
    for k in range(pieces):
        start, length = piece(size_b, k)
        listed_keys.append(F.struct(size_b.alias("len"), F.lit(k).alias("k"),
                                    F.substring(F.col("listed_norm"), (start + 1).cast("int"), length.cast("int")).alias("part")))
    short = F.array(F.struct(size_b.alias("len"), F.lit(-1).alias("k"), F.lit("").alias("part")))
    right = right.withColumn("key", F.explode(F.when(size_b > distance, F.array(*listed_keys)).otherwise(short)))

    size_a, text = F.length("norm"), F.col("norm")

    def keys_for(n: Column) -> Column:
        made = []
        for k in range(pieces):
            start, length = piece(n, k)
            for shift in range(-distance, distance + 1):
                at = start + shift
                fits = (at >= 0) & (at + length <= size_a)
                made.append(F.when(fits, F.struct(n.alias("len"), F.lit(k).alias("k"),
                                                  F.substring(text, (at + 1).cast("int"), length.cast("int")).alias("part"))))
        tiny = F.array(F.struct(n.alias("len"), F.lit(-1).alias("k"), F.lit("").alias("part")))
        return F.when(n > distance, F.array_compact(F.array(*made))).otherwise(tiny)

    lengths = F.sequence(F.greatest(size_a - distance, F.lit(0)), size_a + distance)
    left = left.withColumn("key", F.explode(F.array_distinct(F.flatten(F.transform(lengths, keys_for)))))
    gap = F.levenshtein("norm", "listed_norm", distance)
    met = left.join(right, "key").withColumn("distance", gap).filter(F.col("distance") >= 0)
    return met.select("name", "matched_name", "pos", "distance").distinct()


def with_aliases(listed: DataFrame, aliases: DataFrame) -> DataFrame:
    """Adds alias and former names to a list; ``aliases`` has (pos, alias) and keeps the entry's position."""
    extra = aliases.join(listed.select("pos", "list_source"), "pos").select("pos", F.col("alias").alias("name"), "list_source")
    return listed.select("pos", "name", "list_source").unionByName(extra)


def expected_floor(len_a: int, len_b: int, threshold: float = THRESHOLD) -> int:
    """Plain-number twin of the shared-character floor, for tests."""
    return math.ceil(_floor_factor(threshold) * len_a * len_b / (len_a + len_b) - _EPS)


#: Log2 of the places of the name set's bitmap: 16 MB at most, whatever the lists hold.
SET_LOG2 = 27


def _place(norm: Column, log2: int = SET_LOG2) -> Column:
    return F.pmod(F.xxhash64(norm), F.lit(2 ** log2)) + 1


def name_set(listed: DataFrame) -> DataFrame:
    """(list_source, norm, bucket) of the distinct names of lists (name, list_source), by the bucket of their bitmap place."""
    named = listed.select("list_source", match_key(F.col("name")).alias("norm")).filter("norm IS NOT NULL")
    return named.distinct().withColumn("bucket", F.bitmap_bucket_number(_place(F.col("norm"))))


def set_bits(names: DataFrame) -> DataFrame:
    """(list_source, bucket, bits): which places of a bucket have a name. A row per source and bucket, 4 KB each."""
    return names.groupBy("list_source", "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position(_place(F.col("norm")))).alias("bits"))


def change_set(names: DataFrame, bits: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names and bitmaps after additions and removals (list_source, name, op: ADD or REMOVE; several of a name: the last by ``seq``).

    Bitmaps of buckets without a change stay as they are; only the names of changed buckets are read to make theirs anew.
    """
    last = changes.select("list_source", match_key(F.col("name")).alias("norm"), "op", "seq").filter("norm IS NOT NULL").groupBy("list_source", "norm").agg(
        F.max_by("op", "seq").alias("op")).withColumn("bucket", F.bitmap_bucket_number(_place(F.col("norm"))))
    stay = names.join(last, ["list_source", "norm"], "left_anti")
    now = stay.select("list_source", "norm", "bucket").unionByName(last.filter("op = 'ADD'").select("list_source", "norm", "bucket"))
    touched = last.select("list_source", "bucket").distinct()
    anew = set_bits(now.join(touched, ["list_source", "bucket"], "left_semi"))
    return now, bits.join(touched, ["list_source", "bucket"], "left_anti").unionByName(anew)


def merged_bits(bits: DataFrame) -> DataFrame:
    """(bucket, bits): the bitmaps of all sources in one."""
    return bits.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def set_members(probes: DataFrame, names: DataFrame, bits: DataFrame) -> DataFrame:
    """``probes`` (name, …) whose normalized name is in the set: first by a bit of the merged bitmap, then by the name itself."""
    norm = match_key(F.col("name"))
    placed = probes.withColumns({"norm": norm, "bucket": F.bitmap_bucket_number(_place(norm)), "__at": F.bitmap_bit_position(_place(norm))})
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(__at div 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    hit = placed.join(merged_bits(bits), "bucket").filter(byte.bitwiseAND(F.expr("CAST(shiftleft(1, CAST(__at % 8 AS INT)) AS INT)")) > 0)
    return hit.join(names.select("norm").distinct(), "norm", "left_semi").select(*probes.columns, "norm")
