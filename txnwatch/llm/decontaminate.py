"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question with other figures in it has the same
template. Windows of canonical words of documents and benchmark items are hash-joined; windows that meet are
compared word by word; and the values in their slots must correspond: one value of the item stands for one value of
the document throughout, and the other way round.

Names are capitalised words wherever they stand. Each window is compared twice, with names as placeholders and with
names as lower-case words, so that copies in another case match too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.common import materialize, release, row_key

#: Words of a template window.
WINDOW = 8
#: Plain words by which texts are looked through first.
SPAN = 3
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Adjacent windows that a document must hold, in the same order, if it holds a smaller share: 13 words in a row.
RUN = 6
#: Windows of a benchmark, or keys of documents, that are sent to all executors; more are joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Units of measure that may follow a number.
UNITS = ["mm", "cm", "km", "mg", "kg", "ml", "kwh", "mph", "inches", "inch", "feet", "foot", "yards", "miles", "mile",
         "meters", "metres", "grams", "pounds", "ounces", "liters", "litres", "gallons", "seconds", "minutes", "hours",
         "days", "weeks", "months", "years", "dollars", "euros", "cents", "percent"]
#: Private-use characters: no letter, digit or mark of any script.
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"
_NUMBER = r"[0-9][0-9.,:/]*"
#: White space behind a number, before a unit perhaps.
_GAP = rf"{NUMBER}[ \t\n\r]+"
#: A capitalised word, up to where :data:`_APART` ends it, so that names are as many words with placeholders as without.
_NAME = rf"(?<![A-Za-z]|[^\x00-\x7f])(?![{NUMBER}{NAME}{UNIT}])\p{{Lu}}(?:[A-Za-z]|[^\x00-\x7f])+"
_UNIT = rf"(?i)(?<={NUMBER} )(?:{'|'.join(UNITS)})(?![\p{{L}}0-9])"
#: Between words: ASCII without lower-case letters. Digits are placeholders by then.
_APART = r"[\x00-\x60\x7b-\x7f]+"


def _marked(text: Column, names: bool) -> Column:
    """The text with placeholders, in the case it had. Marks that stand in the text already are taken out."""
    plain = F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT, "   ")
    numbered = F.when(plain.rlike("[0-9]"), F.regexp_replace(F.regexp_replace(plain, _NUMBER, f" {NUMBER} "), _GAP, f"{NUMBER} ")).otherwise(plain)
    measured = F.when(numbered.contains(NUMBER), F.regexp_replace(numbered, _UNIT, UNIT)).otherwise(numbered)
    return F.regexp_replace(measured, _NAME, f" {NAME} ") if names else measured


def template_words(text: Column, names: bool = True) -> Column:
    """Canonical words: lower case, with placeholders for numbers, units and, if wanted, names."""
    return F.filter(F.split(F.lower(_marked(text, names)), _APART), lambda w: w != "")


def both_forms(text: Column) -> Column:
    """Structs (named, words): the canonical words with placeholders for names, and with names as words."""
    return F.array(*[F.struct(F.lit(named).alias("named"), template_words(text, named).alias("words")) for named in (True, False)])


def slot_values(text: Column) -> Column:
    """The values behind the placeholders, in the order of the text: numbers first, then names, then units."""
    plain = F.translate(F.coalesce(text, F.lit("")), NUMBER + NAME + UNIT, "   ")
    numbered = F.regexp_replace(F.regexp_replace(plain, _NUMBER, f" {NUMBER} "), _GAP, f"{NUMBER} ")
    return F.named_struct(
        F.lit("numbers"), F.transform(F.regexp_extract_all(plain, F.lit(f"({_NUMBER})"), 1), lambda v: F.rtrim(v, F.lit(".,:/"))),
        F.lit("names"), F.regexp_extract_all(F.regexp_replace(numbered, _UNIT, UNIT), F.lit(f"({_NAME})"), 1),
        F.lit("units"), F.regexp_extract_all(numbered, F.lit(f"({_UNIT})"), 1))


def _windows(words: Column, length: Column) -> Column:
    """Hashes of the windows of ``length`` words."""
    starts = F.when(F.size(words) >= length, F.sequence(F.lit(1), F.size(words) - length + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, length)))


def _plain(word: Column) -> Column:
    return ~word.isin(NUMBER, NAME, UNIT)


def _placed(hashes: Column, length: int) -> Column:
    return F.transform(hashes, lambda h, i: F.struct(F.lit(length).alias("length"), i.cast("int").alias("at"), h.alias("hash")))


def _slots(words: str, values: str, start: Column, length: Column) -> Column:
    """(kind, value) of the placeholders in a window."""
    def one(mark: str, field: str) -> Column:
        before = F.size(F.filter(F.slice(F.col(words), 1, start), lambda w: w == mark))
        inside = F.size(F.filter(F.slice(F.col(words), start + 1, length), lambda w: w == mark))
        return F.transform(F.slice(F.col(f"{values}.{field}"), before + 1, inside), lambda v: F.concat(F.lit(mark), F.lower(v)))
    every = F.concat(one(NUMBER, "numbers"), one(NAME, "names"), one(UNIT, "units"))
    return F.when(F.exists(F.slice(F.col(words), start + 1, length), lambda w: ~_plain(w)), every).otherwise(F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, window: int = WINDOW, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item, version, named, item_words, item_values, length, of, item_at, hash, anchors, long_run): the windows of all items.

    An item shorter than a window is one window. ``anchors`` are the hashes of all runs of three plain words in it, or
    of its single plain words where no three stand next to each other. A text that lacks one of them can't hold the
    window. Windows of placeholders alone say nothing and are left out.
    """
    whole = items.select(F.col(item_id).cast("long").alias("item"), F.col(text).alias("t")).where("item IS NOT NULL").distinct()
    ready = whole.select("item", F.xxhash64(template_words(F.col("t"), False)).alias("version"), F.explode(both_forms(F.col("t"))).alias("form"),
                         slot_values(F.col("t")).alias("item_values"))
    ready = ready.select("item", "version", F.col("form.named").alias("named"), F.col("form.words").alias("item_words"), "item_values").where("size(item_words) > 0")
    sized = ready.withColumn("length", F.least(F.lit(window), F.size("item_words")))
    every = sized.select("*", F.posexplode(_windows(F.col("item_words"), F.col("length"))).alias("item_at", "hash"))
    # without a name both forms of a window are the same
    every = every.where(~F.col("named") | F.array_contains(F.slice("item_words", F.col("item_at") + 1, F.col("length")), NAME))
    own = F.slice("item_words", F.col("item_at") + 1, F.col("length"))

    def runs(span: int) -> Column:
        def one(w: Column, i: Column) -> Column:
            run = [w, *(F.get(own, i + k) for k in range(1, span))]
            return F.when(reduce(Column.__and__, map(_plain, run)), F.xxhash64(*run))
        return F.array_distinct(F.array_compact(F.transform(own, one)))
    told = every.withColumn("long", runs(SPAN))
    told = told.withColumn("long_run", F.size("long") > 0).withColumn("anchors", F.when(F.col("long_run"), F.col("long")).otherwise(runs(1)))
    told = told.drop("long").where("size(anchors) > 0")
    count = told.groupBy("item", "version").agg(F.countDistinct("item_at").alias("of"))
    return told.join(count, ["item", "version"])


def _anchor_places(docs: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """(doc, anchor): the runs of three words, and the words, of ``docs`` that are candidates. Only keys and hashes move."""
    at = docs.select("doc", F.split(F.lower("text"), _APART).alias("words")).select("doc", "words", F.posexplode("words").alias("at", "word"))
    long = F.xxhash64("word", *(F.get("words", F.col("at") + k) for k in range(1, SPAN)))
    keyed = at.select("doc", long.alias("run"), F.xxhash64("word").alias("single"))
    own = candidates.select("anchor", "span")
    own = F.broadcast(own) if own.count() <= most else own
    runs, singles = own.where(F.col("span") == SPAN).select(F.col("anchor").alias("run"), F.lit(True).alias("is_run")), own.where("span = 1").select(
        F.col("anchor").alias("single"), F.lit(True).alias("is_single"))
    met = keyed.join(runs, "run", "left").join(singles, "single", "left").where("is_run OR is_single")
    both = F.array_compact(F.array(F.when(F.col("is_run"), F.col("run")), F.when(F.col("is_single"), F.col("single"))))
    return met.select("doc", F.explode(both).alias("anchor"))


def _needed(bench: DataFrame, coverage: float, run: int) -> DataFrame:
    """The windows by whose anchors documents are looked for.

    Windows without a run of three plain words have only words as anchors, which stand in many documents. They are
    left out where they can't make an item found by themselves: where fewer positions of the item have such a window
    than ``coverage`` asks for, and fewer than ``run`` of them are adjacent. A document in which such an item is found
    holds another window of it as well, and so another anchor.
    """
    weak = bench.where(~F.col("long_run")).select("item", "version", "item_at", "of").distinct()
    nth = F.row_number().over(Window.partitionBy("item", "version").orderBy("item_at"))
    rows = weak.withColumn("row", F.col("item_at") - nth).groupBy("item", "version", "row").agg(F.count(F.lit(1)).alias("n"), F.max("of").alias("of"))
    alone = rows.groupBy("item", "version").agg(F.sum("n").alias("all"), F.max("n").alias("longest"), F.max("of").alias("of"))
    alone = alone.where((F.col("all") >= coverage * F.col("of")) | (F.col("longest") >= run)).select("item", "version", F.lit(True).alias("alone"))
    return bench.join(alone, ["item", "version"], "left").where("long_run OR alone").drop("alone")


def _holding(docs: DataFrame, bench: DataFrame, coverage: float, run: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The distinct rows (doc, text) in which an item may be found, and the windows that some row may hold.

    Each window is looked for by the anchor that stands at the fewest places of all documents. What stands nowhere
    rules its windows out. One pass over the texts finds the places of all candidates, which are keys and hashes.
    """
    needed = materialize(_needed(bench, coverage, run).select("item", "version", "named", "item_at", "anchors", F.when(F.col("long_run"), SPAN).otherwise(1).alias("span")), "needed-windows")
    candidates = materialize(needed.select(F.explode("anchors").alias("anchor"), "span").distinct(), "anchor-candidates")
    places = materialize(_anchor_places(docs, candidates, most), "anchor-places")
    counts = places.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    window = ["item", "version", "named", "item_at"]
    each = needed.select(*window, F.explode("anchors").alias("anchor")).join(counts, "anchor", "left")
    rarest = each.groupBy(*window).agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "anchor")).alias("rarest"))
    rarest = materialize(rarest.select(*window, "rarest.anchor", F.col("rarest.n").alias("n")), "rarest-anchors")
    found = places.join(rarest.where("n > 0").select("anchor").distinct(), "anchor", "left_semi").select("doc").distinct()
    found = materialize(found, "anchored-keys")
    # keys of two numbers: sent to all executors up to a counted size
    keys = F.broadcast(found) if found.count() <= most else found
    held = materialize(docs.join(keys, "doc", "left_semi").dropDuplicates(["doc"]), "anchored-documents")
    possible = materialize(bench.join(rarest.where("n = 0"), window, "left_anti").drop("anchors", "long_run"), "possible-windows")
    release(needed, candidates, places, rarest, found)
    return held, possible


def _consistent(matches: DataFrame, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """The matches all of whose pairs agree with the mapping of their document and item, and the groups that had others."""
    votes = matches.select(*group, F.explode("pairs").alias("pair")).groupBy(*group, "pair").agg(F.count(F.lit(1)).alias("n"))
    votes = votes.select(*group, "pair.doc_value", "pair.item_value", "n")

    def first(side: str, other: str) -> Column:
        return F.row_number().over(Window.partitionBy(*group, side).orderBy(F.desc("n"), other))
    ranked = votes.withColumns({"of_item": first("item_value", "doc_value"), "of_doc": first("doc_value", "item_value")})
    stray = materialize(ranked.where("of_item > 1 OR of_doc > 1").select(
        F.struct(*group, F.struct("doc_value", "item_value").alias("pair")).alias("stray")), "stray-pairs")
    # a window is its places: pairs go to the few groups that have strays, and only these windows leave
    window = F.struct(*group, "item_at", "at", "length").alias("window")
    gone = matches.select(window, F.explode("pairs").alias("pair"), *group).withColumn("stray", F.struct(*group, "pair")).join(stray, "stray", "left_semi").select("window").distinct()
    kept = matches.withColumn("window", window).join(gone, "window", "left_anti").drop("window")
    return kept, stray.select(*(F.col(f"stray.{c}").alias(c) for c in group)).distinct()


def leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, text: str = "text", doc_id: str = "doc_id",
          broadcast_windows: int = BROADCAST_WINDOWS, run: int = RUN) -> DataFrame:
    """(doc, item_id, windows, of, coverage, first_word, last_word, reparameterised, consistent) of items that documents hold.

    ``windows`` of the item's ``of`` windows stand in the document with consistent slots, ``coverage`` is their share;
    ``reparameterised`` tells whether some slot has another value than in the item. A share below ``coverage`` counts
    too where ``run`` adjacent windows of the item stand next to each other in the document.

    Slots are consistent in two ways. Inside a window one value of the item stands for one value of the document and the
    other way round. Over all windows that a document and an item share, each value goes with the one that most windows
    pair it with (of equally many the smaller), in both directions; windows with another pair don't count, and
    ``consistent`` tells whether there were none.

    Null and empty texts and items hold nothing; repeated rows are reported once; an item with a null id takes no
    part; items that repeat under one id count as one item if their texts are the same, and each for itself otherwise.
    An item shorter than the window must stand in the document as a whole. Empty tables give an empty table.
    """
    every = materialize(benchmark_windows(items, window), "benchmark-windows")
    slim = docs.select(row_key(doc_id, text).alias("doc"), F.col(text).alias("text"))
    held, bench = _holding(slim, every, coverage, run, broadcast_windows)
    lengths = [r["length"] for r in bench.select("length").distinct().orderBy("length").collect()]  # no more than ``window``
    hashes = bench.select("hash", "length", "named").distinct()
    wanted = F.broadcast(hashes) if hashes.count() <= broadcast_windows else hashes
    # the one-element array keeps the words from being worked out again for every window
    words = held.select("doc", F.explode(both_forms(F.col("text"))).alias("form")).select("doc", "form.*")
    per_length = [_placed(_windows(F.col("words"), F.lit(n)), n) for n in lengths]
    if not per_length:
        per_length = [F.array().cast("array<struct<length:int,at:int,hash:bigint>>")]
    found = words.select("doc", "named", F.explode(F.concat(*per_length)).alias("w")).select("doc", "named", "w.*").join(wanted, ["hash", "length", "named"])
    places = materialize(found.groupBy("doc").agg(F.collect_set(F.struct("named", "length", "at", "hash")).alias("hits")), "window-places")
    back = held.join(places, "doc")
    told = F.transform(both_forms(F.col("text")), lambda form: F.struct(form["named"].alias("named"), form["words"].alias("words"), slot_values(F.col("text")).alias("values")))
    ready = back.select("doc", "hits", F.explode(told).alias("t"))
    ready = ready.select("doc", "t.words", "t.values", F.explode(F.filter("hits", lambda h: h["named"] == F.col("t.named"))).alias("h"))
    ready = ready.select("doc", "h.*", F.slice("words", F.col("h.at") + 1, F.col("h.length")).alias("own"),
                         _slots("words", "values", F.col("h.at"), F.col("h.length")).alias("slots"))
    met = ready.join(bench, ["hash", "length", "named"]).where(F.col("own") == F.slice("item_words", F.col("item_at") + 1, F.col("length")))
    met = met.withColumn("item_slots", _slots("item_words", "item_values", F.col("item_at"), F.col("length")))
    pairs = F.array_distinct(F.arrays_zip(F.col("slots").alias("doc_value"), F.col("item_slots").alias("item_value")))
    alike = (F.size(F.array_distinct("slots")) == F.size(pairs)) & (F.size(F.array_distinct("item_slots")) == F.size(pairs))
    met = met.withColumn("pairs", pairs).where((F.size("slots") == F.size("item_slots")) & alike)
    slim = met.select("doc", "item", "version", "item_at", "of", "at", "length", (F.col("slots") != F.col("item_slots")).alias("other"), "pairs")
    slim = materialize(slim, "window-matches")
    group = ["doc", "item", "version"]
    slim, strays = _consistent(slim, group)
    # windows in a row: neighbours in the item stand next to each other in the document
    line = slim.select(*group, (F.col("at") - F.col("item_at")).alias("shift"), "item_at").distinct()
    nth = F.row_number().over(Window.partitionBy(*group, "shift").orderBy("item_at"))
    rows = line.withColumn("row", F.col("item_at") - nth).groupBy(*group, "shift", "row").agg(F.count(F.lit(1)).alias("n"))
    longest = rows.groupBy(*group).agg(F.max("n").alias("longest"))
    per_item = slim.groupBy(*group).agg(
        F.countDistinct("item_at").alias("windows"), F.first("of").alias("of"), F.min("at").alias("first_word"),
        F.max(F.col("at") + F.col("length") - 1).alias("last_word"), F.max("other").alias("reparameterised")).alias("p")
    same = reduce(Column.__and__, (F.col(f"p.{c}").eqNullSafe(F.col(f"l.{c}")) for c in group))
    share = F.col("windows") / F.col("of")
    stray = reduce(Column.__and__, (F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in group))
    found = per_item.join(longest.alias("l"), same).where((share >= coverage) | (F.col("longest") >= run)).join(strays.alias("s"), stray, "left")
    return found.select(F.col("p.doc").alias("doc"), F.col("p.item").alias("item_id"), "windows", "of", share.alias("coverage"), "first_word", "last_word",
                        "reparameterised", F.col("s.doc").isNull().alias("consistent"))


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark item."""
    bad = leaks(docs, items, **options).select(F.col("doc").alias("_doc")).distinct()
    packed = docs.select(F.struct("*").alias("_row"), row_key().alias("_doc"))
    return packed.join(bad, "_doc", "left_anti").select("_row.*")
