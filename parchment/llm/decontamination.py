"""Benchmark decontamination by canonical templates.

Texts become sequences of tokens in which numbers, units after numbers, and names are typed placeholders, by whole-string
replacements.  A run of capitalised words is one name and a run of number words one number, so a replacement may have more
or fewer words than what it replaces ("Paris" and "New York", "5 km" and "five kilometres").  Function words are no names.

Windows of ``WINDOW`` tokens of the benchmark are joined by hash with those of every document, so a question whose numbers
and names were changed still matches.  For one alignment of an item with a document, each slot value of the item must
stand for one value throughout; where it doesn't, the match is chance and is dropped.  The item's first and last token are
spared, as the words around a copy can join a run with them.  Windows of fewer than ``LITERALS`` literal tokens tell too
little and count only where their values are the item's own.  Items of fewer than ``LEAST`` + 2 windows, which the words
around them could hide, are searched by their plain tokens instead of those.  A document is contaminated if an alignment matches
``LEAST`` windows (13 tokens), or all of the item's where it has fewer, or all telling windows of an item with fewer than
``LEAST`` of them.  So a verbatim copy is always found.

Everything is DataFrame expressions.  A scan of the documents meets the hashes of the benchmark's windows, eight bytes
each; they are broadcast only while they number at most ``BROADCAST_WINDOWS``, and beyond that both sides are shuffled by
hash.  Only documents with a hit are looked at again.  What is collected per document are places in it, so it is bounded by
its length, however many items share a window.

Defined cases: null or empty texts and items have no windows; a null item_id is searched and shown as no id; items that
share an id are searched each; a null doc_id is left out of ``report`` and judged by its own text in ``clean``; rows that
share a doc_id are judged together; repeated items count once; other columns are ignored; an empty benchmark leaves all
documents clean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _common as C

WINDOW = 8
LEAST = 6
LITERALS = 4
BROADCAST_WINDOWS = 500_000  #: eight bytes each
BROADCAST_BYTES = 16 << 20  #: of the benchmark's window tokens, which meet the hits
#: Unit words, which are placeholders only after a number.
UNITS = (
    "percent pct mm millimetre millimetres millimeter millimeters cm centimetre centimetres centimeter centimeters m metre metres meter meters km kilometre kilometres "
    "kilometer kilometers inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces "
    "ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur hz khz mhz w kw kwh v kb mb gb tb mph kmh degrees"
).split()
#: Number words.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
).split()
#: Words that are no names though sentences begin with them.
STARTERS = (
    "A An The This That These Those If When While Where What Which Who Whose Whom Why How Is Are Was Were Do Does Did Has Have Had Can Could Will Would Should May Might Must "
    "There Here It Its He She They We You I His Her Their Our Your My In On At By For From Of To With Without After Before Under Over Between During Into And Or But Not No So As Then "
    "Each Every All Some Any Both Given Give Let Find Add Name Write Solve Compute Calculate Suppose Choose Explain Describe Show Prove State List Determine Consider"
).split()
#: Each placeholder is this private-use character and a letter: n number, u unit, a name.
_MARK = "\ue000"
_BIG = rf"(?=\p{{Lu}})(?!(?:{'|'.join(STARTERS)})(?!\p{{L}}))\p{{Lu}}\p{{L}}*"
# Repeated groups are possessive: Java's regex goes a stack frame deeper with each turn of any other, and a run has no longest length.
_NAME = rf"(?=\p{{Lu}})(?<![\p{{L}}\p{{N}}]){_BIG}(?: {_BIG})*+"
_LOW = rf"(?:{'|'.join(NUMBERS)})(?!\p{{L}})"
_DIGITS = r"[0-9]+(?:[.,][0-9]+)*+"
_NUMBER = rf"{_DIGITS}(?: (?:hundred|thousand|million|billion)(?!\p{{L}}))*+|(?=[zotfsenhmb])(?<!\p{{L}}){_LOW}(?:(?:[ -]|(?<=hundred|thousand) and ){_LOW})*+"
#: Each replaces one value by one placeholder, in this order.
_PLACEHOLDERS = (
    (_NAME, _MARK + "a"),
    (_NUMBER, _MARK + "n"),
    (rf"(?<={_MARK}n ?)(?i:{'|'.join(UNITS)})(?!\p{{L}})", _MARK + "u"),
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once; a column named in a lambda may be computed anew for every element."""
    return F.transform(F.array(value), body)[0]


def _plain(text: Column) -> Column:
    # the one letter whose lower case is two characters would shift places
    return F.translate(text, _MARK + "\u0130", " I")


def template(text: Column) -> Column:
    """The template tokens of a text: lower-case words and placeholders.

    Whole-string expressions do the work; no lambda runs over tokens.
    """
    out = _plain(text)
    for pattern, mark in _PLACEHOLDERS:
        out = F.regexp_replace(out, pattern, mark)
    return F.regexp_extract_all(F.lower(out), F.lit(rf"{_MARK}[nua]|\p{{L}}+"), F.lit(0))


def values(text: Column) -> Column:
    """What stands at each template token's place, in lower case: as many as ``template`` has."""
    return F.transform(F.regexp_extract_all(_plain(text), F.lit(rf"{_NAME}|{_NUMBER}|\p{{L}}+"), F.lit(0)), F.lower)


def words(text: Column) -> Column:
    """Plain tokens in lower case."""
    return F.regexp_extract_all(F.lower(_plain(text)), F.lit(rf"{_DIGITS}|\p{{L}}+"), F.lit(0))


def _slices(tokens: str | Column, size: Column | int) -> Column:
    return F.when(F.size(tokens) > 0, F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1), lambda i: F.slice(tokens, i, size)))


def item_windows(benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, item: str = "item_id", text: str = "text") -> DataFrame:
    """(of, size, h, item, own, ipos, last, need, need_telling, telling, win, val): the windows that are searched; ``of`` is tpl or raw."""
    items = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(text).alias("_t")).distinct()
    items = items.select("item", F.xxhash64("_t").alias("own"), template(F.col("_t")).alias("tpl"), values(F.col("_t")).alias("val"), words(F.col("_t")).alias("raw")).where(F.size("raw") > 0)
    size = lambda c: F.least(F.size(c), F.lit(window))
    items = items.withColumn("tsize", size("tpl")).withColumn("rsize", size("raw")).withColumn("tw", _slices("tpl", F.col("tsize"))).withColumn("rw", _slices("raw", F.col("rsize")))
    telling = lambda w: F.size(F.filter(w, lambda t: ~t.startswith(_MARK))) >= LITERALS
    n = lambda c: F.least(c, F.lit(least)).cast("int")
    tpl = items.select("item", "own", F.lit("tpl").alias("of"), F.col("tsize").alias("size"), F.size("tpl").alias("last"), n(F.size("tw")).alias("need"), n(F.size(F.filter("tw", telling))).alias("need_telling"), F.size("tw").alias("n_windows"), "val", F.posexplode("tw").alias("p", "win"))
    raw = items.where(F.size("tw") < least + 2).select("item", "own", F.lit("raw").alias("of"), F.col("rsize").alias("size"), F.size("raw").alias("last"), n(F.size("rw")).alias("need"), F.lit(0).alias("need_telling"), F.col("raw").alias("val"), F.posexplode("rw").alias("p", "win"))
    ipos = F.col("p") + 1
    some = tpl.withColumn("telling", telling(F.col("win"))).where(F.col("telling") | (F.col("n_windows") >= least + 2)).drop("n_windows").unionByName(raw.withColumn("telling", F.lit(False)))
    return some.select("of", "size", F.xxhash64("win").alias("h"), "item", "own", ipos.alias("ipos"), "last", "need", "need_telling", "telling", "win", F.slice("val", ipos, F.col("size")).alias("val"))


def _places(rows: DataFrame, size: int, of: str, *keep: str) -> DataFrame:
    """(keep, pos from 1, h) of each window of ``size`` tokens of ``of``."""
    # an outer explode of one expression: a filter on it, written or inferred, would compute the template twice
    hashes = _let(F.col(of), lambda x: F.when(F.size(x) >= size, F.transform(F.sequence(F.lit(1), F.size(x) - size + 1), lambda i: F.xxhash64(F.slice(x, i, size)))))
    return rows.select(*keep, F.posexplode_outer(hashes).alias("_p", "h")).select(*keep, (F.col("_p") + 1).alias("pos"), "h")


def row_key(key: str = "doc_id", text: str = "text") -> Column:
    """The id as text; of a row without one, the hash of its text."""
    return F.when(F.col(key).isNull(), F.concat(F.lit("t"), F.xxhash64(text).cast("string"))).otherwise(F.col(key).cast("long").cast("string"))


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least: int = LEAST, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row_key, item, n_windows) of the consistent alignments that contaminate; one row a document and item."""
    wanted = C.written(item_windows(benchmark, window, least, item, item_text))
    kinds = wanted.groupBy("of", "size").agg(F.countDistinct("h").alias("n"), F.sum(F.length(F.array_join("win", " ")) + F.length(F.array_join("val", " "))).alias("chars")).collect()  # two for each size up to ``window``
    texts = docs.where(F.col(text).isNotNull()).select(row_key(key, text).alias("row_key"), F.col(text).alias("_text"))
    make = {"tpl": template, "raw": words}
    parts = []
    for of, size, n, _ in sorted(kinds):
        hashes = wanted.where((F.col("of") == of) & (F.col("size") == size)).select("h").distinct()
        tokens = texts.select("row_key", "_text", make[of](F.col("_text")).alias(of))
        hit = F.struct(F.lit(of).alias("of"), F.lit(size).alias("size"), "pos").alias("hit")
        if n <= BROADCAST_WINDOWS:
            parts.append(_places(tokens, size, of, "row_key", "_text").join(F.broadcast(hashes), "h", "left_semi").select("row_key", "_text", hit))
        else:
            parts.append(_places(tokens, size, of, "row_key").join(hashes, "h", "left_semi").select("row_key", hit).join(texts, "row_key").select("row_key", "_text", "hit"))
    if not parts:
        return docs.sparkSession.createDataFrame([], "row_key string, item long, n_windows long")
    # only documents with a hit go on, each with its text once; their tokens are made before the hits are parted again
    hits = reduce(DataFrame.unionByName, parts).groupBy("row_key", "_text").agg(F.collect_list("hit").alias("hits"))
    hits = hits.select("row_key", template(F.col("_text")).alias("tpl"), values(F.col("_text")).alias("val"), words(F.col("_text")).alias("raw"), "hits").select("row_key", "tpl", "val", "raw", F.explode("hits").alias("hit"))
    at = lambda c: F.slice(c, F.col("hit.pos"), F.col("hit.size"))
    is_tpl = F.col("hit.of") == "tpl"
    hits = hits.select("row_key", "hit.of", "hit.size", "hit.pos", F.when(is_tpl, at("tpl")).otherwise(at("raw")).alias("win"), F.when(is_tpl, at("val")).otherwise(at("raw")).alias("dval"))
    own = wanted.withColumnRenamed("win", "iwin")
    if sum(k["chars"] for k in kinds) <= BROADCAST_BYTES:
        own = F.broadcast(own)
    found = hits.withColumn("h", F.xxhash64("win")).join(own, ["of", "size", "h"]).where("win = iwin")
    places = F.arrays_zip("win", "val", "dval", F.transform("win", lambda _, i: F.col("ipos") + i).alias("place"))
    inner = lambda z: (z["place"] > 1) & (z["place"] < F.col("last"))
    found = found.withColumn("places", F.filter(places, lambda z: inner(z) & z["win"].startswith(_MARK))).where(F.col("telling") | F.forall("places", lambda z: z["val"] == z["dval"]))
    slots = F.transform("places", lambda z: F.struct(z["val"].alias("i"), z["dval"].alias("d")))
    aligned = found.select("row_key", "item", "own", "of", "need", "need_telling", "telling", "ipos", (F.col("pos") - F.col("ipos")).alias("shift"), slots.alias("slots")).groupBy("row_key", "item", "own", "of", "need", "need_telling", "shift").agg(
        F.size(F.collect_set("ipos")).alias("n"), F.size(F.collect_set(F.when(F.col("telling"), F.col("ipos")))).alias("n_telling"), F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    sound = F.size("slots") == F.size(F.array_distinct(F.transform("slots", lambda s: s["i"])))
    enough = (F.col("n") >= F.col("need")) | ((F.col("need_telling") > 0) & (F.col("n_telling") >= F.col("need_telling")))
    return aligned.where(sound & enough).groupBy("row_key", "item").agg(F.max("n").cast("long").alias("n_windows"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_items, item_ids) of the contaminated documents; item_ids ascend, joined by commas."""
    found = matches(docs, benchmark).where(~F.col("row_key").startswith("t")).groupBy(F.col("row_key").cast("long").alias("doc_id")).agg(F.array_sort(F.collect_set("item")).alias("items"), F.count("*").alias("n_items"))
    return found.select("doc_id", F.lit(True).alias("contaminated"), "n_items", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("item_ids"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that match no item."""
    gone = matches(docs, benchmark).select(F.col("row_key").alias("_parchment_row")).distinct()
    return docs.withColumn("_parchment_row", row_key()).join(gone, "_parchment_row", "left_anti").select(*docs.columns)
