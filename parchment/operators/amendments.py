"""Replay of amendments: whether passed bills account for every change of a governing text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, StringType

from parchment.functions import amendments as rules
from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()

#: Bills, and characters of texts and of a bill, beyond which a change is left to a reader.
BILLS, TEXT_CHARS, BILL_CHARS = 12, 1_000_000, 180_000


@pandas_udf(StringType())
def normalised(text: pd.Series) -> pd.Series:
    return text.map(lambda t: t if t is None else rules.normalised(t))


def instrument(kind: Column) -> Column:
    return F.when(kind.isin("guiding.bylaws", "bill.bylaws_amendment"), "bylaws").when(kind.isin("guiding.constitution", "bill.constitution_amendment"), "constitution")


def stated_edits(bills: DataFrame) -> DataFrame:
    """(doc_id, bill_id, old, new, scope, operative, instruction) of each instruction of ``bills`` (doc_id, bill_id, kind, content)."""

    def run(batches):
        for frame in batches:
            rows = [(d, b, *e) for d, b, c, s in zip(frame["doc_id"], frame["bill_id"], frame["content"], frame["scope"], strict=True) for e in rules.read_edits(c or "", s)]
            yield pd.DataFrame(rows, columns=["doc_id", "bill_id", "old", "new", "scope", "operative", "instruction"])

    kinds = dict(bills.dtypes)
    return bills.select("doc_id", "bill_id", "content", instrument(F.col("kind")).alias("scope")).mapInPandas(run, f"doc_id {kinds['doc_id']}, bill_id {kinds['bill_id']}, old string, new string, scope string, operative boolean, instruction string")


def cleared(revisions: DataFrame, bills: DataFrame) -> DataFrame:
    """(doc_id, clear, reason, edits): revisions (doc_id, kind, before, after) whose every change passed bills (doc_id, bill_id,
    kind, content, passed) state.

    Instructions are found where they are said to stand: each quoted text must stand in the old text exactly once; those of
    one place must agree, and none may overlap.  They are applied from the start on, as a fold over the old text, and only a
    result that equals the whole new text is clear.  A revision meets its own bills alone, so one group holds at most ``BILLS``.
    """

    @pandas_udf(BooleanType())
    def delayed(content: pd.Series) -> pd.Series:
        return content.map(lambda c: rules.is_delayed(c or ""))

    before, after = F.coalesce("before", F.lit("")), F.coalesce("after", F.lit(""))
    r = revisions.select("doc_id", instrument(F.col("kind")).alias("target"), normalised(before).alias("b"), normalised(after).alias("a"), (F.length(before) + F.length(after)).alias("chars"))
    passed = bills.where("passed")
    known = passed.groupBy("doc_id").agg(F.count("*").alias("bills"), F.max(F.length("content")).alias("longest"), F.max(delayed("content")).alias("delayed"))
    small = passed.join(known.where((F.col("bills") <= BILLS) & (F.col("longest") <= BILL_CHARS)).select("doc_id"), "doc_id", "left_semi")
    edits = stated_edits(small).join(r.where(F.col("chars") <= TEXT_CHARS).select("doc_id", "target", "b"), "doc_id").where("operative and scope = target and contains(b, old)")
    start = F.expr("locate(old, b)")
    placed = edits.select("doc_id", "bill_id", "old", "new", "instruction", start.alias("start"), (F.expr("locate(old, b, locate(old, b) + 1)") > 0).alias("twice"))
    # one edit a place: the first by bill and wording, and whether another says something else
    one = placed.groupBy("doc_id", "start", F.length("old").alias("length")).agg(F.min("new").alias("new"), (F.min("new") != F.max("new")).alias("torn"), F.max("twice").alias("twice"), F.min(F.struct("bill_id", "instruction")).alias("by"))
    per = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "length", "new", "by"))).alias("edits"), F.max("torn").alias("torn"), F.max("twice").alias("twice"))
    state = F.aggregate("edits", F.struct(F.lit(1).alias("at"), F.lit("").alias("text"), F.lit(False).alias("overlap")), lambda s, e: F.struct(
        (e["start"] + e["length"]).alias("at"), F.concat(s["text"], F.substring(F.col("b"), s["at"], F.greatest(e["start"] - s["at"], F.lit(0))), e["new"]).alias("text"), (s["overlap"] | (e["start"] < s["at"])).alias("overlap")))
    x = r.join(known, "doc_id", "left").join(per, "doc_id", "left").withColumn("s", F.when(F.col("edits").isNotNull(), state))
    # blanks that an edit leaves behind don't count
    result = F.trim(F.regexp_replace(F.concat(F.col("s.text"), F.substring(F.col("b"), F.col("s.at"), F.length("b"))), r"\s+", " "))
    reason = F.when(F.col("target").isNull(), "no governing text").when((F.col("b") == "") | (F.col("a") == ""), "incomplete").when(F.col("chars") > TEXT_CHARS, "too long").when(F.col("b") == F.col("a"), "looks only").when(F.col("bills").isNull(), "no passed bill")
    reason = reason.when(F.col("bills") > BILLS, "too many bills").when(F.col("longest") > BILL_CHARS, "bill too long").when(F.col("delayed"), "delayed").when(F.col("edits").isNull(), "no instruction")
    reason = reason.when(F.col("twice"), "ambiguous").when(F.col("torn"), "conflicting").when(F.col("s.overlap"), "overlapping").when(result != F.col("a"), "not all changes").otherwise("exact")
    out = x.withColumn("reason", reason)
    return out.select("doc_id", (F.col("reason") == "exact").alias("clear"), "reason", F.when(F.col("reason") == "exact", F.transform("edits", lambda e: F.struct(e["by"]["bill_id"].alias("bill_id"), e["by"]["instruction"].alias("instruction")))).alias("edits"))


def _amended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Texts as governing ones, a bill each that quotes three of its words and others for them, and what became of the text."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    d = table(spark, sf_dir, "documents").where("text is not null and not text rlike '[\"“”‘’\\\\\\\\*_#~|<>=]'").select("doc_id", flat.alias("t"), F.split(flat, " ").alias("w")).where(F.size("w") >= 12)
    old, new = F.array_join(F.slice("w", 4, 5), " "), F.array_join(F.reverse(F.slice("w", 4, 5)), " ")
    d = d.select("doc_id", "t", "w", old.alias("old"), new.alias("new"))
    told = F.concat(F.lit("# Amendments to the Bylaws\n1. Replace the words \""), "old", F.lit("\" with \""), "new", F.lit("\".\n"))
    extra = F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("2. Strike \""), F.element_at("w", -1), F.lit("\"\n"))).otherwise("")
    after = F.concat(F.array_join(F.slice("w", 1, 3), " "), F.lit(" "), "new", F.lit(" "), F.expr("array_join(slice(w, 9, size(w)), ' ')"), F.when(F.col("doc_id") % 5 == 2, " and more").otherwise(""))
    revisions = d.select("doc_id", F.lit("guiding.bylaws").alias("kind"), F.col("t").alias("before"), after.alias("after"))
    return revisions, d.select("doc_id", F.col("doc_id").alias("bill_id"), F.lit("bill.bylaws_amendment").alias("kind"), F.concat(told, extra).alias("content"), (F.col("doc_id") % 7 != 0).alias("passed"))


@REGISTRY()
def amendments_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which changes of texts their bills account for, and why not the others."""
    return cleared(*_amended(spark, sf_dir)).select("doc_id", "clear", "reason")
