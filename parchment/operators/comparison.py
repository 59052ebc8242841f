"""Comparison of texts: cosmetic changes, verdicts on edits, collapsed differences, and identifiers that are struck out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from parchment.functions import text as rules
from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()

#: Fixed values: (share of lines gone, share of length left, least lines gone) at which a removal is large.
ORDINARY, STRICT = (0.4, 0.55, 12), (0.15, 0.85, 5)


def cosmetic_text(text: Column) -> Column:
    """A text as it is compared for its wording: lines without emphasis, outline points and spare blanks; empty ones dropped."""

    def line(x: Column) -> Column:
        x = F.regexp_replace(F.trim(x), r"\*\*|__", "")
        x = F.regexp_replace(x, r"(?<!\w)[*_]([^*_\n]+)[*_](?!\w)", "$1")
        x = F.regexp_replace(x, r"^(\d+(?:\.\d+)+)\.(?=\s)", "$1")
        masthead = x.rlike(r"(?i)^(?:bylaws|constitution)\s+of\b") & (F.length(x) < 120) & ~x.rlike(r"[.!?;:]")
        return F.regexp_replace(F.when(masthead, F.lower(x)).otherwise(x), r"[\t ]+", " ")

    return F.array_join(F.filter(F.transform(F.split(text, r"\r?\n"), line), lambda x: x != ""), "\n")


def is_cosmetic(before: Column, after: Column) -> Column:
    base = cosmetic_text(before)
    return (base != "") & (base == cosmetic_text(after))


def with_line_counts(rows: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """``rows`` with lines added and removed; the comparison is sequential, so Arrow batches are handled a text at a time."""
    schema = StructType([*rows.schema.fields, StructField("added", IntegerType()), StructField("removed", IntegerType())])

    def run(batches):
        for frame in batches:
            got = [rules.line_diff(a or "", b or "") for a, b in zip(frame[before], frame[after], strict=True)]
            yield frame.assign(added=pd.array([g["added"] for g in got], "int32"), removed=pd.array([g["removed"] for g in got], "int32"))

    return rows.mapInPandas(run, schema)


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns of conversations as versions of a text, with the kind of document that they are."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "system", "guiding.rules").when(F.col("role") == "user", "bill.draft").otherwise("minutes.plenary")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return c.select("conv_id", "turn", kind.alias("kind"), F.coalesce(F.lag("text").over(w), F.lit("")).alias("before"), F.coalesce("text", F.lit("")).alias("after"))


def verdicts(changes: DataFrame) -> DataFrame:
    """``changes`` (kind, before, after) with verdict and large: rules are held unless only their looks changed, all else is
    published, and a large removal is flagged by the lines or the length that went."""
    rules_ = F.col("kind").startswith("guiding.")
    counted = with_line_counts(changes)
    verdict = F.when(F.trim("before") == "", "new").when(F.col("before") == F.col("after"), "unchanged").when(rules_ & is_cosmetic(F.col("before"), F.col("after")), "cosmetic").when(rules_, "hold").otherwise("publish")
    strict = F.col("kind").rlike(r"^(guiding\.|bill\.)")
    limit = lambda i: F.when(strict, STRICT[i]).otherwise(ORDINARY[i])
    lines, length = F.size(F.split("before", "\n")), F.length("before")
    measured = ~rules_ & ~F.col("kind").startswith("working.") & ~verdict.isin("new", "unchanged") & (F.col("removed") > 0) & (F.col("removed") >= limit(2))
    large = F.when(measured & (F.col("removed") / F.greatest(lines, F.lit(1)) >= limit(0)), "lines").when(measured & (F.length("after") / F.greatest(length, F.lit(1)) < limit(1)), "length").otherwise("")
    return counted.withColumn("verdict", verdict).withColumn("large", large)


@REGISTRY()
def change_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each change of a text: new, unchanged, cosmetic, held for review or published, and whether it removes much."""
    return verdicts(edits(spark, sf_dir)).select("conv_id", "turn", "verdict", "large", "added", "removed")


@REGISTRY()
def collapsed_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differences between neighbouring turns as rows: kept, added and removed lines, and how many unchanged ones are skipped."""

    def run(batches):
        for frame in batches:
            rows = [(c, t, k, op, n, "\n".join(lines)) for c, t, a, b in zip(frame["conv_id"], frame["turn"], frame["before"], frame["after"], strict=True) for k, (op, n, lines) in enumerate(rules.collapsed(rules.line_diff(a, b)["ops"]))]
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "place", "op", "n", "lines"])

    return edits(spark, sf_dir).where("before <> ''").select("conv_id", "turn", "before", "after").mapInPandas(run, "conv_id long, turn long, place int, op string, n int, lines string")


@REGISTRY()
def compare_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two first documents that begin with the same word, line by line: one aggregate finds the pairs, ids meet texts after."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.regexp_extract("text", r"^[^ \t\n\r\f]+", 0).alias("title")).where("title <> ''")
    first = d.groupBy("title").agg(F.min("doc_id").alias("a"))
    second = d.select("title", "doc_id").join(first, "title").where("doc_id > a").groupBy("title", "a").agg(F.min("doc_id").alias("b"))
    text = lambda k, name: d.select(F.col("doc_id").alias(k), F.col("text").alias(name))
    pairs = second.join(text("a", "before"), "a").join(text("b", "after"), "b")
    return with_line_counts(pairs.select("a", "b", "before", "after")).select("a", "b", "added", "removed")


#: What identifies a person or opens an account, and what stands for it; policies that only mention such things stay.
STRUCK = (
    (r"\b\d{3}[-‐-— ]\d{2}[-‐-— ]\d{4}\b", "[REDACTED: personal identifier]"),
    (r"(?i)((?:\b(?:email |instagram |twitter )?password)\s*[:=]\s*(?:\*\*)?)[^\r\n]+", "{1}[REDACTED: credential]"),
    (r"(?i)((?:\bSSN|\bSS#|\bbank account number|\brouting number)\s*(?:\*\*)?\s*:\s*(?:\*\*)?)[^\r\n]*\d[^\r\n]*", "{1}[REDACTED: financial identifier]"),
)


def struck(text: Column) -> Column:
    for pattern, by in STRUCK:
        text = F.regexp_replace(text, pattern, by.replace("{1}", "$1"))
    return text


def _struck_sql(column: str) -> str:
    for pattern, by in STRUCK:
        column = f"regexp_replace({column}, '{pattern}', '{by.replace('{1}', chr(92) + '1')}', 'g')"
    return column


_SEEDED = "case doc_id % 6 when 0 then 'SSN: 123-45-6789' || chr(10) || text when 1 then 'Email password = hunter2 x' || chr(10) || text when 2 then text || chr(10) || 'Routing number: **021000021 main' else text end"


@REGISTRY(f"select doc_id, md5({_struck_sql('t')}) as digest, contains({_struck_sql('t')}, '[REDACTED') as struck from (select doc_id, {_SEEDED} as t from documents where text is not null)")
def struck_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without personal numbers, passwords and accounts: three replacements in a row, inside the scan."""
    k, t = F.col("doc_id") % 6, F.col("text")
    seeded = F.when(k == 0, F.concat(F.lit("SSN: 123-45-6789\n"), t)).when(k == 1, F.concat(F.lit("Email password = hunter2 x\n"), t)).when(k == 2, F.concat(t, F.lit("\nRouting number: **021000021 main"))).otherwise(t)
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", struck(seeded).alias("t"))
    return d.select("doc_id", F.md5("t").alias("digest"), F.col("t").contains("[REDACTED").alias("struck"))


def renumbered(content: Column, kept: Column) -> Column:
    """``content`` with its [n] markers numbered by first use; markers that aren't among ``kept`` are dropped, and spacing is tidied."""
    marks = F.transform(F.regexp_extract_all(content, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.cast("int"))
    order = F.array_distinct(F.filter(marks, lambda m: F.array_contains(kept, m)))
    new = F.transform(marks, lambda m: F.when(F.array_contains(kept, m), F.concat(F.lit("["), F.array_position(order, m).cast("string"), F.lit("]"))).otherwise(""))
    parts = F.zip_with(F.split(content, r"\[\d+\]", -1), new, lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    out = F.regexp_replace(F.array_join(parts, ""), r"[ \t]{2,}", " ")
    return F.trim(F.regexp_replace(out, r" +([.,;:!?])", "$1"))


_CITED = "replace(replace(text, '[', ''), ']', '') || ' [' || (turn % 4 + 1) || '] and [7] so [2] [' || (conv_id % 5 + 1) || '] end [2] .'"


@REGISTRY(rf"""with c as (select conv_id, turn, {_CITED} as content, [1, 2, 3, 5] as kept from conversations where text is not null), m as (select *, list_transform(regexp_extract_all(content, '\[(\d+)\]', 1), lambda x: x::int) as marks, regexp_split_to_array(content, '\[\d+\]') as parts from c),
k as (select *, list_filter(marks, lambda x: list_contains(kept, x)) as good from m), o as (select *, list_transform(list_filter(list_transform(good, lambda x, i: struct_pack(x := x, i := i)), lambda e: list_position(good, e.x) = e.i), lambda e: e.x) as ord from k),
n as (select *, list_transform(marks, lambda x: case when list_contains(kept, x) then '[' || list_position(ord, x) || ']' else '' end) as named from o)
select conv_id, turn, trim(regexp_replace(regexp_replace(array_to_string(list_transform(parts, lambda p, i: p || coalesce(named[i], '')), ''), '[ \t]{{2,}}', ' ', 'g'), ' +([.,;:!?])', '\1', 'g')) as content, len(ord)::int as cited from n""")
def citations_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose citation markers are numbered by first use, those that can't be verified dropped: inside the row, no shuffle."""
    said = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    content = said(F.translate("text", "[]", ""), " [", F.col("turn") % 4 + 1, "] and [7] so [2] [", F.col("conv_id") % 5 + 1, "] end [2] .")
    kept = F.array(*map(F.lit, (1, 2, 3, 5)))
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", content.alias("content"))
    cited = F.size(F.array_distinct(F.filter(F.transform(F.regexp_extract_all("content", F.lit(r"\[(\d+)\]"), F.lit(1)), lambda m: m.cast("int")), lambda m: F.array_contains(kept, m))))
    return c.select("conv_id", "turn", renumbered(F.col("content"), kept).alias("content"), cited.alias("cited"))
