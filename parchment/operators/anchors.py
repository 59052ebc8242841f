"""Spans after their text changed: positions moved through an export's cleaning, quotes found again, and what cites lost ones."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchment.functions import cells
from parchment.functions import text as rules
from parchment.operators import retrieval
from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()


def sanitised(exports: DataFrame, key: str) -> DataFrame:
    """(key, content, offsets): exports (key, markdown, positions) cleaned, with their positions in the clean text."""

    def run(batches):
        for frame in batches:
            got = [(k, *rules.sanitised(m or "", [] if p is None else list(p))) for k, m, p in zip(frame[key], frame["markdown"], frame["positions"], strict=True)]
            yield pd.DataFrame(got, columns=[key, "content", "offsets"])

    return exports.select(key, "markdown", "positions").mapInPandas(run, f"{key} {dict(exports.dtypes)[key]}, content string, offsets array<int>")


def reanchored(annotations: DataFrame, texts: DataFrame) -> DataFrame:
    """``annotations`` (annotation_id, doc_id, quote, orphaned_at) with start_at, end_at and orphaned in the changed ``texts``
    (doc_id, text); annotations of other documents are not returned.

    A quote that stands there as it is, once or long enough, is found by a built-in search; only the others are looked for with
    their signs folded, in Arrow batches.
    """
    met = annotations.join(texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").withColumn("exact", retrieval.found(F.col("text"), F.col("quote")))
    at = (F.expr("instr(text, quote)") - 1).cast("int")
    held = met.where("exact").select("annotation_id", "doc_id", at.alias("start_at"), (at + F.length("quote")).alias("end_at"))
    kinds = dict(annotations.dtypes)

    def run(batches):
        for frame in batches:
            spans = [rules.find_quote(t, q or "") for t, q in zip(frame["text"], frame["quote"], strict=True)]
            start, end = ([None if s is None else s[k] for s in spans] for k in (0, 1))
            yield pd.DataFrame({"annotation_id": frame["annotation_id"], "doc_id": frame["doc_id"], "start_at": pd.array(start, "Int32"), "end_at": pd.array(end, "Int32")})

    rest = met.where("not coalesce(exact, false)").select("annotation_id", "doc_id", "quote", "text").mapInPandas(run, f"annotation_id {kinds['annotation_id']}, doc_id {kinds['doc_id']}, start_at int, end_at int")
    return held.unionByName(rest).withColumn("orphaned", F.col("start_at").isNull())


def gone_stale(orphans: DataFrame, citing: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(kind, owner_id, status) of everything that cites: fresh ones that cite an orphan (annotation_id) turn stale.

    ``citing`` has for each kind (section, summary, answer) its owners (owner_id, status) and their citations (owner_id,
    annotation_id); all kinds are read in one plan, and the orphans are asked once.
    """
    owners, citations = None, None
    for kind, (own, cites) in citing.items():
        own, cites = own.select(F.lit(kind).alias("kind"), "owner_id", "status"), cites.select(F.lit(kind).alias("kind"), "owner_id", "annotation_id")
        owners, citations = (own, cites) if owners is None else (owners.unionByName(own), citations.unionByName(cites))
    hit = citations.join(orphans.select("annotation_id").distinct(), "annotation_id", "left_semi").select("kind", "owner_id", F.lit(True).alias("hit")).distinct()
    status = F.when(F.col("hit") & (F.col("status") == "fresh"), "stale").otherwise(F.col("status"))
    return owners.join(hit, ["kind", "owner_id"], "left").select("kind", "owner_id", status.alias("status"))


def cells_restored(docs: DataFrame, key: str) -> DataFrame:
    """(key, content, n_breaks): texts (key, markdown, html) with the line breaks of their HTML export back in their tables' cells.

    A text without an export, or whose tables aren't found in it, stays as it is; a null text is empty.  An Arrow batch a time.
    """

    def run(batches):
        for frame in batches:
            got = [cells.restored(m or "", h or "") for m, h in zip(frame["markdown"], frame["html"], strict=True)]
            yield pd.DataFrame({key: frame[key], "content": [c for c, _ in got], "n_breaks": pd.array([len(p) for _, p in got], "int32")})

    return docs.select(key, "markdown", "html").mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, content string, n_breaks int")


# --- queries -------------------------------------------------------------------------------------------------------------


@REGISTRY()
def exports_sanitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts whose lines an export parted by pictures and blanks, cleaned, with the places at which the lines begin."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    mark = "  \n\n\n![a](b)\n"
    joined = F.array_join("lines", mark)
    begins = F.transform(F.sequence(F.lit(1), F.size("lines")), lambda k: F.aggregate(F.slice("lines", F.lit(1), k - 1), F.lit(0), lambda s, x: s + F.length(x) + len(mark)))
    got = sanitised(d.select("doc_id", joined.alias("markdown"), begins.alias("positions")), "doc_id")
    return got.select("doc_id", F.md5("content").alias("digest"), F.size("offsets").alias("places"), F.aggregate("offsets", F.lit(0).cast("long"), lambda s, x: s + x).alias("offset_sum"))


_HELD = f"""h as (select item_id, doc_id, lang, source, b.text as q, d.text as t from benchmark b, documents d where {retrieval.FOUND_SQL.format(t='d.text', q='b.text')}),
n as (select *, case when strpos(t, chr(10)) > 0 then substr(t, strpos(t, chr(10)) + 1) else '' end as after from h), f as (select *, {retrieval.FOUND_SQL.format(t='after', q='q')} as found from n)"""


@REGISTRY(f"""with {_HELD}, o as (select 'section' as kind, lang as owner_id, 'fresh' as status, found from f union all select 'summary', source, 'fresh', found from f union all select 'answer', item_id::varchar, case when item_id % 3 = 0 then 'failed' else 'fresh' end, found from f)
select kind, owner_id, case when status = 'fresh' and bool_or(not found) then 'stale' else status end as status from o group by kind, owner_id, status""")
def citations_gone_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of sections, summaries and answers that cite quoted items, once every text lost its first line."""
    at = retrieval.held_quotes(spark, sf_dir).where(retrieval.found(F.col("text"), F.col("quote")))
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    held = at.select(F.struct("item_id", "doc_id").alias("annotation_id"), "item_id", "doc_id", "quote").join(d.drop("text"), "doc_id")
    after = F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("")
    moved = exactly(held, d.select("doc_id", after.alias("text")))
    owner = lambda c, status="'fresh'": (held.select(c.alias("owner_id"), F.expr(status).alias("status")).distinct(), held.select(c.alias("owner_id"), "annotation_id"))
    return gone_stale(moved.where("orphaned"), {"section": owner(F.col("lang")), "summary": owner(F.col("source")), "answer": owner(F.col("item_id").cast("string"), "case when item_id % 3 = 0 then 'failed' else 'fresh' end")})


def exactly(annotations: DataFrame, texts: DataFrame) -> DataFrame:
    """As ``reanchored``, for quotes that must stand as they are."""
    met = annotations.join(texts, "doc_id")
    return met.select("annotation_id", (~F.coalesce(retrieval.found(F.col("text"), F.col("quote")), F.lit(False))).alias("orphaned"))


_SPECIAL = "[<>&|*_`#~\\\\\\[\\]]"


def tabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, markdown, html, lines): each text as the one cell of a table, on one line as markdown and in paragraphs as HTML."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    lines = F.filter(F.transform(F.split(F.regexp_replace("text", _SPECIAL, " "), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    d = d.select("doc_id", lines.alias("lines"))
    markdown = F.concat(F.lit("| a | b |\n| --- | --- |\n| x | "), F.array_join("lines", " "), F.lit(" |\nafter"))
    html = F.concat(F.lit("<p>before</p><table><tr><th>a</th><th>b</th></tr><tr><td>x</td><td>"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), ""), F.lit("</td></tr></table>"))
    return d.select("doc_id", "lines", markdown.alias("markdown"), html.alias("html"))


@REGISTRY()
def table_cells_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that an export put on one line of a table, with their lines back."""
    got = cells_restored(tabled(spark, sf_dir), "doc_id")
    return got.select("doc_id", "n_breaks", F.md5("content").alias("digest"))
