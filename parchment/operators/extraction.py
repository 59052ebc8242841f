"""Rows out of text: passages, links, plain text, articles, citations and diffs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.functions import text as rules
from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()


def split(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, heading, content, start_at, end_at): passages of texts (doc_id, text), an Arrow batch a time."""

    def run(batches):
        for frame in batches:
            rows = [(d, *p) for d, t in zip(frame["doc_id"], frame["text"], strict=True) for p in rules.split_passages(t or "")]
            yield pd.DataFrame(rows, columns=["doc_id", "ordinal", "heading", "content", "start_at", "end_at"])

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ordinal int, heading string, content string, start_at int, end_at int")


@REGISTRY()
def passages_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every document with their heading trail and place."""
    return split(table(spark, sf_dir, "documents"))


_HREF = 'href="([^"]*)"'


def links(pages: DataFrame) -> DataFrame:
    """(page_id, target, ordinal): links in reading order, each target once."""
    return pages.select("page_id", F.posexplode(F.array_distinct(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1)))).alias("ordinal", "target"))


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that some document answers: its first word."""
    word = F.regexp_extract("text", r"^[^ \t\n\r\f]+", 0)
    return table(spark, sf_dir, "documents").where("text is not null").groupBy(word.alias("w")).agg(F.min("doc_id").alias("to_id")).where("w <> ''")


_LINK_SQL = f"""x as (select page_id, regexp_extract_all(html, '{_HREF}', 1) as l from pages), u as (select page_id, unnest(l) as target, unnest(range(len(l))) as i from x),
f as (select page_id, target, min(i) as i from u group by all), h as (select regexp_extract(text, '^[^ \\t\\n\\r\\f]+') as w, min(doc_id) as to_id from documents where text is not null group by 1 having w <> '')"""


@REGISTRY(f"with {_LINK_SQL} select page_id, to_id, (row_number() over (partition by page_id order by i) - 1)::int as ordinal from f join h on ltrim(target, '/') = w")
def links_resolved_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links whose target is known; ordinals count the resolved ones only."""
    e = links(table(spark, sf_dir, "pages")).withColumn("w", F.expr("ltrim('/', target)"))
    hit = e.join(_heads(spark, sf_dir), "w")
    return hit.select("page_id", "to_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("ordinal")) - 1).alias("ordinal"))


@REGISTRY(f"with {_LINK_SQL} select target, count(*)::bigint as pages from f anti join h on ltrim(target, '/') = w group by 1")
def links_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that nothing answers, with the pages that name them."""
    e = links(table(spark, sf_dir, "pages")).withColumn("w", F.expr("ltrim('/', target)"))
    return e.join(_heads(spark, sf_dir), "w", "left_anti").groupBy("target").agg(F.count("*").alias("pages"))


#: Patterns and what replaces them, in this order.
STRIP = (
    (r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"<[^>]*>", " "),
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&amp;", "&"),
    (r"[ \t\n\r\f]+", " "),
)


def plain(html: Column) -> Column:
    for pattern, by in STRIP:
        html = F.regexp_replace(html, pattern, by)
    return F.trim(html)


def _strip_sql(column: str) -> str:
    for pattern, by in STRIP:
        column = f"regexp_replace({column}, '{pattern}', '{by}', 'g')"
    return f"trim({column})"


@REGISTRY(f"select page_id, {_strip_sql('html')} as content from pages")
def plain_text_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as plain text, by built-in replacements in a fixed order."""
    return table(spark, sf_dir, "pages").select("page_id", plain(F.col("html")).alias("content"))


@REGISTRY(f"""select page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) as host, {_strip_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)")} as title, {_strip_sql("regexp_extract(html, '(?s)<article>(.*)</article>', 1)")} as body from pages""")
def html_article_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, title and article text of each page."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), plain(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("title"), plain(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1)).alias("body"))


@REGISTRY()
def diff_line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines added and removed between neighbouring turns of a conversation."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("before")).where("before is not null")

    def run(batches):
        for frame in batches:
            got = [rules.line_diff(a, b or "") for a, b in zip(frame["before"], frame["text"], strict=True)]
            yield pd.DataFrame({"conv_id": frame["conv_id"], "turn": frame["turn"], "added": [g["added"] for g in got], "removed": [g["removed"] for g in got]})

    return c.mapInPandas(run, "conv_id long, turn long, added int, removed int")


#: Rules in order; the first that fits names the kind.
KINDS = ((r"license|licensed under", "licence"), (r"password|secret|token", "credential"), (r" [|] ", "table"), (r"!!", "notice"))


_KIND_SQL = " ".join(f"when regexp_matches(lower(text), '{p}') then '{k}'" for p, k in KINDS)


@REGISTRY(f"select doc_id, case {_KIND_SQL} else 'unknown' end as kind from documents where text is not null")
def classify_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kind of each document by an ordered list of rules."""
    low, kind = F.lower("text"), None
    for pattern, name in KINDS:
        hit = low.rlike(pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", kind.otherwise("unknown").alias("kind"))


@REGISTRY(r"""with m as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9._]+@[a-z0-9.]+[a-z]')) as mail from documents where text is not null) select doc_id, mail, count(*)::bigint as n from m group by all""")
def extract_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses of each document, case folded, with how often they occur."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9._]+@[a-z0-9.]+[a-z]"), F.lit(0))).alias("mail")).groupBy("doc_id", "mail").agg(F.count("*").alias("n"))
