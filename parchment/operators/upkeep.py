"""Upkeep of derived rows: re-anchoring, pending work, openings, choices, bands and inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.functions.unicode import nfkc
from parchment.operators import extraction, retrieval
from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()
#: Phrases to look for, in the order in which they are reported.
PHRASES = ("that the", "of the", "worthless", "de la", "the and")


@REGISTRY("select doc_id, concat_ws(',', " + ", ".join(f"case when regexp_matches(lower(text), '(^|[^a-z])({p})([^a-z]|$)') then '{p}' end" for p in PHRASES) + ") as phrases from documents where text is not null")
def phrases_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases that each text holds at word bounds, in their fixed order."""
    low = F.lower("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat_ws(",", *[F.when(low.rlike(f"(^|[^a-z])({p})([^a-z]|$)"), p) for p in PHRASES]).alias("phrases"))


@REGISTRY("""with l as (select doc_id, string_split(text, chr(10)) as s from documents where text is not null), u as (select doc_id, unnest(range(len(s)))::int as ordinal, unnest(s) as content from l)
select doc_id, ordinal, content from u where ordinal < 3 and content <> ''""")
def opening_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three passages of each document; cut inside the row, before it is exploded."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.posexplode(F.slice(F.split("text", "\n", 4), 1, 3)).alias("ordinal", "content")).where("content <> ''")


@REGISTRY("""with k as (select *, row_number() over (partition by o_custkey, date_trunc('month', o_orderdate) order by case o_orderstatus when 'F' then 2 when 'O' then 1 else 0 end desc, o_totalprice desc, o_orderkey) as n from orders)
select o_custkey, o_orderkey, o_orderstatus from k where n = 1 order by o_orderdate desc, o_orderkey limit 50""")
def meeting_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record a meeting by preference, the newest fifty."""
    prefer = F.struct(F.when(F.col("o_orderstatus") == "F", -2).when(F.col("o_orderstatus") == "O", -1).otherwise(0), -F.col("o_totalprice"), "o_orderkey")
    best = table(spark, sf_dir, "orders").groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("m")).agg(F.min_by(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"), prefer).alias("x"))
    return best.orderBy(F.desc("x.o_orderdate"), "x.o_orderkey").limit(50).select("o_custkey", "x.o_orderkey", "x.o_orderstatus")


@REGISTRY("select l_orderkey, case when count(distinct l_shipdate) = 1 then strftime(min(l_shipdate), '%Y-%m-%d') end as agreed from lineitem group by 1")
def agreed_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date that all records state, or null."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("a"), F.max("l_shipdate").alias("b"))
    return g.select("l_orderkey", F.when(F.col("a") == F.col("b"), F.date_format("a", "yyyy-MM-dd")).alias("agreed"))


@REGISTRY("""with k as (select year(o_orderdate)::int as year, (row_number() over (partition by year(o_orderdate) order by o_orderkey) - 1) // 140 as chunk, o_orderkey from orders where o_orderpriority = '1-URGENT')
select year, chunk::int as chunk, count(*)::bigint as n, min(o_orderkey) as first_key from k group by all""")
def work_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work of each year cut into chunks of at most 140.

    Rows are numbered in stretches of keys, and a stretch begins where those before it end: one task never holds a year.
    """
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.year("o_orderdate").alias("year"), F.expr("o_orderkey div 4096").alias("stretch"), "o_orderkey")
    counts = o.groupBy("year", "stretch").agg(F.count("*").alias("rows"))
    begins = counts.select("year", "stretch", (F.sum("rows").over(Window.partitionBy("year").orderBy("stretch")) - F.col("rows")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("year", "stretch").orderBy("o_orderkey")) - 1
    return o.join(begins, ["year", "stretch"]).withColumn("chunk", (place / 140).cast("int")).groupBy("year", "chunk").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


#: A word of a text that is compared: letters and digits of any script, with apostrophes inside.
WORD = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"


def changed_words(snapshots: DataFrame, of: str, order: str, text: str) -> DataFrame:
    """(of, order, added): words that each text has beyond the one before it, as a multiset without case and markup.

    The first text of a key is a baseline, and a missing text breaks the chain: neither it nor the next one has a row.
    The words of both texts meet as ones and minus ones of a single sum, which combines before the shuffle.
    """
    before = F.lag("_plain").over(Window.partitionBy(of).orderBy(order))
    plain = F.lower(nfkc(extraction.plain(F.col(text))))
    both = snapshots.select(of, order, plain.alias("_plain")).withColumn("_before", before).where("_plain is not null and _before is not null")
    words = lambda c, sign: F.transform(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), lambda w: F.struct(w.alias("w"), F.lit(sign).alias("n")))
    rows = both.select(of, order, F.explode(F.concat(F.array(F.struct(F.lit("").alias("w"), F.lit(0).alias("n"))), words(F.col("_plain"), 1), words(F.col("_before"), -1))).alias("x"))
    return rows.groupBy(of, order, "x.w").agg(F.sum("x.n").alias("n")).groupBy(of, order).agg(F.sum(F.greatest("n", F.lit(0))).alias("added"))


CHANGED_SQL = f"""p as (select conv_id, turn, role, lower({extraction._strip_sql("text")}) as t from conversations), b as (select *, lag(t) over (partition by conv_id order by turn) as b from p),
w as (select conv_id, turn, '' as w, 0 as n from b where t is not null and b is not null union all select conv_id, turn, unnest(regexp_extract_all(t, '{WORD.replace(chr(39), chr(39) * 2)}')), 1 from b where b is not null
  union all select conv_id, turn, unnest(regexp_extract_all(b, '{WORD.replace(chr(39), chr(39) * 2)}')), -1 from b where t is not null),
a as (select conv_id, turn, sum(greatest(n, 0))::bigint as added from (select conv_id, turn, w, sum(n) as n from w group by all) group by all)"""


@REGISTRY(f"with {CHANGED_SQL} select conv_id, turn, added from a")
def added_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that each turn of a conversation has beyond the one before it."""
    return changed_words(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@REGISTRY(f"""with h as (select item_id, doc_id, b.text as q, d.text as t from benchmark b, documents d where {retrieval.FOUND_SQL.format(t='d.text', q='b.text')}),
n as (select *, case when strpos(t, chr(10)) > 0 then substr(t, strpos(t, chr(10)) + 1) else '' end as after from h), f as (select *, {retrieval.FOUND_SQL.format(t='after', q='q')} as found from n)
select item_id, doc_id, case when found then 'moved' else 'orphaned' end as status, not found as stale, case when found then (strpos(after, q) - 1)::bigint end as start_at from f""")
def reanchor_after_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where quotes stand after the first line of their text was cut; what cites an orphaned one is stale."""
    at = retrieval.held_quotes(spark, sf_dir)
    after = F.when(F.instr("text", "\n") > 0, F.expr("substring(text, instr(text, '\n') + 1)")).otherwise("")
    at = at.where(retrieval.found(F.col("text"), F.col("quote"))).select("item_id", "doc_id", "quote", after.alias("after"))
    found = retrieval.found(F.col("after"), F.col("quote"))
    return at.select("item_id", "doc_id", F.when(found, "moved").otherwise("orphaned").alias("status"), (~found).alias("stale"), F.when(found, (F.expr("instr(after, quote)") - 1).cast("long")).alias("start_at"))


@REGISTRY("""with b as (select min(o_orderdate) as lo, max(o_orderdate) as hi from orders), y as (select unnest(range(year(lo) - 1, year(hi) + 1))::int as y, lo, hi from b)
select y as session, y || '-06-01' as starts, (y + 1) || '-06-01' as ends from y where make_timestamp(y, 6, 1, 0, 0, 0) <= hi and make_timestamp(y + 1, 6, 1, 0, 0, 0) > lo""")
def session_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The June-to-June bands that meet the dates held."""
    b = table(spark, sf_dir, "orders").agg(F.to_date(F.min("o_orderdate")).alias("lo"), F.to_date(F.max("o_orderdate")).alias("hi"))
    y = b.select(F.explode(F.sequence(F.year("lo") - 1, F.year("hi"))).alias("session"), "lo", "hi")
    june = lambda c: F.make_date(c, F.lit(6), F.lit(1))
    hit = y.where((june(F.col("session")) <= F.col("hi")) & (june(F.col("session") + 1) > F.col("lo")))
    return hit.select("session", F.concat(F.col("session").cast("string"), F.lit("-06-01")).alias("starts"), F.concat((F.col("session") + 1).cast("string"), F.lit("-06-01")).alias("ends"))


@REGISTRY("""select '/about' as path union all select '/d/' || doc_id from documents union all select '/p/' || conv_id from (select conv_id from conversations where turn = 0 and role <> 'system' order by conv_id desc limit 100)""")
def sitemap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed paths, all documents, and the newest hundred visible posts."""
    path = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string")).alias("path")
    posts = table(spark, sf_dir, "conversations").where("turn = 0 and role <> 'system'").orderBy(F.desc("conv_id")).limit(100)
    return spark.range(1).select(F.lit("/about").alias("path")).unionByName(table(spark, sf_dir, "documents").select(path("/d/", "doc_id"))).unionByName(posts.select(path("/p/", "conv_id")))


_HELD = "select doc_id, md5(case when doc_id % 4 = 0 then text || '.' else text end) as h from documents where doc_id in (select doc_id from labels)"


@REGISTRY(f"select d.doc_id, case when held.h is null then 'new' else 'changed' end as why from documents d left join ({_HELD}) held using (doc_id) where md5(d.text) is distinct from held.h")
def pending_by_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose held fingerprint isn't that of their text, or that have none; digests are joined, not texts."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("now"), F.md5(F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("then"))
    held = d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "then")
    both = d.select("doc_id", "now").join(held, "doc_id", "left")
    return both.where(~F.col("now").eqNullSafe(F.col("then"))).select("doc_id", F.when(F.col("then").isNull(), "new").otherwise("changed").alias("why"))


@REGISTRY("select count(*)::bigint as rows_held, count(text)::bigint as with_text, count(*) filter (text = '')::bigint as empty_text, count(*) filter (lang = 'en')::bigint as english, min(doc_id) as first_id, max(doc_id) as last_id from documents")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by condition in one pass."""
    when = lambda c: F.count(F.when(F.expr(c), 1))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("rows_held"), F.count("text").alias("with_text"), when("text = ''").alias("empty_text"), when("lang = 'en'").alias("english"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))


@REGISTRY(r"""select p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_brand), '[0-9]+(st|nd|rd|th)?', '', 'g'), '[^a-z]+', ' ', 'g')) as lineage_key,
(case when p_size < 40 then 2000 + p_size else 1900 + p_size end)::int as expanded_year from part""")
def lineage_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without numbers and noise, and two-digit years read as 2000 to 2039 or 1940 to 1999."""
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.concat_ws(" ", "p_name", "p_brand")), "[0-9]+(st|nd|rd|th)?", ""), "[^a-z]+", " "))
    return table(spark, sf_dir, "part").select("p_partkey", key.alias("lineage_key"), F.when(F.col("p_size") < 40, 2000 + F.col("p_size")).otherwise(1900 + F.col("p_size")).cast("int").alias("expanded_year"))
