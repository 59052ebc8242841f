"""Document listings: filters, relevance, total orders, keyset pages, facets and work queues."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()
TERM = "anon"


@REGISTRY(f"""select d.doc_id from documents d where lower(coalesce(source, '')) like '%{TERM}%' or lower(coalesce(text, '')) like '%{TERM}%'
or exists (select 1 from labels l where l.doc_id = d.doc_id and l.toxic = 1)""")
def listing_substring_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substring of any of several columns, or a related row: the relation becomes a flag, so that it can be or-ed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    flagged = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct().withColumn("related", F.lit(True))
    here = F.lower("source").contains(TERM) | F.lower("text").contains(TERM)
    return d.select("doc_id", F.coalesce(here, F.lit(False)).alias("here")).join(flagged, "doc_id", "left").where("here or related").select("doc_id")


#: What the reader typed; its words are searched one by one as well.
QUERY = "the anon"


def find_rank(title: Column, blurb: Column, query: str) -> Column:
    """How well a listed row matches: the phrase in its title, else all words there; each word there; the phrase, or all words, in its blurb."""
    phrase = query.strip().lower()
    if not phrase:
        return F.lit(0)
    words, title, blurb = phrase.split(), F.lower(title), F.lower(blurb)
    every = lambda c: reduce(lambda a, b: a & b, [c.contains(w) for w in words])
    each = reduce(lambda a, b: a + b, [F.when(title.contains(w), 100).otherwise(0) for w in words])
    return F.when(title.contains(phrase), 10_000).when(every(title), 5_000).otherwise(0) + each + F.when(blurb.contains(phrase), 800).when(every(blurb), 400).otherwise(0)


_ALL = lambda c: " and ".join(f"contains(lower({c}), '{w}')" for w in QUERY.split())
_EACH = " + ".join(f"case when contains(lower(title), '{w}') then 100 else 0 end" for w in QUERY.split())


@REGISTRY(f"""with f as (select doc_id, split_part(text, chr(10), 1) as title, split_part(text, chr(10), 2) || chr(10) || split_part(text, chr(10), 3) as blurb from documents where text is not null)
select * from (select doc_id, (case when contains(lower(title), '{QUERY}') then 10000 when {_ALL('title')} then 5000 else 0 end + {_EACH} + case when contains(lower(blurb), '{QUERY}') then 800 when {_ALL('blurb')} then 400 else 0 end)::int as find_rank from f) where find_rank > 0""")
def listing_relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of a listing hit; rows that match only in their body have none."""
    lines = F.split("text", "\n", 4)
    line = lambda k: F.coalesce(F.get(lines, F.lit(k)), F.lit(""))
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", find_rank(line(0), F.concat(line(1), F.lit("\n"), line(2)), QUERY).cast("int").alias("find_rank")).where("find_rank > 0")


_DATED = "(select p_partkey, lower(p_name) as title, case when p_size % 5 = 0 then null else p_size end as dated, (p_partkey % 3)::int as rank from part)"


def _dated_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("title"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("dated"), (F.col("p_partkey") % 3).cast("int").alias("rank"))


ORDER = (F.desc, "rank"), (F.asc_nulls_last, "dated"), (F.asc, "title"), (F.asc, "p_partkey")


@REGISTRY(f"select p_partkey, rank, dated from {_DATED} order by rank desc, dated asc nulls last, title, p_partkey limit 500")
def listing_sort_total_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A total order: rank, then date with undated rows last, then title, then id."""
    return _dated_parts(spark, sf_dir).orderBy(*[f(c) for f, c in ORDER]).limit(500).select("p_partkey", "rank", "dated")


@REGISTRY(f"""with c as (select * from {_DATED} where p_partkey = 77), r as (select * from {_DATED})
select r.p_partkey, r.rank, r.dated from r, c where r.rank < c.rank or (r.rank = c.rank and (coalesce(r.dated, 2147483647) > coalesce(c.dated, 2147483647)
 or (coalesce(r.dated, 2147483647) = coalesce(c.dated, 2147483647) and (r.title > c.title or (r.title = c.title and r.p_partkey > c.p_partkey)))))
order by r.rank desc, r.dated asc nulls last, r.title, r.p_partkey limit 30""")
def listing_page_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page of thirty after a row, by comparing sort keys with the cursor row's: no row numbers over the whole table."""
    rows = _dated_parts(spark, sf_dir).withColumn("_key", F.struct(-F.col("rank"), F.coalesce("dated", F.lit(2**31 - 1)), "title", "p_partkey"))
    cursor = rows.where("p_partkey = 77").select(F.col("_key").alias("_after"))
    return rows.join(F.broadcast(cursor), F.col("_key") > F.col("_after")).orderBy("_key").limit(30).select("p_partkey", "rank", "dated")


@REGISTRY("select source, lang, case when lang = 'en' then 'primary' else 'translated' end as category, count(*)::bigint as n from documents where source is not null group by all")
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by source and language, folded into categories."""
    d = table(spark, sf_dir, "documents").where("source is not null")
    return d.groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("category", F.when(F.col("lang") == "en", "primary").otherwise("translated"))


@REGISTRY("select c_custkey, c_name, count(o_orderkey)::bigint as n from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'F' group by all")
def facet_people_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of every person, those without any included; counted before the join."""
    n = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return c.join(n, c.c_custkey == n.o_custkey, "left").select("c_custkey", "c_name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@REGISTRY("""with terms as (select o_custkey, o_orderdate as starts, case when o_orderstatus = 'O' then null else o_orderdate + interval 400 day end as ends from orders)
select n_name as office, count(distinct c_custkey)::bigint as holders from terms join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
where starts <= timestamp '1998-01-01' and (ends is null or ends > timestamp '1998-01-01') group by n_name""")
def facet_current_offices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People per office whose term holds at a date; an open end holds on."""
    at = F.lit("1998-01-01").cast("timestamp")
    terms = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").alias("starts"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate") + F.expr("interval 400 days")).alias("ends"))
    current = terms.where((F.col("starts") <= at) & (F.col("ends").isNull() | (F.col("ends") > at))).select("o_custkey").distinct()
    held = table(spark, sf_dir, "customer").join(current, F.col("c_custkey") == F.col("o_custkey"), "left_semi").groupBy("c_nationkey").agg(F.count("*").alias("holders"))
    return held.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("office"), "holders")


@REGISTRY("""select o_orderkey from orders where exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R' and l_quantity > 40 and l_discount > 0.05)
and exists (select 1 from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where c_custkey = o_custkey and r_name = 'ASIA')""")
def semi_join_composed_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One related row that meets all conditions, and a relation three tables deep; the right sides are filtered first."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 40 and l_discount > 0.05").select("l_orderkey")
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    people = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi").select("c_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(people, F.col("o_custkey") == F.col("c_custkey"), "left_semi").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey")


@REGISTRY("select doc_id from documents d where not exists (select 1 from labels l where l.doc_id = d.doc_id) and text <> ''")
def anti_join_unindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-empty documents without a derived row."""
    return table(spark, sf_dir, "documents").where("text <> ''").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


def pending(docs: DataFrame, done: DataFrame | None, after: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` that a pass still has to do: those with a text, without a row in ``done`` (null: all are done anew), beyond ``after``."""
    rest = docs.where(F.coalesce(F.col(text), F.lit("")) != "")
    if after is not None:
        rest = rest.where(F.col(key) > after)  # reaches the scan
    return rest if done is None else rest.join(done.select(key), key, "left_anti")


def resumed_pass(docs: DataFrame, done: Callable[[], DataFrame | None], work: Callable[[DataFrame], None], after: int | None = None, chunk: int = 10_000, until: Callable[[], bool] = lambda: False, key: str = "doc_id") -> tuple[int | None, bool]:
    """Hands what is pending to ``work`` in chunks by id; (the id to go on after, whether all is done).

    ``until`` is asked before each chunk and stops the pass.  The cursor goes by id, so a document that yields no row of
    ``done`` isn't handed out again and again.  The driver sees two ids a chunk; rows without an id can't be resumed after
    and are left out.
    """
    while True:
        if until():
            return after, False
        rest = pending(docs.where(F.col(key).isNotNull()), done(), after, key)
        last = rest.select(key).orderBy(key).limit(chunk).agg(F.max(key)).first()[0]
        if last is None:
            return after, True
        work(rest.where(F.col(key) <= last))
        after = last


@REGISTRY("select doc_id, length(text)::bigint as size from documents d where text <> '' and doc_id > (select max(doc_id) // 3 from labels) and not exists (select 1 from labels l where l.doc_id = d.doc_id)")
def documents_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass that stopped at a third of the labelled ids still has to do, when it is resumed after that id."""
    labels = table(spark, sf_dir, "labels")
    after = labels.agg(F.floor(F.max("doc_id") / 3)).first()[0]
    return pending(table(spark, sf_dir, "documents"), labels, after).select("doc_id", F.length("text").cast("long").alias("size"))


@REGISTRY("""select d.doc_id, case when l.doc_id is null then 'missing' when l.quality = 0 then 'stale' else 'fresh' end as status from documents d left join labels l on d.doc_id = l.doc_id
where l.doc_id is null or l.quality = 0 order by case when l.doc_id is null then 0 else 1 end, n_chars desc, source, d.doc_id limit 25""")
def queue_budget_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next rows to work on: missing before stale, longest first, within a budget of twenty-five."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")  # noqa: E741
    status = F.when(F.col("quality").isNull(), "missing").when(F.col("quality") == 0, "stale").otherwise("fresh")
    queue = d.join(l, "doc_id", "left").withColumn("status", status).where("status <> 'fresh'")
    return queue.orderBy(F.when(F.col("status") == "missing", 0).otherwise(1), F.desc("n_chars"), "source", "doc_id").limit(25).select("doc_id", "status")


@REGISTRY("""with lanes as (select event_id, event_type, ts, row_number() over (partition by event_type order by ts desc, event_id) as k from events)
select event_type, event_id, k::int as place from lanes where k <= 5""")
def lane_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five latest of each lane."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf_dir, "events").select("event_type", "event_id", F.row_number().over(w).alias("place")).where("place <= 5")


@REGISTRY("""with g as (select text, min(doc_id) as first_id, count(*)::bigint as copies from documents where text is not null group by text having count(*) > 1)
select sha256(g.text) as digest, first_id, copies, doc_id as member from g join documents d on g.text = d.text""")
def duplicate_content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the same bytes, a row each: the first is kept, the others are its aliases.  Only digests are shuffled."""
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.sha2("text", 256).alias("digest"), F.col("doc_id").alias("member"))
    g = d.groupBy("digest").agg(F.min("member").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")
    return d.join(g, "digest").select("digest", "first_id", "copies", "member")


@REGISTRY(f"""with h as (select distinct coalesce(source, '') as source, sha256(coalesce(text, '')) as h from documents), p as (select source, left(h, 1) as part, sha256(string_agg(h, chr(10) order by h)) as d from h group by all), n as (select coalesce(source, '') as source, count(*)::bigint as n from documents group by 1)
select p.source, sha256(string_agg(part || d, chr(10) order by part)) as fingerprint, any_value(n) as n from p join n using (source) group by 1""")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fingerprint of each set of texts: distinct digests are hashed in sixteen parts by their first digit, then the parts.

    A set is never in one row whole: a part holds a sixteenth of its distinct digests.
    """
    d = table(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("source"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    once = d.groupBy("source", "h").agg(F.count("*").alias("n"))
    parts = once.groupBy("source", F.substring("h", 1, 1).alias("part")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("d"), F.sum("n").alias("n"))
    return parts.groupBy("source").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("part", "d"))), "\n"), 256).alias("fingerprint"), F.sum("n").alias("n"))


@REGISTRY("select event_id, user_id from events where ts + interval 7 day >= timestamp '2024-01-20'")
def prune_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose time to live hasn't run out; the bound is moved to the column's side so that it reaches the scan."""
    return table(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-13").cast("timestamp")).select("event_id", "user_id")


@REGISTRY("""with o as (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders) select o_custkey, o_orderkey as first_order from o where k = 1""")
def first_row_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row under an order, as an aggregate with partial results rather than a sort."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))


_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


@REGISTRY("select doc_id, md5(" + " || '|' || ".join(f"coalesce(length({c}::varchar) || ':' || {c}::varchar, '')" for c in _COLUMNS) + ") as row_digest from documents")
def row_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each whole row, to verify a copy of the table: values with their lengths, so no two rows are written alike."""
    spelled = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("")) for c in _COLUMNS]
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat_ws("|", *spelled)).alias("row_digest"))
