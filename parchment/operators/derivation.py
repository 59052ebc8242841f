"""Derived facts about documents: targets to fetch, validity, weights, excerpts, states and dates by precedence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.operators import extraction
from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()


@REGISTRY(f"""with l as (select page_id, unnest(regexp_extract_all(html, '{extraction._HREF}', 1)) as target from pages), held as (select distinct '/' || lower(regexp_extract(text, '^[a-zA-Z]+')) as t from documents where text is not null)
select target, min(page_id) as first_page from l where lower(target) not in (select t from held) group by target""")
def linked_targets_unheld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked targets that aren't held, with the earliest page that names each."""
    held = table(spark, sf_dir, "documents").where("text is not null").select(F.concat(F.lit("/"), F.lower(F.regexp_extract("text", "^[a-zA-Z]+", 0))).alias("t")).distinct()
    l = extraction.links(table(spark, sf_dir, "pages"))  # noqa: E741
    first = l.groupBy("target").agg(F.min("page_id").alias("first_page"))
    return first.withColumn("t", F.lower("target")).join(held, "t", "left_anti").select("target", "first_page")


@REGISTRY("select doc_id, case when doc_id in (select l_orderkey from lineitem where l_quantity > 49) then 2 else quality end::int as quality from labels")
def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column set anew where the key is in a list that comes from another table."""
    keys = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("doc_id")).distinct().withColumn("hit", F.lit(True))
    return table(spark, sf_dir, "labels").join(keys, "doc_id", "left").select("doc_id", F.when(F.col("hit"), 2).otherwise(F.col("quality")).cast("int").alias("quality"))


@REGISTRY("select event_id, strftime(timezone('America/New_York', timezone('UTC', ts)), '%Y-%m-%d') as local_day, timezone('America/New_York', timezone('UTC', ts))::date <= date '2024-01-15' as occurred from events")
def has_occurred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calendar day of each event where the archive is, and whether it had come by a day."""
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts").cast("timestamp_ntz"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(local, "yyyy-MM-dd").alias("local_day"), (F.to_date(local) <= F.lit("2024-01-15").cast("date")).alias("occurred"))


@REGISTRY("""with spans as (select l_orderkey, min(l_shipdate)::date as a, max(l_shipdate)::date as b from lineitem group by 1), forms as (select o_orderkey, o_orderdate::date - 400 as lo, case when o_orderstatus = 'O' then null else o_orderdate::date + 900 end as hi from orders)
select l_orderkey, a >= lo and (hi is null or b <= hi) as usable from spans join forms on l_orderkey = o_orderkey""")
def span_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a form's validity holds a document's whole span; both days count, an open end holds on."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b"))
    d = F.to_date("o_orderdate")
    f = table(spark, sf_dir, "orders").select("o_orderkey", F.date_sub(d, 400).alias("lo"), F.when(F.col("o_orderstatus") != "O", F.date_add(d, 900)).alias("hi"))
    return s.join(f, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", ((F.col("a") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("b") <= F.col("hi")))).alias("usable"))


@REGISTRY("select doc_id from documents where length(trim(text)) >= 400 and not regexp_matches(text, '(?i)template|licensed under')")
def summarisable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts long enough to summarise that aren't templates."""
    d = table(spark, sf_dir, "documents")
    return d.where((F.length(F.trim("text")) >= 400) & ~F.col("text").rlike("(?i)template|licensed under")).select("doc_id")


@REGISTRY("""with cut as (select user_id, max(ts) as until from events where event_type = 'purchase' group by 1)
select e.event_id from events e left join cut c on e.user_id = c.user_id where e.event_type = 'view' and (c.until is null or e.ts <= c.until)""")
def publication_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions up to what was last published for their key; all of them where nothing was."""
    e = table(spark, sf_dir, "events")
    cut = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("until"))
    return e.where("event_type = 'view'").join(cut, "user_id", "left").where("until is null or ts <= until").select("event_id")


@REGISTRY("""with t as (select doc_id, lower(regexp_replace(split_part(text, chr(10), 1), '[^a-zA-Z]+', ' ', 'g')) as k from documents where text is not null), n as (select k from t group by k having count(*) = 1)
select t.doc_id, t.k as title from t join n on t.k = n.k where length(t.k) > 5""")
def unique_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical titles that no other document has: one aggregate, no self-join."""
    k = F.lower(F.regexp_replace(F.split("text", "\n", 2)[0], "[^a-zA-Z]+", " "))
    t = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", k.alias("title"))
    return t.groupBy("title").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1 and length(title) > 5").select("doc_id", "title")


_AGE = "date_diff('day', o_orderdate::date, date '2001-09-01')"


@REGISTRY(f"""select o_orderkey, (case o_orderstatus when 'F' then 130 when 'O' then 100 else 80 end * case when o_orderpriority like '1%' then 120 else 100 end
 * case when {_AGE} <= 183 then 120 when {_AGE} <= 548 then 112 when {_AGE} <= 1096 then 105 else 100 end)::bigint as weight from orders""")
def passage_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of kind, title and age multiplied, in whole hundredths so that they add up alike everywhere."""
    age = F.datediff(F.lit("2001-09-01").cast("date"), F.to_date("o_orderdate"))
    kind = F.when(F.col("o_orderstatus") == "F", 130).when(F.col("o_orderstatus") == "O", 100).otherwise(80)
    title = F.when(F.col("o_orderpriority").startswith("1"), 120).otherwise(100)
    recent = F.when(age <= 183, 120).when(age <= 548, 112).when(age <= 1096, 105).otherwise(100)
    return table(spark, sf_dir, "orders").select("o_orderkey", (kind * title * recent).cast("long").alias("weight"))


@REGISTRY(r"""select doc_id, regexp_extract(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')) || ' ', '^(.{0,160}) ', 1) as excerpt from documents where text is not null""")
def excerpt_at_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of prose, cut at the last word that ends within 160 characters."""
    line = F.concat(F.trim(F.regexp_replace("text", r"[ \t\r\n\f]+", " ")), F.lit(" "))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.regexp_extract(line, "^(.{0,160}) ", 1).alias("excerpt"))


@REGISTRY("select conv_id, turn, role, length(text)::int as size, (row_number() over (partition by conv_id order by turn))::int as place from conversations where role <> 'system'")
def thread_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threads with their visible replies, oldest first."""
    c = table(spark, sf_dir, "conversations").where("role <> 'system'")
    return c.select("conv_id", "turn", "role", F.length("text").alias("size"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("place"))


@REGISTRY("""with a as (select user_id, ts, event_id, case event_type when 'error' then 'hidden' when 'signup' then 'visible' when 'purchase' then 'locked' end as state from events)
select user_id, max_by(state, (ts, event_id)) as state, count(*)::bigint as actions from a where state is not null group by 1""")
def moderation_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state that the log's last verb left each item in."""
    verb = F.when(F.col("event_type") == "error", "hidden").when(F.col("event_type") == "signup", "visible").when(F.col("event_type") == "purchase", "locked")
    a = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", verb.alias("state")).where("state is not null")
    return a.groupBy("user_id").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"), F.count("*").alias("actions"))


@REGISTRY("""with a as (select doc_id, md5(text) as h from documents where doc_id % 2 = 0 and text is not null), b as (select md5(text) as h, min(doc_id) as other from documents where doc_id % 2 = 1 and text is not null group by 1)
select a.doc_id, b.other from a join b on a.h = b.h""")
def same_bytes_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one inventory with a file of the other that has the same bytes; which of several doesn't matter."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5("text").alias("h"))
    other = d.where("doc_id % 2 = 1").groupBy("h").agg(F.min("doc_id").alias("other"))
    return d.where("doc_id % 2 = 0").join(other, "h").select("doc_id", "other")


@REGISTRY("""select o_custkey, strftime(coalesce(min(case when o_orderpriority = '1-URGENT' then o_orderdate end), min(case when o_orderpriority = '2-HIGH' then o_orderdate end), min(o_orderdate)), '%Y-%m-%d') as held_on from orders group by 1""")
def date_by_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The date of each key from its best source: conditional minima in one aggregate."""
    of = lambda p: F.min(F.when(F.col("o_orderpriority") == p, F.col("o_orderdate")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.date_format(F.coalesce(of("1-URGENT"), of("2-HIGH"), F.min("o_orderdate")), "yyyy-MM-dd").alias("held_on"))


@REGISTRY("""select user_id, event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') as last_seen from events group by all
having max(ts) + case event_type when 'purchase' then interval 30 day when 'signup' then interval 7 day else interval 15 minute end >= timestamp '2024-01-30'""")
def live_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys whose state hasn't run out by an instant; the time to live hangs on the kind."""
    at = F.lit("2024-01-30").cast("timestamp")
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("ts").alias("t"))
    since = F.when(F.col("event_type") == "purchase", at - F.expr("interval 30 days")).when(F.col("event_type") == "signup", at - F.expr("interval 7 days")).otherwise(at - F.expr("interval 15 minutes"))
    return g.where(F.col("t") >= since).select("user_id", "event_type", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


def greedy_pairs(scored: DataFrame, block: str, left: str, right: str) -> DataFrame:
    """(block, left, right, score): the best pair first, each side once, scores 3 down to 1, ties by left and then right.

    The rule takes from what is left after each pick, so it runs inside a block, whose pairs are one task's.
    """

    def run(frame):
        used_l, used_r, keep = set(), set(), []
        for i, (a, b) in enumerate(zip(frame[left], frame[right], strict=True)):
            if a not in used_l and b not in used_r:
                used_l.add(a)
                used_r.add(b)
                keep.append(i)
        return frame.iloc[keep]

    schema = scored.select(block, left, right, "score").schema
    return scored.select(*schema.names).groupBy(block).applyInPandas(lambda f: run(f.sort_values(["score", left, right], ascending=[False, True, True])), schema)


def residue_pairs(left: DataFrame, right: DataFrame, block: str, a: str, b: str, moduli: tuple[int, ...] = (100, 10, 5)) -> DataFrame:
    """``greedy_pairs`` of keys that score by the first modulus they agree in, the best score first; keys are unique and not null.

    Whoever agrees in a residue agrees with all of that residue, so the greedy rule takes the k-th left with the k-th right
    of each (block, residue), and one side at most is left for the next modulus. No pair is made that isn't kept.
    """
    rest = left.select(block, a, F.lit(None).cast(right.schema[b].dataType).alias(b)).unionByName(right.select(block, F.lit(None).cast(left.schema[a].dataType).alias(a), b)).where(F.col(block).isNotNull())
    parts = []
    for score, modulus in zip(range(len(moduli), 0, -1), moduli, strict=True):
        key = F.coalesce(a, b)
        place = F.row_number().over(Window.partitionBy(block, "_residue", F.col(a).isNull()).orderBy(key))
        met = rest.withColumn("_residue", key % modulus).withColumn("_place", place).groupBy(block, "_residue", "_place").agg(F.max(a).alias(a), F.max(b).alias(b))
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        parts.append(met.where(both).select(block, a, b, F.lit(score).alias("score")))
        rest = met.where(~both).select(block, a, b)
    return reduce(DataFrame.unionByName, parts)


@REGISTRY()
def pair_names_to_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People and accounts of a nation paired greedily by how much of their numbers agrees."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return residue_pairs(c, s, "nation", "c_custkey", "s_suppkey")
