"""Versions and editions: as-of picks, deltas, labels, shares of edits, and change verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()


@REGISTRY("with g as (select p_name as lineage, count(*)::bigint as editions from part group by p_name having count(*) > 1) select lineage, editions, p_partkey as member from g join part on p_name = lineage")
def lineage_multi_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lineages with several editions, a row an edition."""
    p = table(spark, sf_dir, "part").select(F.col("p_name").alias("lineage"), F.col("p_partkey").alias("member"))
    return p.join(p.groupBy("lineage").agg(F.count("*").alias("editions")).where("editions > 1"), "lineage").select("lineage", "editions", "member")


@REGISTRY("""with r as (select *, row_number() over (partition by p_name order by (p_type = 'SMALL'), p_retailprice desc, p_size desc, p_partkey) as k from part)
select p_name as lineage, p_partkey as in_force from r where k = 1""")
def edition_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edition of each lineage that holds: not set aside, latest, by an aggregate that combines before the shuffle."""
    best = F.struct(F.when(F.col("p_type") == "SMALL", 1).otherwise(0), -F.col("p_retailprice"), -F.col("p_size"), "p_partkey")
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("lineage")).agg(F.min_by("p_partkey", best).alias("in_force"))


@REGISTRY("""select l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') as amended, o_orderstatus from lineitem join orders on l_orderkey = o_orderkey
where l_shipdate >= timestamp '1997-05-01' and l_shipdate < timestamp '1997-05-15' and o_orderpriority = '1-URGENT'""")
def amendments_between_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amendments of certain documents in a half-open period; both filters reach the scans."""
    at = F.col("l_shipdate")
    hit = table(spark, sf_dir, "lineitem").where((at >= F.lit("1997-05-01").cast("timestamp")) & (at < F.lit("1997-05-15").cast("timestamp")))
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_orderstatus")
    return hit.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.date_format("l_shipdate", "yyyy-MM-dd").alias("amended"), "o_orderstatus")


def as_of(facts: DataFrame, versions: DataFrame, key: str, at: str, version_at: str, payload: str) -> DataFrame:
    """Each fact with the last version of its key at or before it, else the first one; ``dated`` tells which.

    Facts and versions are united and read in order of time, so a key with many of both costs their sum and not their
    product; one shuffle by key.
    """
    marked = facts.select(key, F.col(at).alias("_at"), F.lit(1).alias("_fact"), F.struct(*facts.columns).alias("_row"), F.lit(None).cast(versions.schema[payload].dataType).alias("_p"))
    v = versions.select(key, F.col(version_at).alias("_at"), F.lit(0).alias("_fact"), F.lit(None).cast(marked.schema["_row"].dataType).alias("_row"), F.col(payload).alias("_p"))
    w = Window.partitionBy(key).orderBy("_at", "_fact", "_p")
    before = F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = marked.unionByName(v).withColumn("_b", before).withColumn("_f", first).where("_fact = 1")
    return out.select("_row.*", F.coalesce("_b", "_f").alias(payload), F.col("_b").isNotNull().alias("dated"))


@REGISTRY("""with v as (select user_id, ts, event_id as version_id from events where event_type = 'purchase'), f as (select user_id, ts, event_id from events where event_type = 'error'),
b as (select f.event_id, max_by(v.version_id, (v.ts, v.version_id)) as before_id from f join v on f.user_id = v.user_id and v.ts <= f.ts group by 1),
o as (select user_id, min_by(version_id, (ts, version_id)) as first_id from v group by 1)
select f.event_id, coalesce(before_id, first_id) as version_id, before_id is not null as dated from f left join b using (event_id) left join o using (user_id)""")
def version_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version in force at each fact, else the first, flagged."""
    e = table(spark, sf_dir, "events")
    facts = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    versions = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("version_id"))
    return as_of(facts, versions, "user_id", "ts", "ts", "version_id").select("event_id", "version_id", "dated")


@REGISTRY("""select event_id, value - lag(value) over (partition by user_id order by ts, event_id) as delta from events""")
def version_previous_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change from the previous version of the same key; null where there is none."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.col("value") - F.lag("value").over(w)).alias("delta"))


@REGISTRY("""select event_id, case when count(*) over (partition by user_id, ts::date) > 1 then strftime(ts, '%Y-%m-%d %H:%M') else strftime(ts, '%Y-%m-%d') end as label from events where event_type = 'purchase'""")
def version_day_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day, with the time only where a key has several that day."""
    w = Window.partitionBy("user_id", F.to_date("ts"))
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'")
    return e.select("event_id", F.when(F.count("*").over(w) > 1, F.date_format("ts", "yyyy-MM-dd HH:mm")).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("label"))


@REGISTRY("""with w as (select conv_id, role, len(string_split(text, ' '))::bigint as n from conversations), k as (select conv_id, role, sum(n) as n from w where n >= 30 group by all),
t as (select conv_id, sum(n) as total from k where role <> 'system' group by 1)
select k.conv_id, role, k.n::bigint as words, (k.n * 100 // total)::bigint as share, row_number() over (partition by k.conv_id order by k.n desc, role)::int as place
from k join t on k.conv_id = t.conv_id where role <> 'system' and k.n >= 30 and k.n * 100 >= 5 * total""")
def editors_ranked_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writers of each text by words added: changes of thirty words or more, at least five in a hundred; others don't count."""
    n = F.size(F.split("text", " ")).cast("long")
    k = table(spark, sf_dir, "conversations").where("role <> 'system'").withColumn("n", n).where("n >= 30").groupBy("conv_id", "role").agg(F.sum("n").alias("words"))
    total = F.sum("words").over(Window.partitionBy("conv_id"))
    out = k.withColumn("total", total).where("words * 100 >= 5 * total").withColumn("share", F.expr("words * 100 div total"))
    return out.select("conv_id", "role", "words", "share", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("words"), "role")).alias("place"))


@REGISTRY("""with k as (select o_custkey, max(o_orderdate) as modified from orders where o_orderdate < timestamp '1998-06-01' group by 1),
t as (select o.o_custkey, o.o_orderpriority from orders o join k on o.o_custkey = k.o_custkey and o.o_orderdate = k.modified)
select o_custkey, case when count(distinct o_orderpriority) = 1 then min(o_orderpriority) end as version from t group by 1""")
def version_unambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version at the latest time before a bound, or null if several differ there; one aggregate over structs."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") < F.lit("1998-06-01").cast("timestamp"))
    per_day = o.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderpriority").alias("lo"), F.max("o_orderpriority").alias("hi"))
    last = per_day.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "lo", "hi")).alias("x"))
    return last.select("o_custkey", F.when(F.col("x.lo") == F.col("x.hi"), F.col("x.lo")).alias("version"))
