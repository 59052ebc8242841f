"""History: counts by year, dense timelines, spans by precision, outcomes, bins, clusters and marker ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()


@REGISTRY("select o_orderpriority as topic, year(o_orderdate)::int as year, count(*)::bigint as n from orders group by all")
def timeline_year_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each topic by year."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("topic"), F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))


@REGISTRY("""with c as (select c_mktsegment as topic, year(o_orderdate)::int as y, count(*)::bigint as n from orders join customer on o_custkey = c_custkey group by all),
b as (select topic, min(y) as lo, max(y) as hi, sum(n)::bigint as total from c group by 1), g as (select topic, total, unnest(range(lo, hi + 1))::int as year from b)
select g.topic, g.year, coalesce(n, 0)::bigint as n, total from g left join c on g.topic = c.topic and g.year = c.y""")
def timeline_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years between a topic's first and last, those without events at zero; the gaps are filled inside one row a topic."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = o.groupBy(F.col("c_mktsegment").alias("topic"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    g = c.groupBy("topic").agg(F.map_from_entries(F.collect_list(F.struct("y", "n"))).alias("m"), F.min("y").alias("lo"), F.max("y").alias("hi"), F.sum("n").alias("total"))
    return g.select("topic", F.explode(F.sequence("lo", "hi")).alias("year"), "m", "total").select("topic", "year", F.coalesce(F.element_at("m", F.col("year")), F.lit(0)).cast("long").alias("n"), "total")


@REGISTRY("""with r as (select user_id, ts, case event_type when 'purchase' then 0 when 'signup' then 1 else 2 end as p from events), b as (select user_id, min(p) as p from r group by 1)
select r.user_id, b.p::int as precision_rank, strftime(min(ts), '%Y-%m-%d') as starts, case when max(ts)::date - min(ts)::date >= 2 then strftime(max(ts), '%Y-%m-%d') end as ends from r join b on r.user_id = b.user_id and r.p = b.p group by r.user_id, b.p""")
def event_span_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The span of the most precise tier of dates; an end only if it is two days later or more.  One aggregate by tier, one by key."""
    tier = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "signup", 1).otherwise(2)
    t = table(spark, sf_dir, "events").groupBy("user_id", tier.alias("p")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    g = t.groupBy("user_id").agg(F.min(F.struct("p", "a", "b")).alias("x"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return g.select("user_id", F.col("x.p").alias("precision_rank"), day("x.a").alias("starts"), F.when(F.datediff("x.b", "x.a") >= 2, day("x.b")).alias("ends"))


@REGISTRY("""select l_orderkey, case when count(distinct l_linestatus) > 1 then 'inconclusive' when min(l_linestatus) = 'F' then 'failed' else 'passed' end as outcome from lineitem group by 1""")
def outcome_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome that all records agree on, else inconclusive; least and greatest tell without collecting."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_linestatus").alias("lo"), F.max("l_linestatus").alias("hi"))
    return g.select("l_orderkey", F.when(F.col("lo") != F.col("hi"), "inconclusive").when(F.col("lo") == "F", "failed").otherwise("passed").alias("outcome"))


@REGISTRY("""with m as (select l_orderkey, max(l_linenumber) as reading from lineitem group by 1), k as (select l.l_orderkey, l_linenumber, l_shipdate, l_returnflag from lineitem l join m on l.l_orderkey = m.l_orderkey and l_linenumber = reading),
d as (select l_orderkey, max(l_shipdate) as last_day from k group by 1)
select k.l_orderkey, max(l_linenumber)::int as reading, case when count(distinct l_returnflag) > 1 then 'ambiguous' else min(l_returnflag) end as decision from k join d on k.l_orderkey = d.l_orderkey and l_shipdate = last_day group by 1""")
def vote_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision at the last reading, then the last date; ambiguous where records of that date differ."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_shipdate").agg(F.min("l_returnflag").alias("lo"), F.max("l_returnflag").alias("hi"))
    last = per.groupBy("l_orderkey").agg(F.max(F.struct("l_linenumber", "l_shipdate", "lo", "hi")).alias("x"))
    return last.select("l_orderkey", F.col("x.l_linenumber").cast("int").alias("reading"), F.when(F.col("x.lo") != F.col("x.hi"), "ambiguous").otherwise(F.col("x.lo")).alias("decision"))


BINS = 24


@REGISTRY(f"""with b as (select event_type as lane, least(greatest(date_diff('second', timestamp '2024-01-01', ts) * {BINS} // 2592000, 0), {BINS - 1})::int as bin from events), c as (select lane, bin, count(*)::bigint as n from b group by all),
g as (select lane, unnest(range({BINS}))::int as bin from (select distinct lane from c)) select g.lane, g.bin, coalesce(n, 0)::bigint as n from g left join c on g.lane = c.lane and g.bin = c.bin""")
def timeline_histogram_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts in fixed bins over a domain, lane by lane, empty bins at zero, late ones in the last."""
    seconds = F.unix_timestamp(F.date_trunc("second", "ts")) - F.unix_timestamp(F.lit("2024-01-01").cast("timestamp"))
    bin_ = F.least(F.greatest(F.floor(seconds * BINS / 2592000), F.lit(0)), F.lit(BINS - 1)).cast("int")
    c = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("lane"), bin_.alias("bin")).agg(F.count("*").alias("n"))
    g = c.groupBy("lane").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    return g.select("lane", F.explode(F.sequence(F.lit(0), F.lit(BINS - 1))).alias("bin"), "m").select("lane", "bin", F.coalesce(F.element_at("m", F.col("bin")), F.lit(0)).cast("long").alias("n"))


def greedy_clusters(rows: DataFrame, lane: str, x: str, width: float) -> DataFrame:
    """(lane, cluster, first_x, last_x, n): a point joins while it is less than ``width`` from the first of its cluster.

    The rule depends on order, so a lane's distinct points, counted before the shuffle, are folded over sorted batches with
    one cluster carried: a task's rows are bounded by the points a lane can have, and its memory by one batch.
    """
    schema = f"{lane} string, cluster long, first_x double, last_x double, n long"

    def fold(batches):
        import pandas as pd

        open_: dict = {}
        for frame in batches:
            out = []
            for name, at, many in zip(frame[lane].to_numpy(), frame[x].to_numpy(), frame["_many"].to_numpy(), strict=True):
                if open_ and open_["l"] == name and at - open_["a"] < width:
                    open_["b"], open_["n"] = at, open_["n"] + many
                    continue
                if open_:
                    out.append((open_["l"], open_["k"], open_["a"], open_["b"], open_["n"]))
                open_ = {"l": name, "k": open_["k"] + 1 if open_ and open_["l"] == name else 0, "a": at, "b": at, "n": many}
            if out:
                yield pd.DataFrame(out, columns=[lane, "cluster", "first_x", "last_x", "n"])
        if open_:
            yield pd.DataFrame([(open_["l"], open_["k"], open_["a"], open_["b"], open_["n"])], columns=[lane, "cluster", "first_x", "last_x", "n"])

    points = rows.groupBy(lane, x).agg(F.count("*").alias("_many"))
    return points.repartition(lane).sortWithinPartitions(lane, x).mapInPandas(fold, schema)


@REGISTRY("""with recursive p as (select event_type, epoch(date_trunc('second', ts))::bigint as x from events), r as (select event_type, 0::bigint as cluster, min(x) as first_x from p group by 1
 union all select r.event_type, r.cluster + 1, min(p.x) from r join p on p.event_type = r.event_type and p.x >= r.first_x + 3600 group by r.event_type, r.cluster),
b as (select *, coalesce(lead(first_x) over (partition by event_type order by cluster), 9000000000000) as until from r)
select b.event_type, cluster, first_x::double as first_x, max(x)::double as last_x, count(*)::bigint as n from b join p on p.event_type = b.event_type and p.x >= first_x and p.x < until group by all""")
def timeline_greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each lane in greedy clusters of an hour from their first."""
    e = table(spark, sf_dir, "events").select("event_type", F.unix_timestamp(F.date_trunc("second", "ts")).cast("double").alias("x"))
    return greedy_clusters(e, "event_type", "x", 3600.0)


@REGISTRY("""with m as (select l_orderkey, l_linenumber as starts, lead(l_linenumber) over (partition by l_orderkey order by l_linenumber) - 1 as ends from (select distinct l_orderkey, l_linenumber from lineitem))
select l_orderkey, starts::int as starts, coalesce(ends, 7)::int as ends, (coalesce(ends, 7) - starts)::int as missing from m""")
def marker_ranges_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges between markers, each up to the next, and how many numbers have no marker of their own."""
    m = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    ends = F.coalesce(F.lead("l_linenumber").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")) - 1, F.lit(7)).cast("int")
    return m.select("l_orderkey", F.col("l_linenumber").cast("int").alias("starts"), ends.alias("ends")).withColumn("missing", F.col("ends") - F.col("starts"))


@REGISTRY("select (year(o_orderdate) - case when month(o_orderdate) < 6 then 1 else 0 end)::int as session, count(*)::bigint as n, count(distinct o_custkey)::bigint as people from orders group by 1")
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and people by session; a session starts in June."""
    session = F.year("o_orderdate") - F.when(F.month("o_orderdate") < 6, 1).otherwise(0)
    return table(spark, sf_dir, "orders").groupBy(session.alias("session")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("people"))
