"""Forum views and rate limits over posts, replies and actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchment.plans.registry import Registry
from parchment.sources.tables import table

REGISTRY = Registry()


@REGISTRY("""select p.conv_id, left(p.text, 80) as preview, count(r.turn)::bigint as replies from conversations p left join conversations r on r.conv_id = p.conv_id and r.turn > 0 and r.role <> 'system'
where p.turn = 0 and p.role <> 'system' group by all order by p.conv_id desc limit 100""")
def forum_posts_visible_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest hundred posts with their visible replies; the page is cut before the replies are joined."""
    c = table(spark, sf_dir, "conversations")
    posts = c.where("turn = 0 and role <> 'system'").orderBy(F.desc("conv_id")).limit(100).select("conv_id", F.substring("text", 1, 80).alias("preview"))
    n = c.where("turn > 0 and role <> 'system'").groupBy("conv_id").agg(F.count("*").alias("n"))
    return posts.join(n, "conv_id", "left").select("conv_id", "preview", F.coalesce("n", F.lit(0)).cast("long").alias("replies"))


@REGISTRY("""select r_name as category, count(c_custkey)::bigint as posts from region left join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey and c_acctbal > 9000 group by 1""")
def forum_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible posts of each category, empty ones at zero; posts are counted by nation before any join."""
    n = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    at = table(spark, sf_dir, "nation").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return table(spark, sf_dir, "region").join(at, F.col("r_regionkey") == F.col("n_regionkey"), "left").groupBy(F.col("r_name").alias("category")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("posts"))


@REGISTRY("""select e.event_id, e.event_type as action, coalesce(c.c_name, 'a deleted item') as title from events e left join customer c on c.c_custkey = e.user_id and e.user_id % 7 <> 0
where e.event_type in ('error', 'signup') order by e.ts desc, e.event_id limit 200""")
def moderation_log_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest two hundred log rows with their titles, or a label where the item is gone."""
    log = table(spark, sf_dir, "events").where("event_type in ('error', 'signup')").orderBy(F.desc("ts"), "event_id").limit(200)
    c = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select("c_custkey", "c_name")
    return log.join(c, F.col("user_id") == F.col("c_custkey"), "left").select("event_id", F.col("event_type").alias("action"), F.coalesce("c_name", F.lit("a deleted item")).alias("title"))


@REGISTRY("""select 'post' as kind, conv_id, turn, length(text)::bigint as size from conversations where turn = 0 and length(text) > 600 union all select 'reply', conv_id, turn, length(text)::bigint from conversations where turn > 0 and length(text) > 900""")
def held_queue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held posts and held replies in one queue: one scan with a filter by kind, where a union would read twice."""
    c = table(spark, sf_dir, "conversations").withColumn("size", F.length("text").cast("long"))
    kind = F.when(F.col("turn") == 0, "post").otherwise("reply")
    return c.where("(turn = 0 and size > 600) or (turn > 0 and size > 900)").select(kind.alias("kind"), "conv_id", "turn", "size")


@REGISTRY("""with e as (select user_id, event_id, ts, row_number() over (partition by user_id, date_trunc('hour', ts) order by ts, event_id) as k from events) select event_id, user_id, k::int as used, k <= 2 as allowed from e""")
def rate_limit_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of each call in its key's hour, and whether the limit of two allows it."""
    w = Window.partitionBy("user_id", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", F.row_number().over(w).alias("used")).withColumn("allowed", F.col("used") <= 2)


def sliding_log(rows: DataFrame, key: str, at: str, order: str, limit: int, seconds: float) -> DataFrame:
    """(order, key, allowed): a call is refused if ``limit`` accepted ones are younger than ``seconds``; refused calls don't count.

    The log depends on what was accepted before, so sorted batches are folded, with the accepted times of one key held.
    """
    schema = f"{order} long, {key} long, allowed boolean"

    def fold(batches):
        from collections import deque

        import pandas as pd

        current, log = None, deque()
        for frame in batches:
            allowed = []
            for who, t in zip(frame[key].to_numpy(), frame["_at"].to_numpy(), strict=True):
                if who != current:
                    current, log = who, deque()
                while log and t - log[0] > seconds:
                    log.popleft()
                allowed.append(len(log) < limit)
                if allowed[-1]:
                    log.append(t)
            yield pd.DataFrame({order: frame[order], key: frame[key], "allowed": allowed})

    return rows.select(order, key, F.unix_micros(F.col(at).cast("timestamp")).cast("double").alias("_at")).withColumn("_at", F.col("_at") / 1e6).repartition(key).sortWithinPartitions(key, "_at", order).mapInPandas(fold, schema)


@REGISTRY("""with recursive e as (select user_id, event_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
r as (select user_id, event_id, k, [t] as log, true as allowed from e where k = 1
 union all select user_id, event_id, k, case when len(l) < 3 then list_append(l, t) else l end, len(l) < 3 from (select e.user_id, e.event_id, e.k, e.t, list_filter(r.log, lambda x: e.t - x <= 86400000000) as l from r join e on e.user_id = r.user_id and e.k = r.k + 1))
select event_id, user_id, allowed from r""")
def rate_limit_sliding_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three calls a day and key by the sliding log."""
    return sliding_log(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3, 86400.0)


@REGISTRY("""with u as (select s_suppkey as target, 1 as src, s_suppkey as pos, 'agenda' as via from supplier where s_suppkey % 2 = 0 union all select l_suppkey, 2, l_orderkey * 8 + l_linenumber, 'minutes' from lineitem)
select target, min_by(pos, (src, pos)) as place, max(src)::int as row_from, string_agg(distinct via, '+' order by via) as provenance from u group by target""")
def relevant_provenance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of two sources merged: the first position is kept, the later source's row wins, and all sources are named."""
    a = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("target"), F.lit(1).alias("src"), F.col("s_suppkey").alias("pos"), F.lit("agenda").alias("via"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("target"), F.lit(2).alias("src"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"), F.lit("minutes").alias("via"))
    g = a.unionByName(b).groupBy("target").agg(F.min_by("pos", F.struct("src", "pos")).alias("place"), F.max("src").alias("row_from"), F.array_join(F.array_sort(F.collect_set("via")), "+").alias("provenance"))
    return g
