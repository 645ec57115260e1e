"""Queries that select and count work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import work
from .registry import query, table


@query("""
with g as (select o_custkey, count(distinct o_orderpriority) as publishers, count(distinct o_orderstatus) as families from orders group by all)
select *, publishers >= 2 and families >= 2 as ready from g""")
def independent_family_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.family_gate(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderstatus")


@query("""
with r as (select o_orderkey, o_orderpriority, row_number() over (partition by o_orderpriority order by o_orderdate, o_orderkey) as turn from orders)
select o_orderkey, o_orderpriority, turn from r order by turn, o_orderpriority > '2-HIGH' desc, o_orderpriority limit 100""")
def fair_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = work.round_robin(table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderdate", "o_orderkey"], "2-HIGH", 100)
    return found.select("o_orderkey", "o_orderpriority", "turn")


@query("""
select o_orderkey, round(o_totalprice / 500000 + least(0.5, greatest(0, date_diff('day', o_orderdate, timestamp '2001-08-01') * 0.03)), 6) as priority from orders
order by o_totalprice / 500000 + least(0.5, greatest(0, date_diff('day', o_orderdate, timestamp '2001-08-01') * 0.03)) desc, o_orderkey limit 200""")
def job_priority_aging(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.datediff(F.lit("2001-08-01").cast("date"), F.col("o_orderdate").cast("date"))
    jobs = table(spark, sf_dir, "orders").select("o_orderkey", work.aged(F.col("o_totalprice") / 500000, days).alias("p"))
    return jobs.orderBy(F.desc("p"), "o_orderkey").limit(200).select("o_orderkey", F.round("p", 6).alias("priority"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def anti_unprocessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select("c_custkey")


@query("select doc_id, source from documents where exists (select 1 from labels l where l.doc_id = documents.doc_id and quality = 1)")
def semi_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select("doc_id", "source")


@query("""
with recursive a as (select p_partkey as id, case when p_partkey % 5 = 0 then p_partkey else p_partkey - 1 end as target from part),
w as (select id, target as root from a union select w.id, a.target from w join a on a.id = w.root)
select id as p_partkey, min(root) as root from w group by id""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts point to the part before, every fifth to itself."""
    aliases = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, F.col("p_partkey")).otherwise(F.col("p_partkey") - 1).alias("target"))
    return work.roots(aliases, "p_partkey", "target", 4)


@query("""
select l_returnflag, quantile_disc(date_diff('day', o_orderdate, l_shipdate), 0.5) as p50, quantile_disc(date_diff('day', o_orderdate, l_shipdate), 0.95) as p95, max(date_diff('day', o_orderdate, l_shipdate)) as oldest
from lineitem join orders on l_orderkey = o_orderkey group by all""")
def percentile_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles: days are few, so they are counted before they are ranked."""
    joined = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = joined.groupBy("l_returnflag", F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("d")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("l_returnflag")
    ranked = days.withColumn("c", F.sum("n").over(w.orderBy("d"))).withColumn("t", F.sum("n").over(w))
    at = lambda p: F.min(F.when(F.col("c") >= F.ceil(F.col("t") * p), F.col("d")))
    return ranked.groupBy("l_returnflag").agg(at(F.lit(0.5)).alias("p50"), at(F.lit(0.95)).alias("p95"), F.max("d").alias("oldest"))


@query("""
with i as (select user_id, ts as a, ts + to_minutes(floor(value)::integer) as b from events),
n as (select *, case when max(b) over (partition by user_id order by a, b rows between unbounded preceding and 1 preceding) >= a then 0 else 1 end as new from i),
k as (select *, sum(new) over (partition by user_id order by a, b rows between unbounded preceding and current row) as k from n)
select user_id, min(a) as begins, max(b) as ends, count(*) as parts from k group by user_id, k""")
def free_busy_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events keep their user busy for as many minutes as their value."""
    rows = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("a"), (F.col("ts") + F.expr("make_dt_interval(0, 0, cast(floor(value) as int))")).alias("b"))
    return work.merged_intervals(rows, "user_id", "a", "b").select("user_id", "begins", "ends", "parts")


TABLES = ["customer", "documents", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier"]


@query(" union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in TABLES))
def overview_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from functools import reduce

    return reduce(DataFrame.union, [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in TABLES])


@query("""
select source, count(*) as documents, count(distinct lang) as languages, count(quality) as labelled, coalesce(sum(toxic), 0)::bigint as toxic, max(n_chars) as longest from documents left join labels using (doc_id) group by source""")
def source_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("documents"), F.count_distinct("lang").alias("languages"), F.count("quality").alias("labelled"), F.coalesce(F.sum("toxic"), F.lit(0)).cast("long").alias("toxic"), F.max("n_chars").alias("longest"))


@query("select event_id, event_type, user_id from events where event_id > 500 order by event_id limit 50")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.page(table(spark, sf_dir, "events"), 500, "event_id", 50).select("event_id", "event_type", "user_id")


@query("select event_id, event_type from events where event_id > 900 and event_type in ('purchase', 'error')")
def outbox_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where((F.col("event_id") > 900) & F.col("event_type").isin("purchase", "error")).select("event_id", "event_type")


@query("select c_nationkey as nationkey from customer where c_acctbal < 0 union select s_nationkey from supplier where s_acctbal < 0")
def country_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("nationkey"))
    return a.union(table(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_nationkey")).distinct()


@query("select c_custkey, least(604800, 21600 * power(2, least(5, greatest(0, c_custkey % 9 - 1))))::double as wait_seconds from customer")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", work.backoff_seconds(F.col("c_custkey") % 9, 21600.0, 604800.0, 5).alias("wait_seconds"))
