"""Queries on places and time.  The tables have no places: they follow from keys, alike in both forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import grid_key, in_box
from ..operators import joins, places
from ..session import shared_path
from ..streaming import micro_batches
from .registry import query, table

LAT, LON = "({k} * 7919 % 15000) / 100.0 - 75", "({k} * 104729 % 36000) / 100.0 - 180"


def located(df: DataFrame, key: str) -> DataFrame:
    """With lat and lon that a key gives."""
    return df.withColumn("lat", (F.col(key) * 7919 % 15000) / 100.0 - 75).withColumn("lon", (F.col(key) * 104729 % 36000) / 100.0 - 180)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observations: user modulo 7 is the cell, the type the kind, the value the severity."""
    events = table(spark, sf_dir, "events").withColumn("cell", F.col("user_id") % 7).withColumn("severity", F.col("value").cast("decimal(18,4)"))
    return places.daily_cells(events, "cell", "event_type", "ts", "severity")


CELLS = "c as (select user_id % 7 as cell, event_type, date_trunc('day', ts)::timestamp as day, count(*) as n, max(value::decimal(18,4)) as max_severity, sum(value::decimal(18,4)) as total_severity from events group by all)"


@query(f"with {CELLS} select cell, event_type, day, n, max_severity::double as max_severity, total_severity::double as total_severity from c")
def daily_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in ("max_severity", "total_severity")}).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(f"""
with {CELLS}, b as (select *, avg(n) over (partition by cell, event_type order by day rows between unbounded preceding and 1 preceding) as baseline from c)
select cell, event_type, day, n, round(least(1, (n - baseline) / greatest(3, 3 * baseline)), 6) as score from b where n >= 3 and n >= 1.5 * baseline""")
def cell_baseline_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = places.density_anomalies(cells(spark, sf_dir), "cell", "event_type", times=1.5)
    return found.select("cell", "event_type", F.col("day").cast("timestamp_ntz").alias("day"), "n", F.round("score", 6).alias("score"))


@query("""
with p as (select *, lag(value) over (partition by user_id, event_type order by ts, event_id) as previous from events)
select event_id, user_id, event_type, previous, value from p where value - previous >= 100""")
def feature_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = places.changes(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value", 100.0)
    return found.select("event_id", "user_id", "event_type", "previous", "value")


@query("""
select user_id, arg_min(event_id, (abs(epoch_us(ts) - epoch_us(timestamp '2024-01-15 12:00:00')), -event_id)) as event_id from events group by user_id""")
def nearest_time_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event nearest to a moment; of equally near ones the newest."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    target = F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return joins.nearest(table(spark, sf_dir, "events"), ["user_id"], F.abs(at - target), [-F.col("event_id")]).select("user_id", "event_id")


@query("""
with o as (select o_orderkey, o_custkey % 150 as user_id, o_orderdate + interval 8857 days - to_days((o_orderkey % 2300)::integer) as at from orders),
r as (select o.o_orderkey, max_by(e.event_id, (e.ts, e.event_id)) as event_id from o join events e on e.user_id = o.user_id and e.ts <= o.at group by all)
select o_orderkey, event_id from o left join r using (o_orderkey)""")
def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders, moved to the events' time, with the last event of their user at or before."""
    at = F.col("o_orderdate") + F.expr("interval 8857 days") - F.expr("make_dt_interval(cast(o_orderkey % 2300 as int))")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), at.alias("at"))
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return joins.as_of(orders, events, ["user_id"], "at", "ts", ["event_id"], "event_id").select("o_orderkey", "event_id")


@query("""
select a.event_id as left_id, b.event_id as right_id from events a join events b on a.event_type = b.event_type and a.user_id = b.user_id and b.ts between a.ts - interval 1 day and a.ts + interval 0 days and a.event_id <> b.event_id""")
def band_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one user and type within the day before another."""
    events = table(spark, sf_dir, "events")
    a = events.select("user_id", "event_type", F.col("event_id").alias("left_id"), F.col("ts").alias("at"))
    b = events.select("user_id", "event_type", F.col("event_id").alias("right_id"), F.col("ts").alias("start"))
    return joins.band_join(a, b, "at", "start", 1, 0, ["user_id", "event_type"]).where("left_id <> right_id").select("left_id", "right_id")


@query(f"""
with p as (select c_custkey, {LAT.format(k="c_custkey")} as lat, {LON.format(k="c_custkey")} as lon from customer)
select c_custkey, 'z6:' || floor((lat + 90) * 2)::bigint || ':' || floor((lon + 180) * 2)::bigint as cell from p where lat between -30 and 40 and (lon >= 150 or lon <= -120)""")
def bbox_antimeridian(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = located(table(spark, sf_dir, "customer"), "c_custkey").where(in_box(F.col("lat"), F.col("lon"), -30, 150, 40, -120))
    return found.select("c_custkey", grid_key(F.col("lat"), F.col("lon")).alias("cell"))


KM = "2 * 6371.0 * asin(least(1, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"


@query(f"""
with p as (select s_suppkey as id, {LAT.format(k="s_suppkey")} as lat, {LON.format(k="s_suppkey")} as lon from supplier), c as (select c_custkey as id, {LAT.format(k="c_custkey")} as lat, {LON.format(k="c_custkey")} as lon from customer)
select a.id as s_suppkey, b.id as c_custkey, round({KM}, 3) as km from p a join c b on {KM} <= 300""")
def haversine_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers within 300 km of suppliers."""
    a = located(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"))
    b = located(table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_custkey").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"))
    found = joins.within_km(a, b, 300.0, 2.0)
    return found.select(F.col("a_id").alias("s_suppkey"), F.col("b_id").alias("c_custkey"), F.round("km", 3).alias("km"))


@query(f"""
with m as (select s_nationkey, s_suppkey, {LAT.format(k="s_suppkey")} as lat, {LON.format(k="s_suppkey")} as lon, abs(s_acctbal) + 1 as w from supplier),
d as (select a.s_nationkey, a.s_suppkey, sum((b.w * {KM})::decimal(28,4)) as spread, count(*) as members from m a join m b on a.s_nationkey = b.s_nationkey group by all)
select s_nationkey, arg_min(s_suppkey, (spread, s_suppkey)) as medoid, any_value(members) as members from d group by s_nationkey""")
def situation_medoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier nearest to all of its nation, weighted by balance."""
    rows = located(table(spark, sf_dir, "supplier"), "s_suppkey").withColumn("w", F.abs("s_acctbal") + 1)
    return places.medoids(rows, "s_nationkey", "s_suppkey", "lat", "lon", "w").select("s_nationkey", "medoid", "members")


@query("""
with c as (select c_nationkey as k, count(*) as customers from customer group by all), o as (select c_nationkey as k, count(*) as orders, count(*) filter (o_orderstatus = 'F') as finished, sum(o_totalprice::decimal(18,2)) as total from orders join customer on o_custkey = c_custkey group by all), s as (select s_nationkey as k, count(*) as suppliers from supplier group by all)
select n_name, r_name, coalesce(customers, 0) as customers, coalesce(orders, 0) as orders, coalesce(finished, 0) as finished, coalesce(suppliers, 0) as suppliers, coalesce(total, 0)::double as total,
 case when suppliers is null then 'no suppliers' when orders is null then 'no orders' else '' end as gap
from nation join region on n_regionkey = r_regionkey left join c on c.k = n_nationkey left join o on o.k = n_nationkey left join s on s.k = n_nationkey""")
def country_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    customers = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("customers"))
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    orders = joined.groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("total"))
    suppliers = t("supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    base = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("k", F.col("n_nationkey"))
    gap = F.when(F.col("suppliers").isNull(), "no suppliers").when(F.col("orders").isNull(), "no orders").otherwise("")
    found = base.join(customers, "k", "left").join(orders, "k", "left").join(suppliers, "k", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("customers", "orders", "finished", "suppliers")]
    return found.select("n_name", "r_name", *counts, F.coalesce(F.col("total").cast("double"), F.lit(0.0)).alias("total"), gap.alias("gap"))


def run_stream(spark: SparkSession, out: DataFrame, name: str, mode: str) -> DataFrame:
    """Let a stream over files run to its end into files of the shared folder, and read those."""
    path = shared_path(spark, name)
    q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query("""
with c as (select user_id % 7 as cell, event_type, date_trunc('day', ts)::timestamp as day, count(*) as n, max(value) as max_severity from events group by all)
select c.* from c, (select max(ts) - interval 1 day as mark from events) where day + interval 1 day <= mark""")
def stream_daily_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily cells from a stream: the days that the watermark closed."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = events.withColumn("cell", F.col("user_id") % 7).withColumn("at", F.col("ts").cast("timestamp"))
    return run_stream(spark, micro_batches.stream_daily_cells(rows, "cell", "event_type", "at", "value"), "cells", "append")


@query("select event_id, user_id, event_type from events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream in which every event arrives twice, without the second ones."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    twice = events.withColumn("at", F.col("ts").cast("timestamp")).withColumn("_k", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_k")
    return run_stream(spark, micro_batches.stream_dedup(twice, ["event_id"], "at").select("event_id", "user_id", "event_type"), "dedup", "append")
