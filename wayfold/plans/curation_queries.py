"""Queries on what curators and schedulers do: operations on events, the next reads, shapes of features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import shape
from ..operators import grounding, operations, revision, selection
from .registry import query, table


def curated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as events, orders as observations, and seven operations on each four customers A, B, C, D: merge A B, merge C B, split some of B's orders from A, move D's first order to C, undo the first merge (every second four), undo that (every fourth), merge D A."""
    who = F.col("c_custkey")
    events = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), who).alias("event"), who.cast("long").alias("born"), F.floor(who / 4).alias("k"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_custkey") / 4).alias("k"))
    members = orders.select(F.concat(F.lit("o"), "o_orderkey").alias("observation"), F.concat(F.lit("c"), "o_custkey").alias("event"))
    k = F.col("k")
    named = orders.groupBy("k").agg(
        F.collect_list(F.when((F.col("o_custkey") == 4 * k + 1) & (F.col("o_orderkey") % 3 == 0), F.concat(F.lit("o"), "o_orderkey"))).alias("split"), F.min(F.when(F.col("o_custkey") == 4 * k + 3, F.col("o_orderkey"))).alias("d"))
    fours = events.groupBy("k").agg(F.count("*").alias("n")).where("n = 4").join(named, "k", "left")
    c = lambda i: F.concat(F.lit("c"), 4 * k + i - 1)
    null, none = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    steps = [
        ("merge", c(1), c(2), none, None), ("merge", c(3), c(2), none, None), ("split", c(1), F.concat(F.lit("s"), k), F.col("split"), None),
        ("reattribute", null, c(3), F.when(F.col("d").isNotNull(), F.array(F.concat(F.lit("o"), "d"))), None), ("rollback", null, null, none, 1), ("rollback", null, null, none, 5), ("merge", c(4), c(1), none, None)]
    rows = F.array(*[
        F.struct((k * 10 + i + 1).cast("long").alias("seq"), F.lit(kind).alias("kind"), a.alias("left"), b.alias("right"), obs.alias("observations"), (k * 10 + target if target else F.lit(None)).cast("long").alias("target_seq"), F.lit(i + 1).alias("step"))
        for i, (kind, a, b, obs, target) in enumerate(steps)])
    log = fours.select("k", F.explode(rows).alias("r")).where("(r.step <> 5 or k % 2 = 0) and (r.step <> 6 or k % 4 = 0)").select("r.*").drop("step")
    return events.drop("k"), members, log


@query("""
with fours as (select floor(c_custkey / 4)::bigint as k from customer group by 1 having count(*) = 4),
o as (select o_orderkey, o_custkey, floor(o_custkey / 4)::bigint as k, o_custkey % 4 as i, min(o_orderkey) filter (o_custkey % 4 = 3) over (partition by floor(o_custkey / 4)) as d from orders),
r as (select o.*, case when i = 1 and o_orderkey % 3 = 0 then 's' || k end as part, 'c' || (4 * k) as a, 'c' || o_custkey as own, fours.k is not null as four from o left join fours using (k)),
s as (select *, case when not four then own when i = 3 then own else a end as e2, case when not four then own when i = 3 and o_orderkey <> d then own else coalesce(part, a) end as e4 from r),
t as (select *, case when four and k % 2 = 0 and i = 1 then own else e4 end as e5 from s),
u as (select *, case when k % 4 = 0 then e4 else e5 end as e6 from t)
select 'o' || o_orderkey as observation, n as step, case n when 0 then own when 2 then e2 when 4 then e4 when 5 then e5 when 6 then e6 else case when four and i = 3 then a else e6 end end as event from u, (select unnest([0, 2, 4, 5, 6, 7]) as n)""")
def event_memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of every order at first and after five of the steps that concern its customers."""
    events, members, log = curated(spark, sf_dir)
    ways = operations.histories(members, operations.replay(events, members, log))
    block = members.select("observation", F.floor(F.substring("event", 2, 20).cast("long") / 4).alias("k"), F.explode(F.array(*map(F.lit, (0, 2, 4, 5, 6, 7)))).alias("step"))
    return operations.as_of(block.join(ways, "observation"), F.col("k") * 10 + F.col("step")).select("observation", "step", "event")


PER_SOURCE, MOST, READY = 200, 400, 60
PER_PUBLISHER, OVERALL = {"fresh": 40, "backfill": 25}, {"fresh": 150, "backfill": 90}
RANKED = "fresh desc, version"


@query(f"""
with v as (select doc_id as version, source, regexp_extract(source, '^[a-z]+') || doc_id % 7 as publisher, doc_id % 3 = 0 as fresh, doc_id % 5 = 0 as "full", case when doc_id % 4 = 0 then doc_id // 50 end as event from documents where source is not null),
active as (select publisher, case when fresh then 'fresh' else 'backfill' end as kind, count(*) as n from v join labels on version = labels.doc_id where toxic = 1 and version % 2 = 1 group by all),
every as (select kind, sum(n) as n from active group by kind),
r0 as (select *, row_number() over (partition by publisher order by {RANKED}) as rank from (select * from v where event is not null qualify row_number() over (partition by event, publisher order by {RANKED}) = 1)),
r as (select version, source, publisher, fresh, "full", true as ready, row_number() over (order by rank, publisher) - 1 as turn from r0 qualify turn < {READY}),
s0 as (select *, row_number() over (partition by publisher order by source, {RANKED}) as rank from (select * from v qualify row_number() over (partition by source order by {RANKED}) <= {PER_SOURCE})),
s as (select version, source, publisher, fresh, "full", false as ready, row_number() over (order by rank, publisher <= 'm', publisher) - 1 + {READY} as turn from s0 qualify turn < {MOST} + {READY}),
b as (select *, case when "full" then 'full' when fresh then 'fresh' else 'backfill' end as kind from (select * from r union all select * from s) qualify row_number() over (partition by version order by turn) = 1),
p as (select b.*, row_number() over (partition by publisher, kind order by turn) + coalesce(n, 0) as upto from b left join active using (publisher, kind)),
q as (select p.*, row_number() over (partition by kind order by turn) + coalesce(n, 0) as all_upto from p left join every using (kind) where kind = 'full' or upto <= case kind when 'fresh' then {PER_PUBLISHER["fresh"]} else {PER_PUBLISHER["backfill"]} end)
select version, publisher, source, kind, ready, row_number() over (order by turn) - 1 as place, case when ready then 2.0 when fresh then 1.0 else 0.5 end::double as priority
from q where kind = 'full' or all_upto <= case kind when 'fresh' then {OVERALL["fresh"]} else {OVERALL["backfill"]} end qualify place < {MOST}""")
def article_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that a cycle fetches next: turns of publishers, waiting events first, under ceilings for each publisher and for all."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    rows = docs.select(
        i.alias("version"), "source", F.concat(F.regexp_extract("source", "^[a-z]+", 0), (i % 7).cast("string")).alias("publisher"), (i % 3 == 0).alias("fresh"), (i % 5 == 0).alias("full"), F.when(i % 4 == 0, F.floor(i / 50)).alias("event"))
    labelled = rows.join(table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("version")), "version").where("version % 2 = 1")
    active = labelled.groupBy("publisher", F.when(F.col("fresh"), "fresh").otherwise("backfill").alias("kind")).agg(F.count("*").alias("n"))
    return selection.select(rows, active, PER_SOURCE, MOST, READY, PER_PUBLISHER, OVERALL, cursor="m")


@query("""
with p as (select l_orderkey as id, l_linenumber, (3 * l_quantity - 90)::bigint as x, 10 * l_linenumber - 35 as y, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) as i, l_orderkey % 7 as kind from lineitem),
u as (select id, kind, avg(y) as latitude, avg(x) as longitude, min(x) as west, min(y) as south, max(x) as east, max(y) as north, count(*) as points from p where kind not in (4, 5) and (kind > 0 or i = 1) group by id, kind),
f as (select o_orderkey as id, o_orderkey % 90 as y, o_orderkey % 180 as x from orders where o_orderkey not in (select id from u) and o_orderkey % 5 <> 0)
select id, case kind when 0 then 'Point' when 1 then 'LineString' when 2 then 'Polygon' when 3 then 'MultiPolygon' else 'Mixed' end as type, latitude, longitude, west::double as west, south::double as south, east::double as east, north::double as north, points::int as points from u
union all select id, 'Point', y::double, x::double, x::double, y::double, x::double, y::double, 1 from f""")
def feature_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Center and box of a GeoJSON text for every order: its lines as points, one to three arrays deep, or mixed with text and points outside the world; some are broken or hold nothing."""
    at = F.struct("l_linenumber", "l_quantity", F.array((3 * F.col("l_quantity") - 90).cast("long"), (10 * F.col("l_linenumber") - 35).cast("long")).alias("p"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(at)), lambda s: s["p"]).alias("p"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    k, p = F.col("o_orderkey") % 7, F.array_join(F.transform("p", lambda a: F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ","), F.lit("]"))), ",")
    told = lambda kind, text: F.concat(F.lit(f'{{"type":"{kind}","coordinates":'), *text, F.lit("}"))
    text = (
        F.when(k == 0, told("Point", [F.lit("["), F.array_join(F.get("p", F.lit(0)).cast("array<string>"), ","), F.lit("]")]))
        .when(k == 1, told("LineString", [F.lit("["), p, F.lit("]")])).when(k == 2, told("Polygon", [F.lit("[["), p, F.lit("]]")])).when(k == 3, told("MultiPolygon", [F.lit("[[["), p, F.lit("]]]")]))
        .when(k == 4, F.lit('{"type":"GeometryCollection","geometries":[]}')).when(k == 5, F.lit('{"type":"Polygon","coordinates":[[1,'))
        .otherwise(told("Mixed", [F.lit('[["1","2"],[400,0],[[],null,['), p, F.lit("]]]")])))
    where = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey"))
    found = rows.select(F.col("o_orderkey").alias("id"), shape(text, (where % 90).cast("double"), (where % 180).cast("double")).alias("s")).where("s is not null")
    return found.select("id", "s.type", "s.latitude", "s.longitude", "s.west", "s.south", "s.east", "s.north", "s.points")


def checked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customers as claims of each nation, orders as results of their verification; every tenth order was applied before."""
    i, who = F.col("o_orderkey"), F.col("c_custkey")
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), n.cast("int"))
    claims = table(spark, sf_dir, "customer").select(
        who.cast("string").alias("claim_id"), "c_nationkey", F.col("c_nationkey").cast("string").alias("situation"), pick(["seismic.magnitude", "event.status", "topic.other"], who % 3).alias("predicate"), (who % 11).cast("string").alias("value"),
        pick(["corroborated", "refuted", "disputed", "unverified"], who % 4).alias("truth_status"), (who % 90 / 100).alias("confidence"))
    observed = F.concat(F.lit('{"magnitude":"'), (i % 13).cast("string"), F.lit('","status":"S'), (i % 3).cast("string"), F.lit('"}'))
    results = table(spark, sf_dir, "orders").select(
        i.alias("result_id"), F.col("o_custkey").cast("string").alias("claim_id"), pick(["supports", "refutes", "refutes", "supports", "inconclusive", "mixed", "revises", "supports", "refutes"], i * 7 % 9).alias("result"), (i * 13 % 120 / 100).alias("confidence"), observed.alias("observed"))
    return claims.drop("c_nationkey"), results, results.where("result_id % 10 = 0").select("result_id")


APPLIED = """with recursive r as (select o_orderkey as result_id, o_custkey as claim_id, ['corroborated', 'refuted', 'refuted', 'corroborated', 'unverified', 'disputed', 'superseded', 'corroborated', 'refuted'][o_orderkey * 7 % 9 + 1] as asked, least(0.99::double, (o_orderkey * 13 % 120)::double / 100) as sure,
  row_number() over (partition by o_custkey order by o_orderkey) as n from orders where o_orderkey % 10 <> 0 and o_custkey in (select c_custkey from customer)),
c as (select c_custkey as claim_id, c_nationkey as situation, ['seismic.magnitude', 'event.status', 'topic.other'][c_custkey % 3 + 1] as predicate, (c_custkey % 11)::varchar as value, ['corroborated', 'refuted', 'disputed', 'unverified'][c_custkey % 4 + 1] as status, (c_custkey % 90)::double / 100 as confidence from customer),
s(claim_id, n, result_id, before, status, confidence, told, told_confidence) as (select claim_id, 0::bigint, null::bigint, null::varchar, status, confidence, null::varchar, null::double from c
union all select claim_id, n, result_id, before, case when asked = 'unverified' then before else told end, case when asked = 'unverified' then old else told_confidence end, told, told_confidence from
 (select *, case when clash then 'disputed' else asked end as told, round(case when clash then least(0.7::double, greatest(sure, old)) else sure end, 4) as told_confidence from
 (select r.claim_id, r.n, r.result_id, r.asked, r.sure, s.status as before, s.confidence as old, (s.status = 'corroborated' and asked = 'refuted' or s.status = 'refuted' and asked = 'corroborated') and sure <= s.confidence + 0.1::double as clash from s join r on r.claim_id = s.claim_id and r.n = s.n + 1))),
ledger as (select result_id, claim_id, before as previous_status, told as truth_status, told_confidence as confidence from s where n > 0)"""


@query(APPLIED + " select result_id, claim_id::varchar as claim_id, previous_status, truth_status, confidence from ledger")
def applied_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every result of verification that wasn't applied yet makes of its claim."""
    return revision.apply_results(*checked(spark, sf_dir)).drop("observed")


@query(APPLIED + """, v as (select c.situation::varchar as situation, predicate, case predicate when 'seismic.magnitude' then (result_id % 13)::varchar when 'event.status' then 'S' || result_id % 3 end as value, l.confidence, l.claim_id::varchar as revises, result_id from ledger l join c using (claim_id) where truth_status = 'superseded')
select 'revision:' || result_id as claim_id, situation, predicate, value, 'corroborated' as truth_status, confidence, revises from v where value is not null and not exists (select 1 from c where c.situation::varchar = v.situation and c.predicate = v.predicate and c.value = lower(v.value))
qualify row_number() over (partition by situation, predicate, value order by result_id) = 1""")
def revised_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that superseding results open."""
    claims, results, applied = checked(spark, sf_dir)
    return revision.revised_claims(claims, revision.apply_results(claims, results, applied))


ADAPTERS = ["usgs", "nws-alerts", "cisa-kev", "eonet", "world-bank", "fred", "firms", "github-advisories"]
SPEAKERS = ["usgs_earthquakes", "nws_alerts", "nasa_eonet", "press", "nasa_firms_wildfires"]


def grounded_claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as claims, their lines as the documents that state them."""
    i, p, s = F.col("o_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    claims = table(spark, sf_dir, "orders").select(
        i.alias("claim"), F.concat(F.lit("value "), F.when(i % 50 == 0, F.concat(F.lit("cve-2020-"), (i % 1000 + 1000).cast("string"))).otherwise("")).alias("object"), F.when(i % 3 == 0, F.lit(" Report")).when(i % 3 == 1, "nobody").alias("speaker"),
        F.when(i % 9 == 0, "unknown").otherwise("checkable").alias("verifiability"), F.when(i % 8 == 0, "event.reported").otherwise("topic").alias("predicate"))
    number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")) + 10
    docs = table(spark, sf_dir, "lineitem").withColumn("n", number).select(
        F.col("l_orderkey").alias("claim"), F.concat("l_orderkey", F.lit("-"), "n").alias("document"), F.get(F.array(*map(F.lit, SPEAKERS)), (s % 5).cast("int")).alias("source"), F.when(p % 7 == 0, "no id").otherwise(F.concat(F.lit("x/y"), p)).alias("external_id"),
        F.concat(F.lit("Report "), F.when(p % 6 == 0, F.concat(F.lit("of CVE-2024-"), p % 40 + 1000)).otherwise("")).alias("title"), F.lit(None).cast("string").alias("summary"),
        F.when(s % 4 == 0, p % 90).cast("double").alias("lat"), F.when(s % 4 == 0, p % 360).cast("double").alias("lon"), F.col("l_shipdate").alias("published_at"), F.col("l_shipdate").alias("retrieved_at"),
        F.when(F.col("n") == 11, F.concat(F.lit('{"country_code":"c'), p % 9, F.lit('","indicator_code":"i","series_id":"s'), p % 5, F.lit('","year":"20'), p % 30 + 10, F.lit('"}'))).when(F.col("n") == 12, "{").alias("metadata"))
    return claims, docs


GROUNDED = """with d0 as (select l_orderkey as claim, l_partkey as p, l_suppkey as s, l_shipdate as at_, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) + 10 as n from lineitem),
d as (select *, claim || '-' || n as document, ['usgs_earthquakes', 'nws_alerts', 'nasa_eonet', 'press', 'nasa_firms_wildfires'][s % 5 + 1] as source, case when p % 7 = 0 then 'no id' else 'x/y' || p end as ident, case when p % 6 = 0 then 'CVE-2024-' || (p % 40 + 1000) end as code,
  case when s % 4 = 0 then (p % 90)::double end as lat, case when s % 4 = 0 then (p % 360)::double end as lon, strftime(at_, '%Y-%m-%dT%H:%M:%S') as said, row_number() over (partition by claim order by at_ desc, document desc) - 1 as r from d0),
c as (select o_orderkey as claim, case when o_orderkey % 50 = 0 then 'CVE-2020-' || (o_orderkey % 1000 + 1000) end as code from orders),
e as (select d.* from d join c using (claim) where r < 8 and claim % 9 <> 0 and claim % 8 <> 0),
v as (select claim, r, document, 'authority_record' as type, source as namespace, ident as value, 0.99 as confidence, 'source_metadata' as method from e where source <> 'press' and ident <> 'no id'
union all select claim, r, document, 'geo_time_window', 'wgs84', '{"latitude":' || lat || ',"longitude":' || lon || ',"observed_at":"' || said || '"}', 0.94, 'document_coordinates' from e where lat is not null and lon <= 180
union all select claim, r, document, k, ns, case k when 'country_code' then 'c' || p % 9 when 'indicator_code' then 'i' when 'series_id' then 's' || p % 5 else '20' || (p % 30 + 10) end, 0.98, 'source_metadata' from e, (values ('country_code', 'iso3166'), ('indicator_code', 'world-bank'), ('series_id', 'fred'), ('year', 'gregorian')) m(k, ns) where n = 11
union all select distinct claim, 8, null, 'security_identifier', 'cve', code, 0.99, 'exact_pattern' from (select claim, code from e union all select claim, code from c where claim % 9 <> 0 and claim % 8 <> 0) where code is not null
union all select distinct claim, 8, null, 'named_entity', 'speaker', 'Report', 0.85, 'claim_attribution' from e where claim % 3 = 0),
g as (select claim, type, namespace, value, confidence::double as confidence, document, method, row_number() over (partition by claim order by confidence desc, r, type, namespace, value) - 1 as place from v qualify place < 24)"""


@query(GROUNDED + " select * from g")
def claim_groundings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers, places, codes and speakers that the documents of every claim state."""
    return grounding.groundings(*grounded_claims(spark, sf_dir))


@query(GROUNDED + f""", t as (select claim, [{", ".join(f"'{a}'" for a in ADAPTERS)}][claim % 8 + 1] as adapter, claim as task from c),
o as (select claim, arg_max(p, r) filter (false) as none, arg_min(case when p % 7 = 0 then 'no id' else 'x/y' || p end, r) filter (source = 'nws_alerts') as alert, arg_min(lat, r) filter (lat is not null) as lat, arg_min(lon, r) filter (lat is not null) as lon, arg_min(said, r) filter (lat is not null) as said, arg_min(code, r) filter (code is not null) as code, arg_min(p, r) filter (n = 11) as p from d group by claim),
h as (select claim, arg_min(value, place) filter (namespace = 'usgs_earthquakes') as usgs, arg_min(value, place) filter (namespace = 'nasa_eonet') as eonet, arg_min(value, place) filter (type = 'geo_time_window') as win from g group by claim),
j as (select t.*, o.* exclude (claim), h.* exclude (claim), c.code as own from t join c using (claim) left join o using (claim) left join h using (claim)),
k as (select *, case adapter when 'usgs' then usgs when 'cisa-kev' then coalesce(own, code) when 'github-advisories' then coalesce(own, code) when 'eonet' then eonet when 'world-bank' then 'C' || p % 9 || ':I:20' || (p % 30 + 10) when 'fred' then 'S' || p % 5 || ':' end as ident,
 case adapter when 'usgs' then '{{"latitude":' || lat || ',"longitude":' || lon || ',"published_at":"' || said || '","radius_km":100}}' when 'firms' then replace(win, '"}}', '","radius_km":25}}') end as window_ from j)
select task, claim, adapter, case when ident is not null then case adapter when 'usgs' then 'usgs_event_id' when 'eonet' then 'event_id' when 'world-bank' then 'world_bank_observation' when 'fred' then 'fred_observation' else 'cve' end when window_ is not null then 'geo_time_window' else '' end as identifier_type, coalesce(ident, '') as identifier,
 coalesce(case adapter when 'world-bank' then '{{"country":"C' || p % 9 || '","indicator":"I","year":"20' || (p % 30 + 10) || '"}}' when 'fred' then '{{"series_id":"S' || p % 5 || '","date":""}}' else '{{"' || case adapter when 'usgs' then 'event_id' when 'eonet' then 'event_id' else 'cve' end || '":"' || ident || '"}}' end, window_, '') as query, ident is not null or window_ is not null as ready from k""")
def verification_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup that each claim's task makes: an identifier, or a place and time, by adapter."""
    claims, docs = grounded_claims(spark, sf_dir)
    tasks = claims.select(F.col("claim").alias("task"), "claim", F.get(F.array(*map(F.lit, ADAPTERS)), (F.col("claim") % 8).cast("int")).alias("adapter"))
    return grounding.targets(tasks, claims, docs, grounding.groundings(claims, docs))


TASK = "select doc_id, source, doc_id % 3 = 0 as fresh, doc_id % 5 < 2 as ready, doc_id % 4 as priority, case when doc_id % 7 = 0 then 'retry' else 'pending' end as status, n_chars % 50 as at_ from documents"


@query(f"""with t as ({TASK}), a as (select doc_id, source, row_number() over (partition by source order by case when fresh then 0 when priority >= 2 then 1 when status = 'retry' then 2 else 3 end, at_, doc_id) as publisher_rank from t),
b as (select doc_id, source, row_number() over (partition by source order by fresh desc, ready desc, priority, at_, doc_id) as publisher_rank from t)
select 'article' as queue, * from a where publisher_rank <= 25 union all select 'framing', * from b where publisher_rank <= 25""")
def publisher_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 25 tasks of each source, by the order of articles and by that of framing."""
    i = F.col("doc_id")
    tasks = table(spark, sf_dir, "documents").select(i, "source", F.when(i % 3 == 0, "fresh").otherwise("backfill").alias("kind"), (i % 3 == 0).alias("fresh"), (i % 5 < 2).alias("ready"), (i % 4).alias("priority"), F.when(i % 7 == 0, "retry").otherwise("pending").alias("status"), (F.col("n_chars") % 50).alias("at"))
    orders = {"article": selection.article_order("kind", "priority", "status", "at"), "framing": selection.fair_order("fresh", "ready", "priority", "at")}
    a, b = (selection.leased(tasks, "source", order, 25, "doc_id").select(F.lit(name).alias("queue"), "doc_id", "source", "publisher_rank") for name, order in orders.items())
    return a.union(b)


@query("""with t as (select doc_id, case when doc_id % 5 = 0 then 'gap' when doc_id % 5 < 4 then 'verification' else 'other' end as lane, n_chars as at_ from documents), r as (select *, row_number() over (partition by lane order by at_, doc_id) - 1 as i from t where lane <> 'other')
select doc_id, lane, row_number() over (order by case lane when 'gap' then i else i // 3 end, case lane when 'gap' then 1 else [0, 2, 3][i % 3 + 1] end) - 1 as place from r qualify place < 500""")
def lane_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 jobs of a rotation of three verifications to one gap that starts at the last verification."""
    jobs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "gap").when(F.col("doc_id") % 5 < 4, "verification").otherwise("other").alias("lane"), F.col("n_chars").alias("at"))
    return selection.lane_rotation(jobs, "lane", [F.col("at")], ["verification", "verification", "verification", "gap"], 2, 500, "doc_id").select("doc_id", "lane", "place")
