"""The named read queries, over the tables as world_queries takes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import items
from ..operators import judgement
from ..session import dealt
from .place_queries import LAT, LON, located
from .registry import query, table
from .world_queries import CLAIMS, NOW, REPORTS, claims, evidence, reports


@query("""
select p_partkey, 'statement.attributed' as predicate, 'Maker ' || p_partkey as speaker, p_name || ' is fine' as statement from part union all
select p_partkey, case p_partkey % 3 when 0 then 'event.causal_explanation' else 'event.prediction' end, null, case p_partkey % 3 when 0 then 'Prices fell because of ' else 'Prices could reach ' end || p_name || '.' from part where p_partkey % 3 < 2""")
def prose_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of made-up sentences about parts; the tables' own texts are invented words that claim nothing."""
    middle = F.get(F.array(*map(F.lit, ("fell because of ", "could reach ", "stay near "))), F.col("p_partkey") % 3)
    text = F.concat(F.lit("Maker "), "p_partkey", F.lit(" said that "), "p_name", F.lit(" is fine. Prices "), middle, "p_name", F.lit("."))
    found = judgement.prose_claims(table(spark, sf_dir, "part").select("p_partkey", text.alias("t")), "t", "p_partkey")
    return found.select("p_partkey", "predicate", "speaker", "statement")


@query(f"""
with {REPORTS}, {CLAIMS}, c as (select *, situation || predicate || value as claim from claims where families < 14 and predicate <> 'y0')
select claim, case when value = 'N' then 'official' else 'independent-public' end as desired, round(least(1, 0.4 + weight * 0.5), 4) as priority, claim || ':' || case when value = 'N' then 'official' else 'independent-public' end as dedupe_key from c""")
def verification_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims(spark, sf_dir).select(F.concat("situation", "predicate", "value").alias("claim"), F.when(F.col("predicate") == "y0", "unknown").otherwise("checkable").alias("verifiability"), F.col("predicate"), F.when(F.col("families") >= 14, "corroborated").otherwise("unverified").alias("truth"), F.col("weight").alias("importance"), "value")
    return judgement.verification_tasks(rows, F.when(F.col("value") == "N", "official").otherwise("independent-public"))


@query(f"""
with {REPORTS}, {CLAIMS}, a as (select doc // 4 as claim, value, family, credibility, credibility >= 0.95 and line = 1 as sure from evidence),
s as (select claim, max(case when sure then credibility end) as a, count(distinct family) as f from a where value = 'A' group by claim), c as (select claim, max(case when sure then credibility end) as a, count(distinct family) as f from a where value = 'R' group by claim),
sw as (select claim, case when a is not null then greatest(0.8, least(0.99, a)) when f >= 2 then least(0.9, 0.65 + 0.08 * f) end as w, a is not null as p from s), cw as (select claim, case when a is not null then greatest(0.8, least(0.99, a)) when f >= 2 then least(0.9, 0.65 + 0.08 * f) end as w, a is not null as p from c),
j as (select coalesce(x.claim, y.claim) as claim, x.w as s, y.w as c, x.p as sp, y.p as cp from (select * from sw where w is not null) x full join (select * from cw where w is not null) y on x.claim = y.claim)
select claim, case when coalesce(abs(s - c) < 0.15, false) then 'mixed' when c is null or s > c then 'supports' else 'refutes' end as result, round(case when coalesce(abs(s - c) < 0.15, false) then least(0.65, greatest(s, c)) when c is null or s > c then s else c end, 4) as confidence,
 case when case when coalesce(abs(s - c) < 0.15, false) then case when s >= c then sp else cp end when c is null or s > c then sp else cp end then 'authoritative-ingested-evidence' else 'independent-family-corroboration' end as basis from j""")
def verification_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four reports make a claim; flag A supports it, R contradicts it."""
    rows = evidence(spark, sf_dir).select(F.floor(F.col("doc") / 4).alias("claim"), "value", "family", "credibility", ((F.col("credibility") >= 0.95) & (F.col("line") == 1)).alias("authoritative"))
    sides = [judgement.signal(rows.where(F.col("value") == v), "claim") for v in "AR"]
    return judgement.verification_results(*sides, "claim")


@query("""
with p as (select p_partkey, ['seismic.magnitude', 'economic.value', 'event.status', 'cyber.known_exploited'][p_partkey % 4 + 1] as predicate, case when p_partkey % 4 < 2 then (p_size / 4.0)::varchar else p_type end as e, case when p_partkey % 4 < 2 then ((p_size + p_partkey % 3) / 4.0)::varchar when p_partkey % 3 = 0 then upper(p_type) else p_brand end as o, p_partkey % 5 > 0 as found from part)
select p_partkey, case when not found then case when predicate = 'cyber.known_exploited' then 'refutes' else 'inconclusive' end when p_partkey % 4 < 2 then case when abs(e::double - o::double) <= case when predicate = 'seismic.magnitude' then 0.05 else greatest(0.001, abs(e::double) * 0.001) end then 'supports' else 'revises' end when lower(e) = lower(o) then 'supports' else 'revises' end as result from p""")
def value_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    number = lambda x: (x / 4.0).cast("string")
    e = F.when(k % 4 < 2, number(F.col("p_size"))).otherwise(F.col("p_type"))
    o = F.when(k % 4 < 2, number(F.col("p_size") + k % 3)).when(k % 3 == 0, F.upper("p_type")).otherwise(F.col("p_brand"))
    predicate = F.get(F.array(*map(F.lit, ("seismic.magnitude", "economic.value", "event.status", "cyber.known_exploited"))), k % 4)
    return table(spark, sf_dir, "part").select("p_partkey", judgement.compared(predicate, e, o, k % 5 > 0, F.lit(True))["result"].alias("result"))


@query(f"""
with {REPORTS}, m as (select doc // 3 as event, family, credibility >= 0.95 and category = '1-URGENT' as direct, 0.3 + (doc // 3 % 5) * 0.1 as base from reports), g as (select event, count(distinct family) as families, count(*) filter (direct) as direct, max(base)::double as b, event % 7 = 0 as d from m group by event),
s as (select *, case when not d and direct = 0 and families < 2 then least(b, 0.49) when direct > 0 then greatest(b, 0.7) when families >= 2 then greatest(b, least(0.9, 0.6 + 0.05 * families)) else b end as x from g)
select event, case when d then 'contested' when direct > 0 then 'directly-observed' when families >= 2 then 'corroborated' else 'early-signal' end as status, round(case when d then greatest(0.1, x - 0.15) else x end, 4)::double as confidence, families, direct from s""")
def event_assessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    event = F.floor(F.col("doc") / 3)
    members = reports(spark, sf_dir).select(event.alias("event"), "family", ((F.col("credibility") >= 0.95) & (F.col("category") == "1-URGENT")).alias("direct"), (0.3 + (event % 5) * 0.1).alias("base"))
    return judgement.event_assessment(members, members.where("event % 7 = 0"), "event")


FRAMES = "f as (select o_orderkey // 6 as event, o_custkey % 40 as publisher, o_custkey % 15 as family, l_orderkey as capture, l_returnflag as dimension, l_discount * 10 as strength, l_tax * 5 as confidence from lineitem join orders on l_orderkey = o_orderkey)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as framing observations: the flag is the dimension."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = dealt(lines, "l_orderkey", lines).join(dealt(orders, "o_orderkey", lines).hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(F.floor(F.col("o_orderkey") / 6).alias("event"), (F.col("o_custkey") % 40).alias("publisher"), (F.col("o_custkey") % 15).alias("family"), F.col("l_orderkey").alias("capture"), F.col("l_returnflag").alias("dimension"), (F.col("l_discount") * 10).alias("strength"), (F.col("l_tax") * 5).alias("confidence"))


@query(f"with {FRAMES} select capture, round(avg(strength) filter (dimension = 'A'), 3) as a, round(avg(strength) filter (dimension = 'N'), 3) as n, count(*) as evidence, round(round(avg(confidence), 4) + 1e-7, 3) as confidence from f group by capture")
def article_framing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judgement.framing_means(frames(spark, sf_dir).withColumn("strength", F.col("strength")), "capture")
    at = lambda k: F.round(F.try_element_at("scores", F.lit(k)), 3)
    return found.select("capture", at("A").alias("a"), at("N").alias("n"), "evidence", F.round(F.col("confidence") + 1e-7, 3).alias("confidence"))


@query(f"""
with {FRAMES}, g as (select event from f group by event having count(distinct publisher) >= 2 and count(distinct family) >= 2)
select event, publisher, dimension, round(avg(strength) + 1e-7, 4) as strength, count(*) as n from f where event in (select event from g) group by all""")
def event_framing_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judgement.framing_comparison(frames(spark, sf_dir).withColumn("strength", F.col("strength") + 1e-7), "event")
    return found.select("event", "publisher", "dimension", "strength", "n")


@query(f"""
with {REPORTS}, b as (select doc // 4 as event, publisher, family, bool_or(status = 'active') as c, bool_or(status = 'active' and category < '4') as a from reports group by all),
g as (select event, count(distinct publisher) as publishers, count(distinct family) as families, count(distinct publisher) filter (c) as captured, count(distinct publisher) filter (a) as assessed, count(distinct family) filter (a) as assessed_families from b group by event)
select *, case when publishers < 2 or families < 2 then 'needs-publishers' when captured < 2 then 'needs-captures' when assessed < 2 or assessed_families < 2 then 'needs-assessments' else 'ready' end as stage from g""")
def comparison_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir).select(F.floor(F.col("doc") / 4).alias("event"), "publisher", "family", (F.col("status") == "active").alias("captured"), ((F.col("status") == "active") & (F.col("category") < "4")).alias("assessed"))
    return judgement.readiness(rows, "event")


@query(f"""
with {REPORTS} select publisher, category, count(*) as documents, count(*) filter (status = 'active') as captured, round(count(*) filter (status = 'active') / count(*), 4) as share, count(*) filter (status = 'active') / count(*) >= 0.5 and bool_and(publisher % 9 > 0) as eligible from reports group by all""")
def coverage_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir).select("publisher", "category", (F.col("status") == "active").alias("captured"), (F.col("publisher") % 9 > 0).alias("healthy"))
    return judgement.coverage(rows, ["publisher", "category"], 0.5)


FORECASTS = "fc as (select o_orderkey as id, o_orderpriority as category, 'k' || (o_custkey % 3) as kind, case when o_custkey % 40 <= 10 then '0-1d' when o_custkey % 40 <= 20 then '1-3d' else '7-30d' end as horizon, o_orderdate as target_at, case o_orderstatus when 'F' then 1.0 when 'O' then 0.0 end::double as outcome, 0.05 + (o_custkey % 19) * 0.05 as probability, o_orderkey % 10 as attempts from orders)"


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as forecasts: F happened, O didn't, P is open."""
    k = F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("category"), F.concat(F.lit("k"), k % 3).alias("kind"), F.when(k % 40 <= 10, "0-1d").when(k % 40 <= 20, "1-3d").otherwise("7-30d").alias("horizon"), F.col("o_orderdate").alias("target_at"), F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.0).alias("outcome"), (0.05 + (k % 19) * 0.05).alias("probability"), (F.col("o_orderkey") % 10).alias("attempts"))


@query(f"""
with {FORECASTS} select id, case when outcome is not null then 'resolved' when attempts >= 8 then 'expired' when target_at <= timestamp '1998-06-01' then 'due' else 'active' end as state, round(power(probability - outcome, 2), 6) as brier from fc""")
def forecast_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judgement.forecast_state(forecasts(spark, sf_dir), F.lit("1998-06-01").cast("timestamp_ntz"))
    return found.select("id", "state", F.round("brier", 6).alias("brier"))


@query(f"""
with {FORECASTS}, c as (select category, kind, horizon, count(*) filter (outcome = 1) + 1.0 as a, count(*) filter (outcome = 0) + 1.0 as b from fc where outcome is not null and kind <> 'k2' group by all), w as (select category, (count(*) filter (outcome = 1) + 1.0) / (count(*) + 2) as whole from fc where outcome is not null and kind <> 'k2' and category <> '5-LOW' group by category),
q as (select distinct category, kind, horizon from fc)
select category, kind, horizon, round(coalesce(case when category <> '5-LOW' then a / (a + b) end, whole, 0.5), 6)::double as rate, round(case when category <> '5-LOW' and a is not null then greatest(0, a / (a + b) - 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) end, 6)::double as lower, round(case when category <> '5-LOW' and a is not null then least(1, a / (a + b) + 1.64 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))) end, 6)::double as upper,
 case when a is not null and category <> '5-LOW' then 'cell' when whole is not null then 'category' else 'none' end as level from q left join c using (category, kind, horizon) left join w using (category)""")
def base_rate_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rates with bounds; one kind has no outcomes of its own, one category none at all."""
    rows = forecasts(spark, sf_dir)
    known = rows.where("outcome is not null and kind <> 'k2' and category <> '5-LOW'").withColumn("happened", F.col("outcome") == 1)
    return judgement.base_rate(rows.select("category", "kind", "horizon").distinct(), known)


@query(f"""
with {FORECASTS}, t(horizon, share) as (values ('0-1d', 0.2), ('1-3d', 0.3), ('3-7d', 0.1), ('7-30d', 0.4)), c as (select horizon, share, count(id) as n from t left join fc using (horizon) group by all)
select arg_min(horizon, (-(share * (select sum(n) + 1 from c) - n)::double, horizon)) as horizon from c""")
def portfolio_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = spark.createDataFrame([("0-1d", 0.2), ("1-3d", 0.3), ("3-7d", 0.1), ("7-30d", 0.4)], "horizon string, share double")
    return judgement.portfolio_slot(targets, forecasts(spark, sf_dir))


@query(f"""
with {REPORTS}, s as (select distinct situation from reports), p as (select distinct situation, 'c' || (publisher % 3) as country from reports),
g as (select sha256('event:' || situation) as id, 'event' as kind, null as source_id, null as target_id from s union all select sha256('observation:' || doc), 'observation', null, null from reports union all select sha256('country:' || country), 'country', null, null from (select distinct country from p)
 union all select sha256('reported_in:' || sha256('observation:' || doc) || ':' || sha256('event:' || situation)), 'reported_in', sha256('observation:' || doc), sha256('event:' || situation) from reports union all select sha256('located_in:' || sha256('event:' || situation) || ':' || sha256('country:' || country)), 'located_in', sha256('event:' || situation), sha256('country:' || country) from p) select * from g""")
def world_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reports(spark, sf_dir)
    places = rows.select("situation", F.concat(F.lit("c"), F.col("publisher") % 3).alias("country"))
    return judgement.world_graph(rows.select("situation").distinct(), rows.select(F.col("doc").alias("report"), "situation"), places)


@query(f"with {REPORTS} select doc, situation, publisher, category from reports where category = '1-URGENT' and status = 'active' and publisher in (1, 2, 3) order by at_ desc, doc limit 50")
def documents_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by filters that are given or not, newest first: fifty."""
    found, given = reports(spark, sf_dir), {"category": ["1-URGENT"], "status": ["active"], "publisher": [1, 2, 3], "family": None}
    for column, values in given.items():
        found = found if values is None else found.where(F.col(column).isin(values))
    return found.orderBy(F.desc("at"), "doc").limit(50).select("doc", "situation", "publisher", "category")


@query(f"with {REPORTS} select publisher, count(*) as documents, count(distinct situation) as situations, count(distinct family) as families, min(at_) as first_at, max(at_) as last_at, count(*) filter (status = 'deleted') as deleted, string_agg(distinct category, ',' order by category) as categories from reports group by publisher")
def publisher_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).groupBy("publisher").agg(F.count("*").alias("documents"), F.count_distinct("situation").alias("situations"), F.count_distinct("family").alias("families"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count_if(F.col("status") == "deleted").alias("deleted"), F.array_join(F.sort_array(F.collect_set("category")), ",").alias("categories"))


@query(f"with {REPORTS} select family, publisher, count(*) as documents, min(doc) as first_doc from reports group by all")
def reporting_family_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(spark, sf_dir).groupBy("family", "publisher").agg(F.count("*").alias("documents"), F.min("doc").alias("first_doc"))


@query(f"""
with {REPORTS}, c as (select publisher, category as topic, status as claim_type, count(*) as n, count(*) filter (price > 200000) as good, count(*) filter (price < 50000) as bad from reports group by all)
select publisher, topic, claim_type, n, round(case when n < 12 and bad = 0 then 0.6 else greatest(0.4, least(0.8, (0.6 * 8 + good) / (8 + good + 1.5 * bad))) end, 6) as learned from c""")
def reliability_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliability by publisher, topic and type of claim: dear reports hold, cheap ones don't."""
    good, bad = F.count_if(F.col("price") > 200000), F.count_if(F.col("price") < 50000)
    found = reports(spark, sf_dir).groupBy("publisher", F.col("category").alias("topic"), F.col("status").alias("claim_type")).agg(F.count("*").alias("n"), good.alias("g"), bad.alias("b"))
    mean = (0.6 * 8 + F.col("g")) / (8 + F.col("g") + 1.5 * F.col("b"))
    learned = F.when((F.col("n") < 12) & (F.col("b") == 0), 0.6).otherwise(F.greatest(F.lit(0.4), F.least(F.lit(0.8), mean)))
    return found.select("publisher", "topic", "claim_type", "n", F.round(learned, 6).alias("learned"))


@query(f"with {REPORTS} select publisher, count(*) as n, round(avg((category = '1-URGENT')::int), 6) as urgent_share, round(avg((status = 'deleted')::int), 6) as deleted_share, round(avg((price > 300000)::int), 6) as dear_share from reports group by publisher")
def content_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(F.avg(c.cast("int")), 6)
    return reports(spark, sf_dir).groupBy("publisher").agg(F.count("*").alias("n"), share(F.col("category") == "1-URGENT").alias("urgent_share"), share(F.col("status") == "deleted").alias("deleted_share"), share(F.col("price") > 300000).alias("dear_share"))


@query(f"""
with {REPORTS}, r as (select situation, doc, publisher, at_, row_number() over (partition by situation order by at_, doc) as k from reports), n as (select situation, count(distinct publisher) as p from reports group by situation)
select situation, doc, publisher, date_diff('second', at_, timestamp '{NOW}') // 3600 as age_hours from r join n using (situation) where k = 1 and p >= 2""")
def early_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first report of each situation that others took up, with its age."""
    found = reports(spark, sf_dir).groupBy("situation").agg(F.min(F.struct("at", "doc", "publisher")).alias("r"), F.count_distinct("publisher").alias("p")).where("p >= 2")
    hours = F.floor((F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.col("r.at").cast("timestamp"))) / 3600)
    return found.select("situation", "r.doc", "r.publisher", hours.alias("age_hours"))


@query(f"""
with {REPORTS}, l as (select doc, category, price, {LAT.format(k="doc")} as lat, {LON.format(k="doc")} as lon, case when doc % 4 > 0 then at_ + interval 30 days end as expires_at from reports)
select doc, category from l where lat between -10 and 45 and (lon >= 100 or lon <= -100) and (expires_at is null or expires_at >= timestamp '1999-01-01') and category not in ('5-LOW')""")
def map_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features in a box over the 180th meridian that haven't expired, without hidden kinds."""
    from ..functions.measures import in_box

    rows = located(reports(spark, sf_dir), "doc").withColumn("expires_at", F.when(F.col("doc") % 4 > 0, F.col("at") + F.expr("interval 30 days")))
    alive = F.col("expires_at").isNull() | (F.col("expires_at") >= F.lit("1999-01-01").cast("timestamp_ntz"))
    return rows.where(in_box(F.col("lat"), F.col("lon"), -10, 100, 45, -100) & alive & ~F.col("category").isin("5-LOW")).select("doc", "category")


@query(f"""
with {REPORTS}, g as (select floor(({LAT.format(k="situation")} + 90) / 30)::bigint as zone, category, status, price from reports)
select zone, count(*) as features, count(*) filter (status = 'deleted') as contested, count(distinct category) as kinds, max(price) as top_price, arg_min(category, (-n, category)) as main_kind from (select *, count(*) over (partition by zone, category) as n from g) group by zone""")
def regional_assessment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What happens in each zone: counts, and its most frequent kind, of equally frequent ones the first by name."""
    rows = located(reports(spark, sf_dir), "situation").withColumn("zone", F.floor((F.col("lat") + 90) / 30))
    kinds = rows.groupBy("zone", "category").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "deleted").alias("c"), F.max("price").alias("p"))
    return kinds.groupBy("zone").agg(F.sum("n").alias("features"), F.sum("c").alias("contested"), F.count("*").alias("kinds"), F.max("p").alias("top_price"), F.min_by("category", F.struct(-F.col("n"), "category")).alias("main_kind"))


@query(f"""
with {REPORTS}, s as (select situation, count(*) as documents, count(distinct family) as families, max(at_) as last_at from reports group by situation) select situation, documents, families, last_at from s where last_at >= (select max(at_) - interval 60 days from reports) order by families desc, documents desc, situation limit 20""")
def briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty widest situations of the last sixty days."""
    rows = reports(spark, sf_dir)
    last = rows.agg((F.max("at") - F.expr("interval 60 days")).alias("since"))
    found = rows.groupBy("situation").agg(F.count("*").alias("documents"), F.count_distinct("family").alias("families"), F.max("at").alias("last_at"))
    recent = found.join(F.broadcast(last), F.col("last_at") >= F.col("since"))  # one row
    return recent.orderBy(F.desc("families"), F.desc("documents"), "situation").limit(20).select("situation", "documents", "families", "last_at")


@query(f"""
with {REPORTS}, e as (select situation, min(at_) as started, max(at_) as last_seen, count(*) as observations, count(distinct family) as families, arg_min(doc, (-credibility, at_, doc)) as title_doc from reports group by situation)
select situation, started, last_seen, observations, families, title_doc, round(least(0.98, 0.42 + 0.14 * families + 0.04 * least(4, observations)), 4)::double as confidence from e""")
def world_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.fusion import event_summary

    rows = reports(spark, sf_dir).select(F.col("situation").alias("event"), F.col("doc").alias("observation"), "family", F.col("publisher").alias("source"), "category", F.col("doc").alias("title"), "credibility", F.col("at").alias("captured_at"), "at")
    found = event_summary(rows)
    return found.select(F.col("event").alias("situation"), F.col("started_at").alias("started"), F.col("last_at").alias("last_seen"), "observations", "families", F.col("title").alias("title_doc"), F.round("confidence", 4).alias("confidence"))


@query(f"""
with {REPORTS}, n as (select situation, publisher, count(*) as n from reports group by all) select situation, sum(n)::bigint as documents, count(*) as publishers, round(max(n) / sum(n), 6) as largest_share, count(*) filter (n = 1) as single from n group by situation""")
def clustering_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = reports(spark, sf_dir).groupBy("situation", "publisher").agg(F.count("*").alias("n"))
    return by.groupBy("situation").agg(F.sum("n").alias("documents"), F.count("*").alias("publishers"), F.round(F.max("n") / F.sum("n"), 6).alias("largest_share"), F.count_if(F.col("n") == 1).alias("single"))


@query(f"""
with {REPORTS}, q as (select category, status, count(*) as n, min(at_) as oldest from reports where doc % 3 = 0 group by all) select category, status, n, date_diff('second', oldest, timestamp '{NOW}') // 86400 as oldest_days from q""")
def enrichment_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits for enrichment (every third report), by kind and state, with the age of the oldest."""
    days = F.floor((F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds(F.min("at").cast("timestamp"))) / 86400)
    return reports(spark, sf_dir).where("doc % 3 = 0").groupBy("category", "status").agg(F.count("*").alias("n"), days.alias("oldest_days"))


@query(f"""
with {REPORTS}, h as (select date_trunc('month', at_)::timestamp as month, count(*) as n, count(*) filter (status = 'active') as done from reports group by all)
select month, n, done, sum(n) over (order by month) as total, round((n - done) / greatest(1, done), 6) as drain_months from h""")
def drain_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months that what is open would take at each month's rate, with a running total; months are few."""
    from pyspark.sql import Window

    found = reports(spark, sf_dir).groupBy(F.date_trunc("month", "at").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "active").alias("done"))
    return found.select("month", "n", "done", F.sum("n").over(Window.orderBy("month")).alias("total"), F.round((F.col("n") - F.col("done")) / F.greatest(F.lit(1), F.col("done")), 6).alias("drain_months"))


@query("""
with b as (select o_orderkey % 50 as g, o_orderpriority as m from orders where o_orderstatus <> 'P'), a as (select o_orderkey % 50 as g, o_orderpriority as m from orders where o_orderstatus <> 'F')
select coalesce(x.g, y.g) as g, coalesce(x.m, y.m) as member, case when y.g is null then 'removed' else 'added' end as change from (select distinct * from b) x full join (select distinct * from a) y on x.g = y.g and x.m = y.m where x.g is null or y.g is null""")
def membership_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that a change added and removed."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 50).alias("g"), F.col("o_orderpriority").alias("member"), "o_orderstatus")
    before, after = (rows.where(F.col("o_orderstatus") != s).select("g", "member").distinct() for s in "PF")
    return before.exceptAll(after).withColumn("change", F.lit("removed")).union(after.exceptAll(before).withColumn("change", F.lit("added")))


@query("""
select c_custkey, printf('%.1f,%.1f', round_even((c_custkey * 7919 % 10000)::double / 128.0 - 39.0, 1) + 0.0, round_even((c_custkey * 104729 % 20000)::double / 128.0 - 78.0, 1) + 0.0) as location, case when c_mktsegment = 'BUILDING' then 'earthquake' else replace(lower(c_mktsegment), '_', '-') end as topic from customer""")
def place_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places to a tenth of a degree, and stable topic names."""
    rows = table(spark, sf_dir, "customer").withColumns({"lat": F.col("c_custkey") * 7919 % 10000 / 128.0 - 39.0, "lon": F.col("c_custkey") * 104729 % 20000 / 128.0 - 78.0})
    named = F.when(F.col("c_mktsegment") == "BUILDING", "eq").otherwise(F.col("c_mktsegment"))
    return rows.select("c_custkey", items.location_key(F.col("lat"), F.col("lon")).alias("location"), items.topic(named).alias("topic"))
