"""Queries on reports, their outcomes and situations.

Orders stand for reports: their customer gives publisher and family, runs of 64
keys a situation, the priority a category.  Line items are the evidence of their
claims: the shipping year is the predicate, the return flag the value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import items
from ..functions.measures import haversine_km
from ..operators import fusion, outcomes, situations, snapshots
from ..session import dealt
from .place_queries import KM, LAT, LON, located
from .registry import query, table

REPORTS = """reports as (select o_orderkey as doc, o_orderkey // 64 as situation, o_custkey % 40 as publisher, o_custkey % 15 as family, o_orderdate as at_, o_orderpriority as category,
 case o_orderstatus when 'P' then 'deleted' else 'active' end as status, (case when o_custkey % 40 < 4 then 0.96 else 0.4 + (o_custkey % 40) * 0.0125 end)::double as credibility, o_totalprice as price from orders)"""
CLAIMS = """evidence as (select r.situation, r.doc, r.publisher, r.family, 'y' || (year(l_shipdate) % 3) as predicate, l_returnflag as value, l_shipdate as said_at, r.credibility, l_discount as discount, l_linenumber as line from lineitem join reports r on l_orderkey = r.doc),
claims as (select situation, predicate, value, min(said_at) as first_seen, max(said_at) as last_seen, count(*) as evidence, max(greatest(0, least(1, discount * 8))) as weight, count(distinct family) as families from evidence group by all)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reports."""
    who = F.col("o_custkey") % 40
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc"), F.floor(F.col("o_orderkey") / 64).alias("situation"), who.alias("publisher"), (F.col("o_custkey") % 15).alias("family"), F.col("o_orderdate").alias("at"), F.col("o_orderpriority").alias("category"),
        F.when(F.col("o_orderstatus") == "P", "deleted").otherwise("active").alias("status"), F.when(who < 4, 0.96).otherwise(0.4 + who * 0.0125).alias("credibility"), F.col("o_totalprice").alias("price"))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as evidence of claims."""
    every = table(spark, sf_dir, "lineitem")
    lines = every.select(F.col("l_orderkey").alias("doc"), F.concat(F.lit("y"), F.year("l_shipdate") % 3).alias("predicate"), F.col("l_returnflag").alias("value"), F.col("l_shipdate").alias("said_at"), F.col("l_discount").alias("discount"), F.col("l_linenumber").alias("line"))
    said = reports(spark, sf_dir).select("doc", "situation", "publisher", "family", "credibility")
    return dealt(lines, "doc", every).join(dealt(said, "doc", every).hint("merge"), "doc")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir).withColumn("w", F.col("discount") * 8)
    found = situations.merged_claims(rows, ["situation", "predicate", "value"], "said_at", "w")
    families = rows.groupBy("situation", "predicate", "value").agg(F.count_distinct("family").alias("families"))
    return found.join(families, ["situation", "predicate", "value"])


@query(f"with {REPORTS}, {CLAIMS} select situation, predicate, value, first_seen, last_seen, evidence, round(weight, 6) as weight from claims")
def claim_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims by natural key, with their evidence."""
    return claims(spark, sf_dir).select("situation", "predicate", "value", "first_seen", "last_seen", "evidence", F.round("weight", 6).alias("weight"))


@query(f"""
with {REPORTS}, {CLAIMS}, r as (select *, row_number() over (partition by doc, predicate, value order by discount desc, line) as k from evidence),
t as (select *, row_number() over (partition by doc order by discount desc, line, predicate, value) as rank from r where k = 1)
select doc, predicate, value, line, discount, rank from t where rank <= 3""")
def claim_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report's three most confident claims, each once."""
    found = situations.best_claims(evidence(spark, sf_dir), "doc", ["predicate", "value"], "discount", ["line", "predicate", "value"], 3)
    return found.select("doc", "predicate", "value", "line", "discount", "rank")


@query(f"""
with {REPORTS}, {CLAIMS}, e as (select *, doc * 8 + line as id, predicate <> 'y0' as single from evidence), f as (select *, min(id) over (partition by situation, predicate, value) as first from e),
s as (select situation, first as left_id, id as right_id, 'supports' as relationship from f where id <> first),
c as (select a.situation, a.id as left_id, b.id as right_id, 'contradicts' as relationship from f a join f b on a.situation = b.situation and a.predicate = b.predicate and a.value <> b.value and a.id < b.id and a.id = a.first and b.id = b.first and a.single and b.single)
select situation, relationship, count(*) as pairs, sum(right_id - left_id)::bigint as span from (select * from s union all select * from c) group by all""")
def claim_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supporting and contradicting claims of each situation."""
    rows = evidence(spark, sf_dir).select("situation", "predicate", "value", (F.col("doc") * 8 + F.col("line")).alias("id"), (F.col("predicate") != "y0").alias("single"))
    found = outcomes.relations(rows, "situation", "id", "predicate", "value")
    return found.groupBy("situation", "relationship").agg(F.count("*").alias("pairs"), F.sum(F.col("right_id") - F.col("left_id")).alias("span"))


@query(f"""
with {REPORTS}, {CLAIMS}, e as (select situation, predicate, value, doc * 8 + line as id, predicate <> 'y0' as single from evidence),
v as (select situation, predicate, value, min(id) as first_id, count(*) as equal from e group by all),
o as (select a.situation, a.predicate, a.value, coalesce(sum(b.equal), 0)::bigint as contrary, min(b.first_id) as contrary_id from v a left join v b on a.situation = b.situation and a.predicate = b.predicate and a.value <> b.value group by all)
select e.id, first_id, equal, case when single then contrary else 0 end as contrary, case when single then contrary_id end as contrary_id from e join v using (situation, predicate, value) join o using (situation, predicate, value)""")
def claim_opposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every claim the one that stands for its value, and what contradicts it; row by row."""
    rows = evidence(spark, sf_dir).select("situation", "predicate", "value", (F.col("doc") * 8 + F.col("line")).alias("id"), (F.col("predicate") != "y0").alias("single"))
    return outcomes.opposition(rows, "situation", "id", "predicate", "value")


@query(f"""
with {REPORTS}, {CLAIMS}, c as (select unnest(generate_series(date_trunc('month', min(at_)), max(at_) + interval 1 month, interval 3 month)) as cutoff from reports),
s as (select distinct situation from reports), d as (select s.situation, cutoff, (select count(distinct doc) from reports r where r.situation = s.situation and r.at_ <= cutoff) as documents, (select count(distinct family) from reports r where r.situation = s.situation and r.at_ <= cutoff) as families,
 (select count(*) from reports r where r.situation = s.situation and r.at_ <= cutoff and credibility >= 0.7) as credible, (select count(*) from reports r where r.situation = s.situation and r.at_ <= cutoff and status = 'deleted') as deleted from s, c)
select *, sha256('credible=' || credible || ',deleted=' || deleted || ',documents=' || documents || ',families=' || families) as snapshot_hash from d""")
def situation_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known of every situation at the start of every third month, in one pass."""
    rows = reports(spark, sf_dir)
    span = rows.agg(F.min("at").alias("a"), F.max("at").alias("b"))
    quarters = span.select(F.explode(F.expr("sequence(cast(date_trunc('MONTH', a) as timestamp_ntz), b + interval 1 month, interval 3 month)")).alias("cutoff"))
    return snapshots.at_cutoffs(rows, "situation", "at", quarters, {"documents": "doc", "families": "family"}, {"credible": F.col("credibility") >= 0.7, "deleted": F.col("status") == "deleted"})


MATCHES = """keys as (select doc, list_distinct(list(predicate || value)) as claims, list_distinct(list('w' || (line % 5) || value)) as tokens from evidence group by doc),
full_ as (select r.*, coalesce(claims, []) as claims, coalesce(tokens, []) as tokens from reports r left join keys using (doc)),
matches as (select a.doc, a.publisher, a.at_, b.doc as other, b.publisher as other_publisher, b.at_ as other_at, b.credibility from full_ a join full_ b on a.situation = b.situation and a.doc <> b.doc and a.publisher <> b.publisher and b.at_ > a.at_ and b.status = 'active' and b.credibility >= 0.6
 where len(list_intersect(a.claims, b.claims)) > 1 or (len(a.tokens) > 0 and len(b.tokens) > 0 and len(list_intersect(a.tokens, b.tokens)) / least(len(a.tokens), len(b.tokens)) >= 0.9))"""


def with_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with their words and pairs of specific claims."""
    keys = evidence(spark, sf_dir).groupBy("doc").agg(F.sort_array(F.collect_set(F.concat("predicate", "value"))).alias("c"), F.collect_set(F.concat(F.lit("w"), F.col("line") % 5, "value")).alias("tokens"))
    two = F.flatten(F.transform("c", lambda x: F.transform(F.filter("c", lambda y: y > x), lambda y: F.concat(x, F.lit("+"), y))))
    none = F.array().cast("array<string>")
    return reports(spark, sf_dir).join(keys.select("doc", "tokens", two.alias("claims")), "doc", "left").withColumns({"tokens": F.coalesce("tokens", none), "claims": F.coalesce("claims", none)})


@query(f"with {REPORTS}, {CLAIMS}, {MATCHES} select doc, count(*) as later, count(distinct other_publisher) as publishers, max(credibility) as best from matches group by doc")
def report_corroborators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later reports of other publishers that share two claims, or nearly all words."""
    found = outcomes.corroborators(with_keys(spark, sf_dir), 0.6, 0.9)
    return found.groupBy("doc").agg(F.count("*").alias("later"), F.count_distinct("other_publisher").alias("publishers"), F.max("credibility").alias("best"))


OUTCOME = f"""{REPORTS}, {CLAIMS}, {MATCHES},
against as (select r.doc, max(o.credibility) as against from reports r join reports o on r.situation = o.situation and o.at_ > r.at_ and o.publisher <> r.publisher and o.credibility >= 0.6 and r.category = '5-LOW' and o.category = '1-URGENT' group by r.doc),
backing as (select doc, count(distinct other_publisher) as n, bool_or(credibility >= 0.95) as sure, min(other_at) as first from matches group by doc),
result as (select doc, publisher, case when against is not null then 'contradicted' when n >= 2 or sure then 'confirmed' when status = 'deleted' then 'deleted_unverified' end as outcome, against, n, sure, first, at_ from reports left join against using (doc) left join backing using (doc)),
outcome as (select doc, publisher, outcome, case outcome when 'contradicted' then least(0.98, against) when 'confirmed' then least(0.98, 0.62 + 0.10 * least(3, n) + 0.12 * sure::int) else 0.35 end as confidence, outcome = 'confirmed' and date_diff('second', at_, first) >= 300 as was_early from result where outcome is not null)"""


def found_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = reports(spark, sf_dir)
    later = docs.where("category = '1-URGENT' and credibility >= 0.6").select("situation", F.col("at").alias("t"), F.col("publisher").alias("p"), "credibility")
    against = docs.where("category = '5-LOW'").drop("credibility").join(later, "situation").where("t > at and p <> publisher").select("doc", "credibility")
    return outcomes.delayed_outcome(docs, outcomes.corroborators(with_keys(spark, sf_dir), 0.6, 0.9), against)


@query(f"with {OUTCOME} select doc, publisher, outcome, round(confidence, 6) as confidence, was_early from outcome")
def report_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of reports: contradicted, confirmed or deleted; urgent reports contradict low ones."""
    return found_outcomes(spark, sf_dir).withColumn("confidence", F.round("confidence", 6))


@query(f"""
with {OUTCOME}, before as (select distinct publisher, credibility as baseline, least(1, credibility + 0.05) as learned, publisher % 7 as evaluated from reports),
f as (select publisher, count(*) as n, count(*) filter (outcome = 'confirmed') as confirmed, count(*) filter (outcome = 'contradicted') as contradicted, count(*) filter (outcome = 'deleted_unverified') as deleted, count(*) filter (outcome = 'confirmed' and was_early) as early,
  sum(case when outcome = 'confirmed' then confidence else 0 end) as good, sum(case outcome when 'confirmed' then 0 when 'contradicted' then confidence * 1.75 else confidence * 0.25 end) as bad from outcome group by publisher),
p as (select *, baseline * 12 + coalesce(good, 0) as a, (1 - baseline) * 12 + coalesce(bad, 0) as b, coalesce(n, 0) as k, n < 12 and contradicted + deleted = 0 as locked from before left join f using (publisher)),
q as (select *, a / (a + b) as target, sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) as d, 0.03 * sqrt(greatest(1, k - evaluated)) as reach from p)
select publisher, k as n, coalesce(confirmed, 0) as confirmed, coalesce(contradicted, 0) as contradicted, coalesce(deleted, 0) as deleted, coalesce(early, 0) as early,
 round(case when k = 0 then learned when locked then baseline when k <> evaluated then greatest(0, least(1, learned + greatest(-reach, least(reach, target - learned)))) else learned end, 4) as learned,
 round(greatest(0, least(1, case when k = 0 or locked then baseline - 0.25 else target - 1.64 * d end)), 4) as lower, round(greatest(0, least(1, case when k = 0 or locked then baseline + 0.25 else target + 1.64 * d end)), 4) as upper from q""")
def publisher_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publishers' credibility after the outcomes of their reports."""
    before = reports(spark, sf_dir).select("publisher", F.col("credibility").alias("baseline"), F.least(F.lit(1.0), F.col("credibility") + 0.05).alias("learned"), (F.col("publisher") % 7).alias("evaluated")).distinct()
    return outcomes.reputation(found_outcomes(spark, sf_dir), before)


@query(f"""
with {REPORTS}, {CLAIMS}, s as (select *, families >= 14 as good, families < 12 as bad from claims), e as (select distinct e.situation, e.predicate, e.value, e.publisher, e.family, s.good, s.families from evidence e join s using (situation, predicate, value) where s.good or s.bad)
select situation, predicate, value, publisher, case when good then 'confirmed' else 'refuted' end as outcome, max(families - 1) as others from e where not good or families > 1 group by all""")
def publisher_claim_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What claims say about those who made them, leaving their own family out."""
    status = F.when(F.col("families") >= 14, "corroborated").when(F.col("families") < 12, "refuted")
    rated = claims(spark, sf_dir).withColumn("status", status).where("status is not null").select("situation", "predicate", "value", "status")
    rows = evidence(spark, sf_dir).join(rated, ["situation", "predicate", "value"]).withColumn("claim", F.struct("situation", "predicate", "value"))
    found = outcomes.claim_outcomes(rows, "claim", "family", "publisher")
    return found.select("claim.*", "publisher", "outcome", "others")


REFRESH = """state as (select *, case when families >= 14 then 'contested' when evidence < 20 then 'superseded' else 'active' end as status, predicate = 'y1' and value = 'N' and evidence >= 40 as closed from claims),
fam as (select situation, count(distinct family) as n_families from reports group by situation),
fresh as (select situation, count(*) filter (status <> 'superseded') as claims, count(*) filter (status = 'contested') as contested, any_value(n_families) as n_families, case when bool_or(closed and status = 'active') then 'resolved' when count(*) filter (status = 'contested') > 0 then 'contested' else 'active' end as status,
 least(0.99, coalesce(avg(weight) filter (status <> 'superseded'), 0) + least(0.12, greatest(0, any_value(n_families) - 1) * 0.04)) as confidence from state join fam using (situation) group by situation)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("families") >= 14, "contested").when(F.col("evidence") < 20, "superseded").otherwise("active")
    return claims(spark, sf_dir).withColumns({"status": status, "closed": (F.col("predicate") == "y1") & (F.col("value") == "N") & (F.col("evidence") >= 40), "confidence": F.col("weight")})


def fresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = reports(spark, sf_dir).groupBy("situation").agg(F.count_distinct("family").alias("n_families"))
    return situations.refreshed(states(spark, sf_dir), families, "situation")


@query(f"with {REPORTS}, {CLAIMS}, {REFRESH} select situation, claims, contested, n_families, status, round(floor(confidence * 1e6 + 0.314) / 1e6, 2) as confidence from fresh")
def situation_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and confidence of situations from their claims."""
    return fresh(spark, sf_dir).withColumn("confidence", F.round(F.floor(F.col("confidence") * 1e6 + 0.314) / 1e6, 2))


@query(f"""
with {REPORTS}, {CLAIMS}, {REFRESH}, s as (select situation, min(category) as category, max(at_) as last_seen, count(distinct publisher) as publishers, count(*) as documents, avg(credibility) as credibility from reports group by situation)
select s.situation, s.category, f.status, publishers, documents, round(f.confidence, 2) as confidence from s join fresh f using (situation) where f.status <> 'resolved' order by f.status = 'contested' desc, floor(f.confidence * 50 + 0.314) desc, documents desc, s.situation limit 100""")
def situations_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open situations, contested ones first, by confidence in steps and size: a hundred at most."""
    found = reports(spark, sf_dir).groupBy("situation").agg(F.min("category").alias("category"), F.count_distinct("publisher").alias("publishers"), F.count("*").alias("documents"))
    rows = found.join(fresh(spark, sf_dir), "situation").where("status <> 'resolved'")
    top = rows.orderBy((F.col("status") == "contested").desc(), F.floor(F.col("confidence") * 50 + 0.314).desc(), F.desc("documents"), "situation").limit(100)
    return top.select("situation", "category", "status", "publishers", "documents", F.round("confidence", 2).alias("confidence"))


TTL, ARCHIVE = {"1-URGENT": 400, "2-HIGH": 900}, {"5-LOW": 300, "4-NOT SPECIFIED": 1200}
NOW = "2001-08-01"


def case(table_: dict, column: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then {v}" for k, v in table_.items()) + " end"


@query(f"""
with {REPORTS}, s as (select situation * 8 + publisher % 8 as id, min(category) as category, case when count(*) % 9 = 0 then 'resolved' else 'active' end as status, max(at_) as last_seen, count(distinct publisher) as publishers from reports group by all),
d as (select *, date_diff('second', last_seen, timestamp '{NOW}') / 86400.0 as days, id % 11 = 0 as forecast, id % 5 = 0 as contested from s)
select id, category, case when status = 'active' and not forecast and days > {case(TTL, "category")} then 'expired' when status = 'active' and not forecast and not contested and publishers <= 1 and days > {case(ARCHIVE, "category")} then 'archived' else status end as status from d""")
def situation_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Situations after maintenance."""
    ident = F.col("situation") * 8 + F.col("publisher") % 8
    found = reports(spark, sf_dir).groupBy(ident.alias("id")).agg(F.min("category").alias("category"), F.when(F.count("*") % 9 == 0, "resolved").otherwise("active").alias("status"), F.max("at").alias("last_seen"), F.count_distinct("publisher").alias("publishers"))
    found = found.withColumn("last_seen", F.col("last_seen").cast("timestamp"))
    forecasts, contested = found.where("id % 11 = 0"), found.where("id % 5 = 0")
    return situations.lifecycle(found, forecasts.select("id"), contested.select("id"), F.lit(NOW).cast("timestamp"), TTL, ARCHIVE, "id")


@query(f"""
with {REPORTS}, {CLAIMS}, {REFRESH}, s as (select situation, max(at_) as last_seen, count(distinct publisher) as publishers, count(*) as documents, avg(credibility) as credibility, min(category) as category from reports group by situation),
p as (select situation, {case({"1-URGENT": 3.0, "2-HIGH": 2.0, "3-MEDIUM": 1.5, "4-NOT SPECIFIED": 1.0, "5-LOW": 0.5}, "category")} + greatest(0, 4.0 - (date_diff('second', last_seen, timestamp '{NOW}') / 86400.0) / 100.0 / 2.0) + least(3, greatest(0, publishers - 1) * 1.25) + least(1.25, log2(greatest(1, documents)) * 0.4) + credibility + least(2, contested * 0.75) + least(3, (situation % 3) * 1.5) - case when publishers <= 1 and category = '5-LOW' then 1.0 else 0 end as score from s join fresh using (situation))
select situation, round(score, 4) as score from p""")
def situation_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score by which situations are worked on; a hundred days count as one."""
    base = items.lookup({"1-URGENT": 3.0, "2-HIGH": 2.0, "3-MEDIUM": 1.5, "4-NOT SPECIFIED": 1.0, "5-LOW": 0.5}, F.col("category"))
    found = reports(spark, sf_dir).groupBy("situation").agg(F.max("at").alias("last_seen"), F.count_distinct("publisher").alias("publishers"), F.count("*").alias("documents"), F.avg("credibility").alias("credibility"), F.min("category").alias("category"))
    rows = found.join(fresh(spark, sf_dir).select("situation", "contested"), "situation")
    days = (F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))) / 86_400e6 / 100.0
    score = situations.priority(days, F.col("publishers"), F.col("documents"), F.col("credibility"), F.col("contested"), F.col("situation") % 3, base, F.col("category") == "5-LOW")
    return rows.select("situation", F.round(score, 4).alias("score"))


@query(f"""
with {REPORTS}, m as (select situation, category, at_, {LAT.format(k="doc // 32")} as lat, {LON.format(k="doc // 32")} as lon from reports),
g as (select situation, min(category) as k, max(lat) - min(lat) as dlat, max(lon) - min(lon) as dlon, date_diff('second', min(at_), max(at_)) / 86400.0 as days from m group by situation), f as (select *, situation % 4 as n from g)
select situation, unnest(list_filter([case when dlat > 8 or dlon > 12 then 'wide_geography' end, case when k not in ('1-URGENT') and days > 900 then 'long_evidence_span' end, case when n > 0 then 'incompatible_claims' end], lambda x: x is not null)) as flag from f""")
def situation_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Situations whose reports don't fit together."""
    members = located(reports(spark, sf_dir).withColumn("spot", F.floor(F.col("doc") / 32)), "spot").withColumn("at", F.col("at").cast("timestamp"))
    contested = members.select("situation").distinct().withColumn("n", F.col("situation") % 4)
    return situations.integrity_flags(members, contested, "situation", "at", ["1-URGENT"], days=900.0)


@query(f"""
with {REPORTS}, {CLAIMS}, h as (select situation, count(*) as n from (select distinct situation, category from reports) group by situation having count(*) >= 2), o as (select *, row_number() over (partition by situation order by evidence desc, predicate, value) as k from claims where families < 14 and predicate <> 'y0' and situation in (select situation from h))
select situation, predicate, value, round(least(1, 0.5 + 0.4 * least(1, weight)), 4) as priority, situation || ':' || predicate || ':' || value as dedupe_key from o where k <= 3""")
def information_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncertain checkable claims of situations with rival readings, three at most."""
    rows = claims(spark, sf_dir).withColumns({"truth": F.when(F.col("families") < 14, "unverified").otherwise("corroborated"), "checkable": F.col("predicate") != "y0", "importance": F.col("weight")})
    rivals = reports(spark, sf_dir).select("situation", "category").distinct()
    return situations.gaps(rows, rivals, "situation", [F.desc("evidence"), "predicate", "value"])


@query("""
with d as (select date_trunc('month', o_orderdate)::timestamp as month, sum(o_totalprice::decimal(18,2)) as used, count(*) as queued, count(*) filter (o_orderstatus = 'F') as done from orders group by all),
s as (select month, case when used is null then 'unknown' when used >= 4 * m then 'disk-hard-limit' when used >= 1.1 * m then 'disk-soft-limit' when queued > k and done > 0 then 'draining' when queued >= k then 'backpressure-active' else 'healthy' end as state from d, (select avg(used) as m, avg(queued)::double as k from d))
select month, state, lag(state) over (order by month) as before from s""")
def workload_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workload's state by month, with the one before; months are few, so one task may order them."""
    from pyspark.sql import Window

    months = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("used"), F.count("*").alias("queued"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    mean = months.agg(F.avg("used").cast("double").alias("m"), F.avg("queued").alias("k"))
    rows = months.join(F.broadcast(mean), F.lit(True)).withColumn("share", F.col("used").cast("double") / F.col("m"))
    state = situations.workload_state(F.col("share"), 1.1, 4, F.col("queued"), F.col("k"), F.col("done"))
    return rows.select("month", state.alias("state")).withColumn("before", F.lag("state").over(Window.orderBy("month")))


@query(f"""
with {REPORTS}, f as (select situation, family, min((at_, doc)) as first from reports group by all), a as (select situation, family, 'source_' || dense_rank() over (partition by situation order by first) as alias from f)
select doc, alias from reports join a using (situation, family)""")
def blinded_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports under aliases of their families."""
    return situations.blinded(reports(spark, sf_dir), "situation", "family", "at", "doc").select("doc", "alias")


@query(f"""
with {REPORTS}, a as (select doc, 'ready' as lane, 1 as l, row_number() over (order by price desc, doc) as k from reports where status = 'deleted'),
b as (select doc, 'oldest' as lane, 2 as l, row_number() over (order by at_, doc) as k from reports where doc not in (select doc from a where k <= 20)),
c as (select doc, 'recent' as lane, 3 as l, row_number() over (order by at_ desc, doc) as k from reports where doc not in (select doc from a where k <= 20) and doc not in (select doc from b where k <= 15))
select doc, lane from (select * from a where k <= 20 union all select * from b where k <= 15 union all select * from c where k <= 25)""")
def lane_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty reports: the dearest of those that are ready, the oldest, the newest."""
    lanes = [("ready", F.col("status") == "deleted", [F.desc("price")], 20), ("oldest", F.lit(True), ["at"], 15), ("recent", F.lit(True), [F.desc("at")], 25)]
    return situations.reserved_lanes(reports(spark, sf_dir), lanes, "doc", 60).select("doc", "lane")


@query("""
select c_custkey, count(o_orderkey) > 0 as has_orders, count(o_orderkey) filter (o_orderstatus = 'P') > 0 as has_open, case when count(o_orderkey) = 0 then 'zero' when count(o_orderkey) = 1 then 'one' else 'multiple' end as bucket, count(distinct case when o_orderstatus = 'F' then o_orderpriority end) as finished_kinds, count(distinct o_orderpriority) as kinds,
 coalesce(string_agg(distinct o_orderpriority, ',' order by o_orderpriority), '') as priorities from customer left join orders on o_custkey = c_custkey group by c_custkey""")
def exists_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence, buckets of counts, conditional distinct counts and lists, from one aggregate before the join."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("open"), F.count_distinct(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("fk"), F.count_distinct("o_orderpriority").alias("k"), F.array_join(F.sort_array(F.collect_set("o_orderpriority")), ",").alias("p"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left")
    n = F.coalesce("n", F.lit(0))
    return rows.select("c_custkey", (n > 0).alias("has_orders"), (F.coalesce("open", F.lit(0)) > 0).alias("has_open"), F.when(n == 0, "zero").when(n == 1, "one").otherwise("multiple").alias("bucket"), F.coalesce("fk", F.lit(0)).alias("finished_kinds"), F.coalesce("k", F.lit(0)).alias("kinds"), F.coalesce("p", F.lit("")).alias("priorities"))


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 400000) and c_name like 'Customer#00%' and c_mktsegment not in ('BUILDING', 'MACHINERY')")
def hidden_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NOT IN, LIKE with a prefix, and kinds that every factual query leaves out."""
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    found = table(spark, sf_dir, "customer").where(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & F.col("c_name").ilike("customer#00%"))
    return found.join(big, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("select event_id, (props ->> '$.k')::int as k from events where coalesce((props ->> '$.k')::int, 0) >= 50 and ts <= timestamp '2024-01-20' and (value < 50 or value is null)")
def json_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate on a JSON path, a cutoff, and a value that may be unknown."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").where((F.coalesce(k, F.lit(0)) >= 50) & (F.col("ts") <= F.lit("2024-01-20").cast("timestamp_ntz")) & ((F.col("value") < 50) | F.col("value").isNull()))
    return rows.select("event_id", k.alias("k"))


GENERIC = ", ".join(f"'{w}'" for w in sorted({*items.GENERIC, *items.FEATURE_STOP}))


@query(rf"""
with p as (select doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', 'x', 'g'), '\b(?:[A-Z][A-Za-z0-9.''-]+(?:\s+|$)){{1,4}}'), lambda x: regexp_replace(regexp_replace(lower(x), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')), lambda k: length(k) > 2 and k not in ({GENERIC}) and len(list_filter(string_split(k, '-'), lambda w: w not in ({GENERIC}))) > 0)) as keys,
 list_distinct(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{{3,}}'), lambda w: w not in ({", ".join(f"'{w}'" for w in items.FEATURE_STOP)}))) as tokens from documents)
select doc_id, len(keys) as names, array_to_string(list_sort(keys)[1:3], ' ') as first_names, len(tokens) as tokens, sha256(array_to_string(list_sort(tokens), ' ')) as title_key from p""")
def doc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and tokens of texts: how many, the first three names, a key of all tokens.  For names, letters outside ASCII count as x: engines differ on where words end beside them."""
    t = F.col("text")
    rows = table(spark, sf_dir, "documents").select("doc_id", items.named_phrases(F.regexp_replace(t, r"[^\x00-\x7F]", "x")).alias("keys"), items.feature_tokens(t).alias("tokens"))
    return rows.select("doc_id", F.size("keys").cast("long").alias("names"), F.array_join(F.slice(F.sort_array("keys"), 1, 3), " ").alias("first_names"), F.size("tokens").cast("long").alias("tokens"), F.sha2(F.array_join(F.sort_array("tokens"), " "), 256).alias("title_key"))


KINDS = {"ECONOMY": "earthquake", "STANDARD": "flood report", "PROMO": "news", "SMALL": "market", "MEDIUM": "battle", "LARGE": "fire"}
PARTS = f"""o as (select p_partkey as id, string_split(lower(p_name), ' ') as tokens, [p_brand] as entities, timestamp '2024-01-01' + to_hours((p_partkey * 37 % 1500)::int) as at_, {LAT.format(k="(p_partkey // 3)")} as lat, {LON.format(k="(p_partkey // 3)")} as lon,
 {case({k: f"'{v}'" for k, v in KINDS.items()}, "p_type")} as category, p_partkey // 40 as block, p_size % 7 as ref from part),
f as (select *, case when category in ('earthquake', 'flood report', 'fire') then 'hazard' when category = 'battle' then 'conflict' when category = 'news' then 'news' else coalesce(category, 'general') end as family, case when id % 17 = 0 then null else lat end as la, case when id % 17 = 0 then null else lon end as lo from o)"""


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as observations: words of the name, the brand as a name, a kind by type; every seventeenth has no place."""
    rows = located(table(spark, sf_dir, "part").withColumn("spot", F.floor(F.col("p_partkey") / 3)), "spot")
    known = F.col("p_partkey") % 17 != 0
    rows = rows.select(F.col("p_partkey").alias("id"), F.array_distinct(F.split(F.lower("p_name"), " ")).alias("tokens"), F.array("p_brand").alias("entities"), (F.lit("2024-01-01").cast("timestamp") + F.expr("make_dt_interval(0, cast(p_partkey * 37 % 1500 as int))")).alias("at"),
        F.when(known, F.col("lat")).alias("lat"), F.when(known, F.col("lon")).alias("lon"), items.lookup(KINDS, F.col("p_type")).alias("category"), F.floor(F.col("p_partkey") / 40).alias("block"), (F.col("p_size") % 7).cast("string").alias("ref"))
    return rows.withColumns({"family": items.category_family(F.col("category")), "identifiers": F.create_map(F.lit("src:ref"), F.col("ref"))})


@query(f"""
with {PARTS}, p as (select a.id as a, b.id as b, abs(epoch_us(a.at_) - epoch_us(b.at_)) / 3.6e9 as hours, a.family as fa, b.family as fb, a.category as ca, a.ref as ra, b.ref as rb,
 len(list_intersect(list_distinct(a.tokens), list_distinct(b.tokens))) / len(list_distinct(list_concat(a.tokens, b.tokens))) as lexical, len(list_intersect(a.entities, b.entities)) / len(list_distinct(list_concat(a.entities, b.entities))) as names, {KM.replace("a.lat", "a.la").replace("b.lat", "b.la").replace("a.lon", "a.lo").replace("b.lon", "b.lo")} as d, a.la is null or b.la is null as nowhere
 from f a join f b on a.block = b.block and a.id <> b.id and b.at_ between a.at_ - interval 14 days and a.at_ + interval 1 day),
s as (select *, case when nowhere then null else d end as km from p),
v as (select *, fa = fb or (fa = 'news' and fb in ('conflict', 'emergency', 'hazard', 'health')) or (fb = 'news' and fa in ('conflict', 'emergency', 'hazard', 'health')) as fits, case fa when 'hazard' then 250 when 'conflict' then 300 when 'emergency' then 500 else 1000 end as far from s),
w as (select a, b, round(least(1, 0.27 * lexical + 0.20 * greatest(0, 1 - hours / 336) + 0.22 * case when km is null then 0.35 else greatest(0, 1 - km / 750) end + 0.11 * names + 0.10 * case when fa = fb then 1 else 0.65 end + 0.10 * case when ra = rb and rb <> 0 then 1 else 0 end + case when km <= 50 then 0.08 else 0 end), 4) as score,
 not fits or hours > 336 or coalesce(km > far, false) or (ca = 'earthquake' and (hours > 6 or coalesce(km > 75, false))) or (ra <> rb and (rb <> 0)) as vetoed from v),
best as (select a, max(score) filter (not vetoed) as score, arg_min(b, (-score, b)) filter (not vetoed) as event from w group by a)
select a as observation, case when score >= 0.65 then event end as event, score, case when score >= 0.82 then 'link' when score >= 0.65 then 'review' else 'separate' end as decision from best""")
def event_fusion_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation's best event without a veto, among those of its block in the two weeks before it and a day after.  Events with reference 0 have no identifiers."""
    found = observations(spark, sf_dir)
    lists = F.create_map(F.lit("src:ref"), F.when(F.col("ref") == "0", F.array().cast("array<string>")).otherwise(F.array("ref")))
    pairs = fusion.candidates(found, found.withColumn("identifiers", lists), "block", "at").where("a.id <> b.id")
    return fusion.decisions(fusion.event_score(pairs))


@query(f"""
with {REPORTS}, c as (select situation, doc, publisher, at_, {LAT.format(k="(doc // 8)")} as lat, {LON.format(k="(doc // 8)")} as lon from reports)
select situation, count(*) as documents, count(distinct publisher) as publishers, round(max({KM.replace("a.", "c.").replace("b.lat", "m.lat").replace("b.lon", "m.lon")}), 2) as spread_km from c join (select situation, min(lat) as lat, min(lon) as lon from c group by situation) m using (situation) group by situation""")
def situation_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far a situation's reports lie from its south-west corner."""
    rows = located(reports(spark, sf_dir).withColumn("spot", F.floor(F.col("doc") / 8)), "spot")
    corner = rows.groupBy("situation").agg(F.min("lat").alias("lat0"), F.min("lon").alias("lon0"))
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    return rows.join(corner, "situation").groupBy("situation").agg(F.count("*").alias("documents"), F.count_distinct("publisher").alias("publishers"), F.round(F.max(km), 2).alias("spread_km"))
