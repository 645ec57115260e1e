"""Queries on claims, publishers, clusters, hypotheses and forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measures import clamp, cosine, pooled
from ..operators import evidence, forecasts, pairs
from .registry import query, table


def six_digits(column: str) -> Column:
    """A value to six digits; the odd offset keeps cut points away from short decimal fractions, whose last bits differ between engines."""
    return F.floor(F.col(column) * 1e6 + 0.31415926) / 1e6


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as evidence: an order's return flag is a claim, the supplier its family, five times the discount its weight."""
    weight = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("l_discount") * 5))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_suppkey", "l_shipdate", "l_linenumber", weight.alias("weight"))


@query("""
with w as (select l_orderkey, l_returnflag, l_suppkey, max(greatest(0, least(1, l_discount * 5))) as w from lineitem group by all)
select l_orderkey, l_returnflag, count(*) as n_families, floor(greatest(0.05, least(0.99, 1 - product(1 - least(1, 0.78 * w)))) * 1e6 + 0.31415926) / 1e6 as confidence from w group by all""")
def claim_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent families behind each claim and the confidence that they give it."""
    found = evidence.noisy_or(claims(spark, sf_dir), ["l_orderkey", "l_returnflag"], "l_suppkey", "weight")
    return found.select("l_orderkey", "l_returnflag", "n_families", six_digits("confidence").alias("confidence"))


@query("""
select a.l_orderkey, a.l_suppkey as family, b.l_suppkey as contradicted_by, count(*) as n from lineitem a join lineitem b
on a.l_orderkey = b.l_orderkey and a.l_suppkey <> b.l_suppkey and a.l_returnflag <> b.l_returnflag and b.l_shipdate > a.l_shipdate group by all""")
def claim_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.contradictions(claims(spark, sf_dir), "l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate")


@query("""
with o as (select l_orderkey, l_returnflag, max(l_shipdate) as shipped from lineitem group by all),
g as (select l_orderkey, count(distinct l_suppkey) as f, count(distinct l_returnflag) as n from lineitem group by all),
w as (select l_orderkey, arg_max(l_returnflag, (shipped, l_returnflag)) as newest from o group by all)
select l_orderkey, l_returnflag, case when n < 2 then 'stands' when f >= 2 then 'contested' when l_returnflag = newest then 'stands' else 'superseded' end as state from o join g using (l_orderkey) join w using (l_orderkey)""")
def claim_contested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.contested(claims(spark, sf_dir), ["l_orderkey"], "l_returnflag", "l_suppkey", "l_shipdate")


TRUTH = """
with w as (select l_orderkey, l_returnflag, s_nationkey, max(greatest(0, least(1, l_discount * 5))) as w from lineitem join supplier on l_suppkey = s_suppkey group by all),
b as (select l_orderkey, l_returnflag, count(*) as n_families, floor(least(0.98, 1 - product(1 - least(0.95, 0.75 * w))) * 1e6 + 0.31415926) / 1e6 as base from w group by all)"""


@query(
    TRUTH
    + """,
c as (select a.*, l_returnflag <> 'N' as factual, (select max(x.base) from b x where x.l_orderkey = a.l_orderkey and x.l_returnflag <> a.l_returnflag) as other from b a),
d as (select *, coalesce(other >= greatest(0.7, base), false) as beaten, factual and n_families >= 2 as sure, not factual and n_families >= 2 as soft from c)
select l_orderkey, l_returnflag, n_families,
 case when soft then case when other is null then 'indeterminate' else 'disputed' end when beaten then 'refuted' when sure then case when other is null then 'corroborated' else 'disputed' end else 'unverified' end as truth,
 round(least(case when soft then 0.55 else 0.99 end, case when beaten then other when sure and other is not null then least(0.65, base) else base end), 6) as confidence from d"""
)
def truth_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' nations are the families; claims that nothing came back are taken for interpretations."""
    nations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    found = evidence.noisy_or(claims(spark, sf_dir).join(nations, "l_suppkey"), ["l_orderkey", "l_returnflag"], "s_nationkey", "weight", 0.75, 0.95, 0.0, 0.98)
    rated = found.select("l_orderkey", "l_returnflag", "n_families", six_digits("confidence").alias("base"), F.lit(False).alias("authoritative"), (F.col("l_returnflag") != "N").alias("factual"))
    return evidence.truth_status(rated, "l_orderkey", "l_returnflag", 6)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as outcomes: toxic is refuted, else good quality confirmed, else mixed; source is the publisher, language the topic."""
    outcome = F.when(F.col("toxic") == 1, "refuted").when(F.col("quality") == 1, "confirmed").otherwise("mixed")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "source", "lang", "n_chars", "quality", outcome.alias("outcome"))


OUTCOMES = "o as (select d.source, d.lang, d.n_chars, quality, case when toxic = 1 then 'refuted' when quality = 1 then 'confirmed' else 'mixed' end as outcome from labels join documents d using (doc_id))"


@query(f"""
with {OUTCOMES}, c as (select source, coalesce(lang, '*') as lang, count(*) as n, count(*) filter (outcome = 'confirmed') as confirmed, count(*) filter (outcome = 'refuted') as refuted from o group by grouping sets ((source), (source, lang)))
select *, case when n >= 12 then 'mature' when refuted > 0 then 'contradiction-responsive' else 'provisional' end as status,
 round(case when n < 12 and refuted = 0 then 0.7 else greatest(0.55, least(0.85, (0.7 * 8 + confirmed) / (8 + confirmed + 1.5 * refuted))) end, 6) as reliability from c""")
def publisher_beta_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.beta_posterior(outcomes(spark, sf_dir), "source", "lang", F.lit(0.7))
    return found.withColumn("reliability", F.round("reliability", 6))


@query(f"""
with {OUTCOMES}
select source, count(*) as n, round((count(*) filter (outcome = 'confirmed') + 1) / (count(*) filter (outcome <> 'mixed') + 2), 6) as accuracy,
 round((count(*) filter (n_chars >= 500) + 1) / (count(*) + 2), 6) as substance, round(count(*) filter (outcome = 'refuted') / count(*), 6) as refuted_share, count(distinct lang) as topics from o group by source""")
def epistemic_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = F.count_if(F.col("outcome") == "confirmed"), F.count_if(F.col("outcome") == "refuted")
    long = F.count_if(F.col("n_chars") >= 500)
    found = outcomes(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), evidence.laplace(good, bad).alias("accuracy"), evidence.laplace(long, F.count("*") - long).alias("substance"), (bad / F.count("*")).alias("refuted_share"), F.count_distinct("lang").alias("topics"))
    return found.select("source", "n", *[F.round(c, 6).alias(c) for c in ("accuracy", "substance", "refuted_share")], "topics")


def similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector against all others of its label."""
    rows = table(spark, sf_dir, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q"))
    return asked.join(rows, "label").where("query_id <> vec_id").select("query_id", "label", "vec_id", cosine(F.col("q"), F.col("embedding")).alias("similarity"))


SIMILAR = "s as (select a.vec_id as query_id, a.label, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id where a.vec_id % 100 = 0)"


@query("""
with s as (select a.vec_id as query_id, b.vec_id, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as similarity from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id)
select query_id, vec_id, similarity, rank from (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s) where rank <= 5""")
def embedding_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar others of its label for every vector."""
    rows = table(spark, sf_dir, "embeddings")
    return pairs.nearest_cosines(rows, rows, "vec_id", "label", "embedding", 5, 6)


@query(f"""
with {SIMILAR}, b as (select query_id, label, max(similarity) as best from s group by all)
select label, case when best >= 0.82 then 'link' when best >= 0.65 then 'review' else 'separate' end as decision, count(*) as n from b group by all""")
def cluster_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on every hundredth vector only, as its SQL asks for; cluster_decision_totals counts those on all."""
    return decisions(similar(spark, sf_dir).groupBy("query_id", "label").agg(F.max(F.round("similarity", 6)).alias("best")))


def decisions(best: DataFrame) -> DataFrame:
    """Counts of decisions for each label, by the similarity of the best match."""
    decision = F.when(F.col("best") >= 0.82, "link").when(F.col("best") >= 0.65, "review").otherwise("separate")
    return best.groupBy("label", decision.alias("decision")).agg(F.count("*").alias("n"))


@query("""
with b as (select a.vec_id, a.label, max(round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6)) as best from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id group by all)
select label, case when best >= 0.82 then 'link' when best >= 0.65 then 'review' else 'separate' end as decision, count(*) as n from b group by all""")
def cluster_decision_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on all vectors."""
    best = pairs.best_cosine(table(spark, sf_dir, "embeddings"), "vec_id", "label", "embedding")
    return decisions(best.withColumn("best", F.round("best", 6)))


# Hypotheses with their priors, and how an order's status bears on each.
HYPOTHESES = [("steady", 0.38), ("growing", 0.30), ("fading", 0.14), ("seasonal", 0.10), ("noise", 0.08)]
RATIOS = {"F": ("fading", 1.8), "O": ("growing", 1.7), "P": ("seasonal", 1.5)}


@query(
    "with h(hypothesis, prior) as (values "
    + ", ".join(f"('{h}', {p})" for h, p in HYPOTHESES)
    + "), r(status, hypothesis, ratio) as (values "
    + ", ".join(f"('{s}', '{h}', {r})" for s, (h, r) in RATIOS.items())
    + """),
e as (select o_custkey, hypothesis, sum(ln(greatest(0.125, least(8, ratio)))) as e, count(*) as n from orders join r on o_orderstatus = status group by all),
s as (select c_custkey, h.hypothesis, coalesce(n, 0) as n_evidence, ln(prior) + coalesce(e, 0) as s from customer cross join h left join e on o_custkey = c_custkey and e.hypothesis = h.hypothesis),
x as (select *, exp(s - max(s) over (partition by c_custkey)) as x from s),
p as (select *, greatest(0.03, x / sum(x) over (partition by c_custkey)) as p from x)
select c_custkey, hypothesis, n_evidence, round(p / sum(p) over (partition by c_custkey), 6) as posterior from p"""
)
def hypothesis_posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers are situations, the statuses of their orders evidence."""
    templates = F.array(*[F.struct(F.lit(h).alias("hypothesis"), F.lit(p).alias("prior")) for h, p in HYPOTHESES])
    priors = table(spark, sf_dir, "customer").select("c_custkey", F.inline(templates))
    hypothesis = F.create_map(*[F.lit(x) for s, (h, _) in RATIOS.items() for x in (s, h)])
    ratio = F.create_map(*[F.lit(x) for s, (_, r) in RATIOS.items() for x in (s, r)])
    ratios = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), hypothesis[F.col("o_orderstatus")].alias("hypothesis"), ratio[F.col("o_orderstatus")].alias("ratio")).where("hypothesis is not null")
    found = forecasts.posteriors(priors, ratios, "c_custkey", "hypothesis")
    return found.withColumn("posterior", F.round("posterior", 6))


@query("""
select coalesce(o_orderpriority, '*') as o_orderpriority, coalesce(c_mktsegment, '*') as c_mktsegment, count(*) as n, count(*) filter (o_orderstatus = 'F') as successes, round((count(*) filter (o_orderstatus = 'F') + 1) / (count(*) + 2), 6) as rate
from orders join customer on o_custkey = c_custkey group by rollup (o_orderpriority, c_mktsegment)""")
def base_rate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    found = forecasts.base_rates(joined, ["o_orderpriority", "c_mktsegment"], F.col("o_orderstatus") == "F")
    return found.withColumn("rate", F.round("rate", 6))


@query("""
with f as (select least(0.95, greatest(0.05, n_chars / 4000)) as p, quality::double as y from labels join documents using (doc_id)),
b as (select least(9, floor(p * 10)) as bin, count(*) as n, sum(power(p - y, 2)) as sq, sum(-(y * ln(p) + (1 - y) * ln(1 - p))) as loss, sum(p) as sp, sum(y) as sy from f group by all)
select sum(n)::bigint as n, round(sum(sq) / sum(n), 6) as brier, round(sum(loss) / sum(n), 6) as log_loss, round(sum(abs(sp - sy)) / sum(n), 6) as ece from b""")
def calibration_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good quality as forecast by length."""
    rows = outcomes(spark, sf_dir).select(clamp(F.col("n_chars") / 4000, 0.05, 0.95).alias("p"), F.col("quality").cast("double").alias("y"))
    found = forecasts.calibration(rows, "p", "y")
    return found.select("n", *[F.round(c, 6).alias(c) for c in ("brier", "log_loss", "ece")])


@query("""
with p as (select o_orderkey, least(0.95, greatest(0.05, o_totalprice / 500000)) as a, case when o_orderpriority < '3' then 0.7 end as b, 0.4 as c from orders),
l as (select o_orderkey, 0.5 * ln(a / (1 - a)) + coalesce(0.3 * ln(b / (1 - b)), 0) + 0.2 * ln(c / (1 - c)) as s, 0.7 + case when b is null then 0 else 0.3 end as w from p)
select o_orderkey, round(greatest(0.05, least(0.95, 1 / (1 + exp(-s / w)))), 6) as probability from l""")
def ensemble_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three component forecasts of an order pooled by log odds; one of them is missing for some."""
    orders = table(spark, sf_dir, "orders")
    parts = [(F.col("o_totalprice") / 500000, 0.5), (F.when(F.col("o_orderpriority") < "3", 0.7), 0.3), (F.lit(0.4), 0.2)]
    return orders.select("o_orderkey", F.round(pooled(parts), 6).alias("probability"))
