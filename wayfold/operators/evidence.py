"""Claims and those who make them: independent families, confidence, truth, reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import clamp


def noisy_or(evidence: DataFrame, claim: list[str], family: str, weight: str, factor: float = 0.78, cap: float = 1.0, low: float = 0.05, high: float = 0.99) -> DataFrame:
    """n_families and confidence of each claim: a family counts by its strongest evidence, families as independent.

    1 - product(1 - min(cap, factor * weight)), clamped to [low, high].
    """
    each = evidence.groupBy(*claim, family).agg(F.max(weight).alias("_w"))
    found = each.groupBy(*claim).agg(F.count("*").alias("n_families"), F.product(1 - F.least(F.lit(cap), factor * F.col("_w"))).alias("_p"))
    return found.select(*claim, "n_families", clamp(1 - F.col("_p"), low, high).alias("confidence"))


def contradictions(evidence: DataFrame, situation: str, family: str, obj: str, at: str) -> DataFrame:
    """Pairs of evidence on a situation where a later one of another family names another object: situation, family, contradicted_by, n.

    Evidence that is alike in family, object and time is counted before it is paired.
    """
    counted = evidence.groupBy(situation, F.col(family).alias("family"), F.col(obj).alias("_o"), F.col(at).alias("_t")).agg(F.count("*").alias("_n"))
    later = counted.select(situation, F.col("family").alias("contradicted_by"), F.col("_o").alias("_o2"), F.col("_t").alias("_t2"), F.col("_n").alias("_n2"))
    pairs = counted.join(later, situation).where("family <> contradicted_by and _o <> _o2 and _t2 > _t")
    return pairs.groupBy(situation, "family", "contradicted_by").agg(F.sum(F.col("_n") * F.col("_n2")).alias("n"))


def truth_status(claims: DataFrame, situation: str, obj: str, digits: int = 4) -> DataFrame:
    """Claims (situation, obj, n_families, base, authoritative, factual) with truth and confidence; claims of one situation on different objects are contrary.

    A factual claim is corroborated by two families or an authority, else
    unverified.  A contrary claim as strong as max(0.7, base) refutes it and
    gives its confidence; a weaker one makes a corroborated claim disputed,
    0.65 at most, and leaves an unverified one as it is.  What isn't factual
    and has two families is disputed with a contrary claim, else indeterminate,
    0.55 at most.  Confidence has so many digits.
    """
    group = Window.partitionBy(situation)
    rows = claims.withColumn("_1", F.max(F.struct("base", obj)).over(group))
    rows = rows.withColumn("_2", F.max(F.when(F.col(obj) != F.col(f"_1.{obj}"), F.col("base"))).over(group))
    other = F.when(F.col(obj) == F.col(f"_1.{obj}"), F.col("_2")).otherwise(F.col("_1.base"))
    rated = rows.select(situation, obj, "n_families", "base", "factual", other.alias("_c"), (F.col("factual") & (F.col("authoritative") | (F.col("n_families") >= 2))).alias("_sure"))
    refuted = F.coalesce(F.col("_c") >= F.greatest(F.lit(0.7), F.col("base")), F.lit(False))
    contrary = F.col("_c").isNotNull()
    soft = ~F.col("factual") & (F.col("n_families") >= 2)
    status = F.when(soft, F.when(contrary, "disputed").otherwise("indeterminate")).when(refuted, "refuted").when(F.col("_sure"), F.when(contrary, "disputed").otherwise("corroborated")).otherwise("unverified")
    value = F.when(refuted, F.col("_c")).when(F.col("_sure") & contrary, F.least(F.lit(0.65), F.col("base"))).otherwise(F.col("base"))
    value = F.when(soft, F.least(F.lit(0.55), value)).otherwise(value)
    return rated.select(situation, obj, "n_families", status.alias("truth"), F.round(clamp(value, 0.0, 0.99), digits).alias("confidence"))


def contested(claims: DataFrame, key: list[str], obj: str, family: str, at: str) -> DataFrame:
    """Single-valued predicates with several objects: contested with two families or more, else all but the newest object are superseded; else stands."""
    group = Window.partitionBy(*key)
    each = claims.groupBy(*key, obj).agg(F.max(at).alias("_at"), F.min(family).alias("_least"), F.max(family).alias("_most"))
    wide = each.select("*", F.min("_least").over(group).alias("_f"), F.max("_most").over(group).alias("_g"), F.count("*").over(group).alias("_o"), F.max(F.struct("_at", obj)).over(group).alias("_new"))
    state = F.when(F.col("_o") < 2, "stands").when(F.col("_f") != F.col("_g"), "contested").when(F.col(obj) == F.col(f"_new.{obj}"), "stands").otherwise("superseded")
    return wide.select(*key, obj, state.alias("state"))


def beta_posterior(outcomes: DataFrame, publisher: str, topic: str, prior: Column, strength: float = 8.0, harm: float = 1.5, reach: float = 0.15, mature: int = 12) -> DataFrame:
    """Reliability of publishers overall and by topic in one pass: grouping sets (publisher) and (publisher, topic).

    outcomes has an outcome (confirmed, refuted or other) a row.  The mean of a
    Beta posterior around the prior may move reach from it; until mature
    outcomes are in, and none refuted, the prior stands.
    """
    a, b = F.count_if(F.col("outcome") == "confirmed"), F.count_if(F.col("outcome") == "refuted")
    sets = outcomes.groupingSets([[F.col(publisher)], [F.col(publisher), F.col(topic)]], publisher, topic)
    counted = sets.agg(F.count("*").alias("n"), a.alias("confirmed"), b.alias("refuted"))
    alpha, beta = prior * strength + F.col("confirmed"), (1 - prior) * strength + harm * F.col("refuted")
    mean = F.greatest(prior - reach, F.least(prior + reach, alpha / (alpha + beta)))
    status = F.when(F.col("n") >= mature, "mature").when(F.col("refuted") > 0, "contradiction-responsive").otherwise("provisional")
    value = F.when(status == "provisional", prior).otherwise(mean)
    return counted.select(publisher, F.coalesce(topic, F.lit("*")).alias(topic), "n", "confirmed", "refuted", status.alias("status"), value.alias("reliability"))


def laplace(good: Column, bad: Column) -> Column:
    """Share of good with one of each added."""
    return (good + 1) / (good + bad + 2)
