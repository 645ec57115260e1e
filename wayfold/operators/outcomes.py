"""What became of reports, and what publishers earn by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.items import report_tokens
from ..functions.measures import overlap
from ..session import written
from .families import met
from .fusion import SINGLE_VALUED


def relations(claims: DataFrame, situation: str, ident: str, predicate: str, value: str) -> DataFrame:
    """Pairs of claims of a situation and predicate, left < right: supports (0.95) for equal values, contradicts (0.85) for different values of a predicate of which one holds at a time.

    single (boolean) in claims says which predicates those are.  Claims with one
    value are joined in a star around the smallest ident, so copies cost no
    square: supports stand between the smallest and each other, contradictions
    between the smallest of two values.  opposition() says for every claim whose
    group that is.
    """
    key = [situation, predicate]
    first = F.min(ident).over(Window.partitionBy(*key, value))
    starred = claims.withColumn("_first", first)
    supports = starred.where(F.col(ident) != F.col("_first")).select(situation, F.col("_first").alias("left_id"), F.col(ident).alias("right_id"), F.lit("supports").alias("relationship"), F.lit(0.95).alias("confidence"))
    heads = starred.where((F.col(ident) == F.col("_first")) & F.col("single"))
    other = heads.select(*key, F.col(ident).alias("_r"), F.col(value).alias("_v"))
    against = heads.join(other, key).where((F.col(value) != F.col("_v")) & (F.col(ident) < F.col("_r")))
    return supports.union(against.select(situation, F.col(ident).alias("left_id"), F.col("_r").alias("right_id"), F.lit("contradicts").alias("relationship"), F.lit(0.85).alias("confidence")))


def opposition(claims: DataFrame, situation: str, ident: str, predicate: str, value: str) -> DataFrame:
    """Every claim with the group that stands for it in relations() and with what contradicts it: ident, first_id, equal, contrary, contrary_id.

    first_id is the smallest ident of the claims with its value, equal their
    number; contrary counts the claims of other values where one value holds at
    a time (single), and contrary_id is the smallest of those.  Each value is
    one row before values of a predicate meet; a value's claims are dealt to
    parts.  A null situation, predicate or value is its own group with nobody.
    """
    key = [situation, predicate]
    # Written, as both are read twice: claims come from joins, and values tell besides which of them have very many claims.
    claims = written(claims.select(ident, *key, value, "single"), "claims")
    values = claims.groupBy(*key, value).agg(F.min(ident).alias("first_id"), F.count("*").alias("equal"), F.max("single").alias("_one"))
    group = Window.partitionBy(*key)
    values = values.withColumns({"_all": F.sum("equal").over(group), "_low": F.min(F.struct("first_id", value)).over(group)})
    values = values.withColumn("_next", F.min(F.when(F.col(value) != F.col(f"_low.{value}"), F.col("first_id"))).over(group))
    contrary = F.when(F.col("_one"), F.col("_all") - F.col("equal")).otherwise(F.lit(0).cast("long"))
    other = F.when(F.col("_one"), F.when(F.col(value) == F.col(f"_low.{value}"), F.col("_next")).otherwise(F.col("_low.first_id")))
    values = values.select(*key, value, "first_id", "equal", contrary.alias("contrary"), other.alias("contrary_id"))
    values = written(values, "values")
    found = met(claims.select(ident, *key, value), [*key, value], values, ident, values.withColumn("n", F.col("equal")))
    alone = F.col("first_id").isNull()
    return found.select(ident, F.coalesce("first_id", ident).alias("first_id"), F.when(alone, 1).otherwise(F.col("equal")).cast("long").alias("equal"), F.coalesce("contrary", F.lit(0)).cast("long").alias("contrary"), "contrary_id")


def both_ways(pairs: DataFrame, left: str = "left_id", right: str = "right_id") -> DataFrame:
    """Undirected links as id and other, each in both directions."""
    return pairs.select(F.col(left).alias("id"), F.col(right).alias("other")).union(pairs.select(F.col(right).alias("id"), F.col(left).alias("other")))


def corroborators(docs: DataFrame, floor: float = 0.6, alike: float = 0.42) -> DataFrame:
    """Reports with later ones of other publishers in the same situation that match: doc, other, other_publisher, other_at, credibility.

    docs: doc, situation, publisher, at, status, credibility, tokens, claims
    (arrays: words of the text, and keys of specific claims).  A later report
    matches by a shared specific claim or by its words.  Only active ones with
    enough credibility count; a null time or publisher matches nothing.
    """
    left = docs.select("situation", "doc", "publisher", "at", "tokens", "claims")
    right = docs.where((F.col("status") == "active") & (F.col("credibility") >= floor))
    right = right.select("situation", F.col("doc").alias("other"), F.col("publisher").alias("other_publisher"), F.col("at").alias("other_at"), F.col("tokens").alias("_t"), F.col("claims").alias("_c"), "credibility")
    later = left.join(right, "situation").where("doc <> other and publisher <> other_publisher and other_at > at")
    same = F.arrays_overlap("claims", "_c") | (overlap(F.col("tokens"), F.col("_t")) >= alike)
    return later.where(same).select("doc", "publisher", "at", "other", "other_publisher", "other_at", "credibility")


def delayed_outcome(docs: DataFrame, corroborating: DataFrame, contradicting: DataFrame) -> DataFrame:
    """The outcome of each report that has one: contradicted before confirmed before deleted_unverified; doc, publisher, outcome, confidence, was_early.

    contradicting: doc and credibility of later contrary reports.  Confirmed by
    two publishers or by one of 0.95 credibility; early if the first came five
    minutes after it or later.
    """
    against = contradicting.groupBy("doc").agg(F.max("credibility").alias("_against"))
    backing = corroborating.groupBy("doc").agg(F.count_distinct("other_publisher").alias("_n"), F.max(F.col("credibility") >= 0.95).alias("_sure"), F.min("other_at").alias("_first"))
    rows = docs.select("doc", "publisher", "at", "status").join(against, "doc", "left").join(backing, "doc", "left")
    confirmed = (F.col("_n") >= 2) | F.col("_sure")
    outcome = F.when(F.col("_against").isNotNull(), "contradicted").when(confirmed, "confirmed").when(F.col("status") == "deleted", "deleted_unverified")
    confidence = F.when(F.col("outcome") == "contradicted", F.least(F.lit(0.98), "_against")).when(F.col("outcome") == "confirmed", F.least(F.lit(0.98), 0.62 + 0.10 * F.least(F.lit(3), "_n") + 0.12 * F.col("_sure").cast("int"))).otherwise(0.35)
    early = (F.col("outcome") == "confirmed") & ((F.unix_micros(F.col("_first").cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))) >= 300_000_000)
    return rows.withColumn("outcome", outcome).where("outcome is not null").select("doc", "publisher", "outcome", confidence.alias("confidence"), early.alias("was_early"))


def reputation(outcomes: DataFrame, before: DataFrame, strength: float = 12.0, mature: int = 12, most: float = 0.03) -> DataFrame:
    """Publishers' credibility after outcomes, one step from what it was: publisher, counts, learned, lower, upper.

    before: publisher, baseline, learned, evaluated.  A Beta posterior around the
    baseline, in which contradictions count 1.75 and deletions 0.25 times, is
    the target; credibility moves towards it by most times the square root of
    the number of new outcomes.  Until enough outcomes are in, and none is
    negative, the baseline stands.  Publishers without outcomes stay as they are.
    """
    is_ = lambda name: F.col("outcome") == name
    weight = lambda w: F.sum(F.when(~is_("confirmed"), F.col("confidence") * F.when(is_("contradicted"), w).otherwise(0.25)).otherwise(0.0))
    found = outcomes.groupBy("publisher").agg(
        F.count("*").alias("n"), F.count_if(is_("confirmed")).alias("confirmed"), F.count_if(is_("contradicted")).alias("contradicted"), F.count_if(is_("deleted_unverified")).alias("deleted"),
        F.count_if(is_("confirmed") & F.col("was_early")).alias("early"), F.sum(F.when(is_("confirmed"), F.col("confidence")).otherwise(0.0)).alias("_good"), weight(1.75).alias("_bad"))
    rows = before.join(found, "publisher", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumns({"_a": F.col("baseline") * strength + F.coalesce("_good", F.lit(0.0)), "_b": (1 - F.col("baseline")) * strength + F.coalesce("_bad", F.lit(0.0))})
    rows = rows.withColumn("_t", F.col("_a") + F.col("_b")).withColumn("_target", F.col("_a") / F.col("_t")).withColumn("_d", F.sqrt(F.col("_a") * F.col("_b") / (F.col("_t") * F.col("_t") * (F.col("_t") + 1))))
    locked = (F.col("n") < mature) & (F.col("contradicted") + F.col("deleted") == 0)
    reach = most * F.sqrt(F.greatest(F.lit(1), F.col("n") - F.col("evaluated")))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("learned") + F.greatest(-reach, F.least(reach, F.col("_target") - F.col("learned")))))
    learned = F.when(F.col("n") == 0, F.col("learned")).when(locked, F.col("baseline")).when(F.col("n") != F.col("evaluated"), moved).otherwise(F.col("learned"))
    bound = lambda sign: F.when(F.col("n") == 0, F.col("baseline") + 0.25 * sign).when(locked, F.col("baseline") + 0.25 * sign).otherwise(F.col("_target") + 1.64 * sign * F.col("_d"))
    cut = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 4)
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "confirmed", "contradicted", "deleted", "early")]
    return rows.select("publisher", *counts, F.round(learned, 4).alias("learned"), cut(bound(-1)).alias("lower"), cut(bound(1)).alias("upper"))


def claim_outcomes(evidence: DataFrame, claim: str, family: str, publisher: str) -> DataFrame:
    """Publishers of claims with a status (corroborated or refuted): claim, publisher, outcome, others (families but its own), weight 0.55.

    A corroborated claim counts for a publisher only with another family behind
    it (leave one family out).  One row for each claim and publisher.
    """
    rows = evidence.where(F.col("status").isin("corroborated", "refuted")).groupBy(claim, publisher, family, "status").agg(F.count("*").alias("_n"))
    families = rows.groupBy(claim).agg(F.count_distinct(family).alias("_f"))
    joined = rows.join(families, claim).groupBy(claim, publisher, "status").agg(F.max(F.col("_f") - 1).alias("others"))
    outcome = F.when(F.col("status") == "corroborated", "confirmed").otherwise("refuted")
    return joined.where("status = 'refuted' or others > 0").select(claim, publisher, outcome.alias("outcome"), "others", F.lit(0.55).alias("weight"))


def single_valued(predicate) -> F.Column:
    return predicate.isin(SINGLE_VALUED)
