"""Situations through their life: refresh, priority, expiry, integrity, gaps, identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days after which transient categories expire.
CLOSED = ["expired", "archived", "resolved"]
UNCERTAIN = ["unverified", "disputed", "indeterminate"]


def merged_claims(evidence: DataFrame, key: list[str], at: str, weight: str) -> DataFrame:
    """Claims by their natural key: first_seen, last_seen, evidence, weight (largest, within 0 and 1)."""
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(weight)))
    return evidence.groupBy(*key).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count("*").alias("evidence"), F.max(clamped).alias("weight"))


def best_claims(claims: DataFrame, document: str, key: list[str], confidence: str, order: list[str], most: int) -> DataFrame:
    """Of a document's claims with one key the most confident; so many a document, most confident first."""
    one = Window.partitionBy(document, *key).orderBy(F.desc(confidence), *order)
    ranked = claims.withColumn("_r", F.row_number().over(one)).where("_r = 1")
    rank = F.row_number().over(Window.partitionBy(document).orderBy(F.desc(confidence), *order))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= most).drop("_r")


def refreshed(claims: DataFrame, families: DataFrame, situation: str) -> DataFrame:
    """Status and confidence of situations: mean confidence of claims that aren't superseded, plus 0.04 for each family beyond the first (0.12 at most); resolved if closed, contested, else active.

    claims: confidence, status, closed (boolean); families: situation, n_families.
    """
    stands = F.col("status") != "superseded"
    found = claims.groupBy(situation).agg(
        F.avg(F.when(stands, F.col("confidence"))).alias("_base"), F.count_if(stands).alias("claims"), F.count_if(F.col("status") == "contested").alias("contested"), F.max(F.col("closed") & (F.col("status") == "active")).alias("_closed"))
    joined = found.join(families, situation)
    bonus = F.least(F.lit(0.12), F.greatest(F.lit(0), F.col("n_families") - 1) * 0.04)
    status = F.when(F.col("_closed"), "resolved").when(F.col("contested") > 0, "contested").otherwise("active")
    return joined.select(situation, "claims", "contested", "n_families", status.alias("status"), F.round(F.least(F.lit(0.99), F.coalesce("_base", F.lit(0.0)) + bonus), 4).alias("confidence"))


def lifecycle(situations: DataFrame, forecasts: DataFrame, contested: DataFrame, now: Column, ttl: dict[str, int], archive: dict[str, int], ident: str) -> DataFrame:
    """Situations with their status after maintenance: transient ones expire after their category's days, quiet ones of one publisher are archived; never with an active forecast, nor archived while contested.

    situations: ident, category, status, last_seen, publishers; forecasts and contested: ident.
    """
    kept = situations.join(forecasts.select(ident).distinct().withColumn("_f", F.lit(True)), ident, "left").join(contested.select(ident).distinct().withColumn("_c", F.lit(True)), ident, "left")
    days = (F.unix_micros(now) - F.unix_micros("last_seen")) / 86_400e6
    of = lambda table: F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col("category"))
    free = ~F.col("status").isin(CLOSED) & F.col("_f").isNull()
    status = F.when(free & (days > of(ttl)), "expired").when(free & F.col("_c").isNull() & (F.col("publishers") <= 1) & (days > of(archive)), "archived").otherwise(F.col("status"))
    return kept.select(ident, "category", status.alias("status"))


def priority(age_days: Column, publishers: Column, documents: Column, credibility: Column, contested: Column, forecasts: Column, base: Column, social: Column) -> Column:
    """The score by which situations are worked on: category, age, publishers, documents, credibility, contested claims, forecasts."""
    return (
        base + F.greatest(F.lit(0.0), 4.0 - age_days / 2.0) + F.least(F.lit(3.0), F.greatest(F.lit(0), publishers - 1) * 1.25) + F.least(F.lit(1.25), F.log2(F.greatest(F.lit(1), documents)) * 0.4)
        + F.coalesce(credibility, F.lit(0.0)) + F.least(F.lit(2.0), contested * 0.75) + F.least(F.lit(3.0), forecasts * 1.5) - F.when((publishers <= 1) & social, 1.0).otherwise(0.0)
    )


def integrity_flags(members: DataFrame, contested: DataFrame, situation: str, at: str, lasting: list[str], degrees: tuple[float, float] = (8.0, 12.0), days: float = 21.0) -> DataFrame:
    """Situations whose members don't fit together, one row a flag: wide_geography, long_evidence_span (transient categories only), incompatible_claims.

    members: situation, category, lat, lon and at; contested: situation and n.
    """
    span = lambda c: F.max(c) - F.min(c)
    found = members.groupBy(situation).agg(F.min("category").alias("_k"), span("lat").alias("_lat"), span("lon").alias("_lon"), ((F.max(F.unix_micros(at)) - F.min(F.unix_micros(at))) / 86_400e6).alias("_days")).join(contested.withColumnRenamed("n", "_n"), situation, "left")
    flags = {"wide_geography": (F.col("_lat") > degrees[0]) | (F.col("_lat").isNotNull() & (F.col("_lon") > degrees[1])), "long_evidence_span": ~F.col("_k").isin(lasting) & (F.col("_days") > days), "incompatible_claims": F.col("_n") > 0}
    return found.select(situation, F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in flags.items()]))).alias("flag"))


def gaps(claims: DataFrame, hypotheses: DataFrame, situation: str, order: list[str], most: int = 3) -> DataFrame:
    """Uncertain checkable claims of situations with two hypotheses or more, the first so many: situation, predicate, value, priority, dedupe_key."""
    rivals = hypotheses.groupBy(situation).agg(F.count("*").alias("_h")).where("_h >= 2").select(situation)
    open_ = claims.where(F.col("truth").isin(UNCERTAIN) & F.col("checkable")).join(rivals, situation, "left_semi")
    ranked = open_.withColumn("_r", F.row_number().over(Window.partitionBy(situation).orderBy(*order))).where(F.col("_r") <= most)
    level = F.least(F.lit(1.0), 0.5 + F.coalesce("importance", F.lit(0.5)) * 0.4)
    return ranked.select(situation, "predicate", "value", F.round(level, 4).alias("priority"), F.concat_ws(":", situation, "predicate", "value").alias("dedupe_key"))


def workload_state(used: Column, soft: int, hard: int, queued: Column, ceiling: Column, done: Column) -> Column:
    """The state of a workload: unknown without figures, disk limits first, then the queue."""
    return (
        F.when(used.isNull(), "unknown").when(used >= hard, "disk-hard-limit").when(used >= soft, "disk-soft-limit").when(ceiling.isNull(), "unknown")
        .when((queued > ceiling) & (done > 0), "draining").when(queued >= ceiling, "backpressure-active").otherwise("healthy")
    )


def blinded(rows: DataFrame, group: str, family: str, at: str, ident: str) -> DataFrame:
    """Rows of a group with alias source_n in place of their family, numbered by the family's first appearance."""
    first = rows.withColumn("_f", F.min(F.struct(at, ident)).over(Window.partitionBy(group, family)))
    number = F.dense_rank().over(Window.partitionBy(group).orderBy("_f"))
    return first.withColumn("alias", F.concat(F.lit("source_"), number)).drop("_f")


def reserved_lanes(rows: DataFrame, lanes: list[tuple[str, Column, list, int]], ident: str, limit: int) -> DataFrame:
    """limit rows from lanes (name, which rows, order, slots) in turn: a lane's reserved slots first, each row once, in its first lane; then the rest in the last lane's order."""
    taken = None
    for place, (name, fits, order, slots) in enumerate(lanes):
        top = rows.where(fits).orderBy(*order, ident).limit(slots + sum(x[3] for x in lanes[:place]))
        if taken is not None:
            top = top.join(taken.select(ident), ident, "left_anti")
        top = top.orderBy(*order, ident).limit(slots).select(ident, F.lit(name).alias("lane"))
        taken = top if taken is None else taken.unionByName(top)
    return rows.join(taken, ident).limit(limit)
