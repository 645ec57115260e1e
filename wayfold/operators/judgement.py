"""Verification, assessment of events, framing, forecasts, claims from prose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Verbs of attribution, and what marks a sentence as causal, predictive or interpretive.
VERBS = "said says stated reported claimed announced denied warned confirmed".split()
CAUSAL = "because|caused by|led to|resulted in|responsible for"
PREDICTIVE = "will|expected to|likely to|may|could"
INTERPRETIVE = "appears|suggests|believes|probably|apparently"
#: Predicates of which an absence from a complete catalogue says something, and those whose values are revised rather than refuted.
CLOSED_WORLD, REVISED = ["cyber.known_exploited", "event.active_alert"], ["seismic.magnitude", "economic.value"]


def prose_claims(docs: DataFrame, text: str, ident: str) -> DataFrame:
    """Claims of texts: ident, predicate, claim_type, speaker, statement, confidence.

    Attributed statements first (up to 71 characters of letters, digits and some
    signs as the speaker, a verb, three to 400 characters); other sentences are causal, predictive or interpretive by the
    first marker that they have.  A sentence that holds an attributed statement
    gives no claim of its own.
    """
    said = rf"(?i)\b([A-Z][A-Za-z0-9 .&'’_-]{{1,70}}?)\s+({'|'.join(VERBS)})\s+(?:that\s+)?([^.!?\n]{{3,400}})"
    body = F.coalesce(F.col(text), F.lit(""))
    speakers, verbs, statements = (F.regexp_extract_all(body, F.lit(said), F.lit(k)) for k in (1, 2, 3))
    attributed = F.transform(F.arrays_zip(speakers.alias("s"), verbs.alias("v"), statements.alias("t")), lambda x: F.struct(F.lit("statement.attributed").alias("predicate"), F.when(F.lower(x["v"]) == "denied", "denied_assertion").otherwise("attributed_assertion").alias("claim_type"), F.trim(x["s"]).alias("speaker"), F.trim(x["t"]).alias("statement"), F.lit(0.82).alias("confidence")))
    sentences = F.filter(F.transform(F.regexp_extract_all(body, F.lit(r"[^.!?\n]+(?:[.!?]|\z)"), F.lit(0)), lambda s: F.trim(s)), lambda s: F.length(s).between(12, 500))
    rows = docs.select(ident, attributed.alias("_a"), sentences.alias("_s"))
    free = F.filter("_s", lambda s: ~F.exists("_a", lambda a: F.contains(s, a["statement"])))
    kinds = [("event.causal_explanation", "causal_claim", CAUSAL, 0.48), ("event.prediction", "prediction", PREDICTIVE, 0.45), ("event.interpretation", "interpretation", INTERPRETIVE, 0.42)]

    def own(s: Column) -> Column:
        out = F.lit(None)
        for predicate, kind, words, sure in reversed(kinds):
            claim = F.struct(F.lit(predicate).alias("predicate"), F.lit(kind).alias("claim_type"), F.lit(None).cast("string").alias("speaker"), s.alias("statement"), F.lit(sure).alias("confidence"))
            out = F.when(F.rlike(F.lower(s), F.lit(rf"\b(?:{words})\b")), claim).otherwise(out)
        return out

    every = F.concat("_a", F.filter(F.transform(free, own), lambda c: c.isNotNull()))
    return rows.select(ident, F.explode(every).alias("c")).select(ident, "c.*")


def verification_tasks(claims: DataFrame, desired: Column) -> DataFrame:
    """Checkable claims that are open and no bookkeeping, with the kind of source that they want: claim, desired, priority, dedupe_key."""
    open_ = claims.where((F.col("verifiability") == "checkable") & ~F.col("predicate").isin("event.reported", "event.category") & ~F.col("truth").isin("corroborated", "refuted"))
    return open_.select("claim", desired.alias("desired"), F.round(F.least(F.lit(1.0), 0.4 + F.coalesce("importance", F.lit(0.5)) * 0.5), 4).alias("priority"), F.concat_ws(":", F.col("claim").cast("string"), desired).alias("dedupe_key"))


def signal(evidence: DataFrame, claim: str) -> DataFrame:
    """What a side's evidence (claim, family, credibility, authoritative) is worth: an authority 0.8 to 0.99, else two families 0.65 and 0.08 for each, 0.9 at most; claims with less have no row."""
    found = evidence.groupBy(claim).agg(F.max(F.when(F.col("authoritative"), F.col("credibility"))).alias("_a"), F.count_distinct("family").alias("_f"))
    worth = F.when(F.col("_a").isNotNull(), F.greatest(F.lit(0.8), F.least(F.lit(0.99), "_a"))).when(F.col("_f") >= 2, F.least(F.lit(0.9), 0.65 + 0.08 * F.col("_f")))
    return found.select(claim, worth.alias("confidence"), F.col("_a").isNotNull().alias("primary")).where("confidence is not null")


def verification_results(support: DataFrame, contrary: DataFrame, claim: str) -> DataFrame:
    """Results of both sides' signals: supports, refutes, or mixed where they differ by less than 0.15 (0.65 at most); claim, result, confidence, basis."""
    a = support.select(claim, F.col("confidence").alias("_s"), F.col("primary").alias("_sp"))
    both = a.join(contrary.select(claim, F.col("confidence").alias("_c"), F.col("primary").alias("_cp")), claim, "full")
    close = F.coalesce(F.abs(F.col("_s") - F.col("_c")) < 0.15, F.lit(False))
    for_it = F.col("_c").isNull() | (F.col("_s") > F.col("_c"))
    result = F.when(close, "mixed").when(for_it, "supports").otherwise("refutes")
    value = F.when(close, F.least(F.lit(0.65), F.greatest("_s", "_c"))).when(for_it, F.col("_s")).otherwise(F.col("_c"))
    first = F.when(close, F.col("_s") >= F.col("_c")).otherwise(for_it)
    basis = F.when(F.when(first, F.col("_sp")).otherwise(F.col("_cp")), "authoritative-ingested-evidence").otherwise("independent-family-corroboration")
    return both.select(claim, result.alias("result"), F.round(value, 4).alias("confidence"), basis.alias("basis"))


def compared(predicate: Column, expected: Column, observed: Column, found: Column, closed_world: Column) -> Column:
    """Struct result and confidence of a claim's value against an authority's: supports, revises, refutes or inconclusive.

    Numbers match within 0.05 for magnitudes, else within a thousandth; where
    there is no record, only two predicates of complete catalogues are refuted.
    """
    e, o = expected.try_cast("double"), observed.try_cast("double")
    near = F.abs(e - o) <= F.when(predicate == "seismic.magnitude", 0.05).otherwise(F.greatest(F.lit(0.001), F.abs(e) * 0.001))
    plain = lambda x: F.lower(F.trim(F.coalesce(x, F.lit(""))))
    out = lambda r, c: F.struct(F.lit(r).alias("result"), F.lit(c).alias("confidence"))
    numbers = F.when(near, out("supports", 0.97)).when(predicate.isin(REVISED), out("revises", 0.96)).otherwise(out("refutes", 0.96))
    absent = F.when(closed_world & predicate.isin(CLOSED_WORLD), out("refutes", 0.9)).otherwise(out("inconclusive", 0.3))
    return F.when(~found, absent).when(e.isNotNull() & o.isNotNull(), numbers).when(plain(expected) == plain(observed), out("supports", 0.96)).otherwise(out("revises", 0.92))


def event_assessment(members: DataFrame, disputes: DataFrame, event: str) -> DataFrame:
    """Assessment of events: contested before directly-observed before corroborated before early-signal; event, status, confidence, families, direct.

    members: event, family, direct (boolean), base (the event's confidence);
    disputes: event.  An early signal has 0.49 at most, a direct observation 0.7
    at least, corroboration 0.6 and 0.05 a family (0.9 at most); a dispute takes 0.15.
    """
    found = members.groupBy(event).agg(F.count_distinct("family").alias("families"), F.count_if("direct").alias("direct"), F.max("base").alias("_b"))
    rows = found.join(disputes.select(event).distinct().withColumn("_d", F.lit(True)), event, "left").withColumn("_d", F.coalesce("_d", F.lit(False)))
    direct, several = F.col("direct") > 0, F.col("families") >= 2
    status = F.when(F.col("_d"), "contested").when(direct, "directly-observed").when(several, "corroborated").otherwise("early-signal")
    early = ~F.col("_d") & ~direct & ~several
    base = F.when(early, F.least("_b", F.lit(0.49))).when(direct, F.greatest("_b", F.lit(0.7))).when(several, F.greatest("_b", F.least(F.lit(0.9), 0.6 + 0.05 * F.col("families")))).otherwise(F.col("_b"))
    return rows.select(event, status.alias("status"), F.round(F.when(F.col("_d"), F.greatest(F.lit(0.1), base - 0.15)).otherwise(base), 4).alias("confidence"), "families", "direct")


def framing_means(observations: DataFrame, capture: str) -> DataFrame:
    """Framing of captures: capture, scores (map of dimension to mean strength, sorted), evidence, confidence."""
    each = observations.groupBy(capture, "dimension").agg(F.round(F.avg("strength"), 4).alias("_m"), F.count("*").alias("_n"), F.sum("confidence").alias("_c"))
    return each.groupBy(capture).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dimension", "_m")))).alias("scores"), F.sum("_n").alias("evidence"), F.round(F.sum("_c") / F.sum("_n"), 4).alias("confidence"))


def framing_comparison(assessed: DataFrame, event: str) -> DataFrame:
    """Mean strength by event, publisher and dimension, for events with two publishers and two families; dimensions outside scores don't count.

    assessed: event, publisher, family, dimension, strength.
    """
    gate = assessed.groupBy(event).agg(F.count_distinct("publisher").alias("_p"), F.count_distinct("family").alias("_f")).where("_p >= 2 and _f >= 2").select(event)
    return assessed.join(gate, event, "left_semi").groupBy(event, "publisher", "dimension").agg(F.round(F.avg("strength"), 4).alias("strength"), F.count("*").alias("n"))


def readiness(reports: DataFrame, event: str) -> DataFrame:
    """How far events are from a comparison: publishers and families with reports, captures and assessments, and the next stage.

    reports: event, publisher, family, captured, assessed.
    """
    by = reports.groupBy(event, "publisher", "family").agg(F.max("captured").alias("_c"), F.max("assessed").alias("_a"))
    few = lambda c, k: F.count_distinct(F.when(F.col(c), F.col(k)))
    found = by.groupBy(event).agg(F.count_distinct("publisher").alias("publishers"), F.count_distinct("family").alias("families"), few("_c", "publisher").alias("captured"), few("_a", "publisher").alias("assessed"), few("_a", "family").alias("assessed_families"))
    stage = F.when((F.col("publishers") < 2) | (F.col("families") < 2), "needs-publishers").when(F.col("captured") < 2, "needs-captures").when((F.col("assessed") < 2) | (F.col("assessed_families") < 2), "needs-assessments").otherwise("ready")
    return found.withColumn("stage", stage)


def coverage(captures: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """Share of documents that were captured, by keys, and whether that is enough with a healthy source: documents, captured, share, eligible."""
    found = captures.groupBy(*keys).agg(F.count("*").alias("documents"), F.count_if("captured").alias("captured"), F.min("healthy").alias("_h"))
    share = F.col("captured") / F.col("documents")
    return found.select(*keys, "documents", "captured", F.round(share, 4).alias("share"), ((share >= least) & F.col("_h")).alias("eligible"))


def portfolio_slot(targets: DataFrame, made: DataFrame) -> DataFrame:
    """The horizon that lags its target share most: one row with horizon; ties to the first by name."""
    counts = targets.join(made.groupBy("horizon").agg(F.count("*").alias("_n")), "horizon", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    total = F.sum("_n").over(Window.partitionBy()) + 1  # one row for each horizon, of which there are a few
    lag = counts.withColumn("_lag", F.round(F.col("share") * total - F.col("_n"), 9))
    return lag.agg(F.min_by("horizon", F.struct(-F.col("_lag"), "horizon")).alias("horizon"))


def base_rate(asked: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rates of asked category, kind and horizon from outcomes (with happened, boolean): of all three with bounds, else of the category, else a half; rate, lower, upper, level.

    One of each outcome is added; bounds are 1.64 deviations of the Beta posterior away.
    """
    key = ["category", "kind", "horizon"]
    cells = outcomes.groupBy(*key).agg(F.count_if("happened").alias("_y"), F.count("*").alias("_n"))
    wide = cells.groupBy("category").agg(F.sum("_y").alias("_cy"), F.sum("_n").alias("_cn"))
    a, b = F.col("_y") + 1, F.col("_n") - F.col("_y") + 1
    rate, spread = a / (a + b), 1.64 * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    whole = (F.col("_cy") + 1) / (F.col("_cn") + 2)
    rows = asked.join(cells, key, "left").join(wide, "category", "left")
    level = F.when(F.col("_n").isNotNull(), "cell").when(F.col("_cn").isNotNull(), "category").otherwise("none")
    return rows.select(*key, F.round(F.coalesce(rate, whole, F.lit(0.5)), 6).alias("rate"), F.when(rate.isNotNull(), F.round(F.greatest(F.lit(0.0), rate - spread), 6)).alias("lower"), F.when(rate.isNotNull(), F.round(F.least(F.lit(1.0), rate + spread), 6)).alias("upper"), level.alias("level"))


def forecast_state(forecasts: DataFrame, now: Column, attempts: int = 8) -> DataFrame:
    """Forecasts (target_at, outcome, probability, attempts) with state and Brier score: resolved with an outcome, expired after so many attempts, due from the target on, else active."""
    state = F.when(F.col("outcome").isNotNull(), "resolved").when(F.col("attempts") >= attempts, "expired").when(F.col("target_at") <= now, "due").otherwise("active")
    return forecasts.withColumn("state", state).withColumn("brier", F.when(F.col("outcome").isNotNull(), F.pow(F.col("probability") - F.col("outcome"), 2)))


def world_graph(situations: DataFrame, reports: DataFrame, places: DataFrame) -> DataFrame:
    """Nodes and relations with ids by content: an event for each situation, an observation for each report, a country for each place, and reported_in and located_in between them; id, kind, source_id, target_id.

    situations: situation; reports: report, situation; places: situation, country.
    """
    key = lambda kind, c: F.sha2(F.concat_ws(":", F.lit(kind), F.col(c).cast("string")), 256)
    none = F.lit(None).cast("string")
    nodes = [situations.select(key("event", "situation"), F.lit("event"), none, none), reports.select(key("observation", "report"), F.lit("observation"), none, none), places.select("country").distinct().select(key("country", "country"), F.lit("country"), none, none)]
    link = lambda kind, a, b: (F.sha2(F.concat_ws(":", F.lit(kind), a, b), 256), F.lit(kind), a, b)
    edges = [reports.select(*link("reported_in", key("observation", "report"), key("event", "situation"))), places.select("situation", "country").distinct().select(*link("located_in", key("event", "situation"), key("country", "country")))]
    out = nodes[0]
    for more in [*nodes[1:], *edges]:
        out = out.union(more)
    return out.toDF("id", "kind", "source_id", "target_id")
