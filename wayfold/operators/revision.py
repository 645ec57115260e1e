"""Results of verification, applied to claims exactly once, in batches and as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship

# What a result makes of a claim, how much more a contrary one must be sure of, what a conflict is worth at most, where an authority's answer holds the value of a predicate.
STATUS = {"supports": "corroborated", "refutes": "refuted", "mixed": "disputed", "revises": "superseded"}
AHEAD, CONFLICT, MOST = 0.1, 0.7, 0.99
VALUE_KEYS = {"seismic.magnitude": "magnitude", "event.status": "status", "event.alert_level": "alert_level", "economic.value": "value", "cyber.known_exploited": "known_exploited"}
LEDGER = "result_id long, claim_id string, previous_status string, truth_status string, confidence double"


def _decisive(results: DataFrame) -> DataFrame:
    """Results by id: one of each id, without null ids, with the status that they ask for and a confidence of 0 to 0.99."""
    status = F.coalesce(*[F.when(F.col("result") == r, s) for r, s in STATUS.items()], F.lit("unverified"))
    sure = F.coalesce(F.when(F.isnan("confidence"), 0.0).otherwise(F.col("confidence")), F.lit(0.0))
    clean = results.where("result_id is not null and claim_id is not null")
    one = clean.groupBy("result_id").agg(F.min(F.struct("claim_id", "result", "confidence", "observed")).alias("_r")).select("result_id", "_r.*")
    return one.select("result_id", "claim_id", status.alias("asked"), F.greatest(F.lit(0.0), F.least(F.lit(MOST), sure)).alias("sure"), "observed")


def apply_results(claims: DataFrame, results: DataFrame, applied: DataFrame) -> DataFrame:
    """The ledger's new rows (LEDGER and `observed`): every result that `applied` (result_id) doesn't hold, and what its claim is after it.

    claims: claim_id, truth_status, confidence.  results: result_id, claim_id,
    result, confidence, observed (text).  Results count in order of their ids.  A
    result that confirms what was refuted, or refutes what was corroborated,
    makes the claim disputed, 0.7 at most, unless it is surer than the claim by
    more than 0.1.  Results of other kinds stand in the ledger and change
    nothing.  A null confidence or NaN counts as 0; of rows of one result_id the
    smallest counts; results of unknown claims stand nowhere.

    Order matters less than it seems: a result depends on the one before only if
    that is contrary and not weaker by more than 0.1, and then the claim is
    disputed exactly if it wasn't before.  So in a run of such results every
    second one is disputed, and windows give what a loop would: no claim's
    results are collected, though one claim's are sorted in one task (which
    spills).
    """
    known = claims.where("claim_id is not null").groupBy("claim_id").agg(F.max(F.struct(F.coalesce("truth_status", F.lit("unverified")).alias("asked"), F.coalesce("confidence", F.lit(0.0)).alias("sure"))).alias("_c")).select("claim_id", "_c.*")
    new = _decisive(results).join(applied.select("result_id").distinct(), "result_id", "left_anti").join(known.select("claim_id"), "claim_id", "left_semi")
    start = known.join(new.select("claim_id").distinct(), "claim_id", "left_semi")
    rows = start.select(F.lit(None).cast("long").alias("result_id"), "claim_id", "asked", "sure", F.lit(None).cast("string").alias("observed")).union(new.select("result_id", "claim_id", "asked", "sure", "observed"))
    # The claim itself is the row before its results; results that decide nothing take what stands.
    rows = rows.withColumn("_acts", F.col("result_id").isNull() | (F.col("asked") != "unverified"))
    order = Window.partitionBy("claim_id").orderBy(F.col("result_id").asc_nulls_first())
    acting = Window.partitionBy("claim_id", "_acts").orderBy(F.col("result_id").asc_nulls_first())
    before = lambda c: F.lag(c).over(acting)
    rows = rows.withColumn("_was", before("asked")).withColumn("_sure", before(F.round("sure", 4)))
    contrary = ((F.col("_was") == "corroborated") & (F.col("asked") == "refuted")) | ((F.col("_was") == "refuted") & (F.col("asked") == "corroborated"))
    rows = rows.withColumn("_leans", F.coalesce(contrary & (F.col("sure") <= F.col("_sure") + AHEAD), F.lit(False))).withColumn("_i", F.row_number().over(acting))
    rows = rows.withColumn("_from", F.max(F.when(~F.col("_leans"), F.col("_i"))).over(acting))
    clash = (F.col("_i") - F.col("_from")) % 2 == 1
    after = F.struct(
        F.when(clash, "disputed").otherwise(F.col("asked")).alias("status"), F.round(F.when(clash, F.least(F.lit(CONFLICT), F.greatest("sure", "_sure"))).otherwise(F.col("sure")), 4).alias("confidence"))
    rows = rows.withColumn("_after", F.when(F.col("_acts"), after))
    stood = F.last("_after", True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = rows.withColumn("_stood", stood).where("result_id is not null")
    own = F.coalesce("_after", F.struct(F.lit("unverified").alias("status"), F.round("sure", 4).alias("confidence")))
    return told.select("result_id", "claim_id", F.col("_stood.status").alias("previous_status"), own["status"].alias("truth_status"), own["confidence"].alias("confidence"), "observed")


def settled(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """claims with truth_status and confidence after the ledger's last decisive row; the others as they were."""
    last = ledger.where("truth_status <> 'unverified'").groupBy("claim_id").agg(F.max_by(F.struct("truth_status", "confidence"), "result_id").alias("_l"))
    both = claims.join(last, "claim_id", "left")
    return both.withColumn("truth_status", F.coalesce("_l.truth_status", "truth_status")).withColumn("confidence", F.coalesce("_l.confidence", "confidence")).drop("_l")


def observed_value(predicate: Column, observed: Column) -> Column:
    """What an authority says of a predicate, as text; null for predicates without a key and for broken text."""
    return F.coalesce(*[F.when(predicate == p, F.get_json_object(observed, f"$.{k}")) for p, k in VALUE_KEYS.items()])


def revised_claims(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """Claims that revisions open: claim_id, situation, predicate, value, truth_status (corroborated), confidence, revises.

    claims: claim_id, situation, predicate, value.  Each superseding result with
    an observed value opens one claim; of those with one situation, predicate
    and value (white space and capitals apart) the first by result, and none
    where such a claim stands already.
    """
    found = ledger.where("truth_status = 'superseded'").join(claims.select("claim_id", "situation", "predicate"), "claim_id")
    found = found.withColumn("value", observed_value(F.col("predicate"), F.col("observed"))).where("value is not null").withColumn("_n", F.lower(F.trim("value")))
    first = found.groupBy("situation", "predicate", "_n").agg(F.min_by(F.struct("value", "confidence", F.col("claim_id").alias("revises"), "result_id"), "result_id").alias("_f"))
    standing = claims.select("situation", "predicate", F.lower(F.trim("value")).alias("_n")).distinct()
    same = [first["situation"].eqNullSafe(standing["situation"]), first["predicate"] == standing["predicate"], first["_n"] == standing["_n"]]
    new = first.join(standing, same, "left_anti")
    return new.select(F.concat(F.lit("revision:"), F.col("_f.result_id").cast("string")).alias("claim_id"), "situation", "predicate", "_f.value", F.lit("corroborated").alias("truth_status"), "_f.confidence", "_f.revises")


def stream_results(claims: DataFrame, results: DataFrame) -> DataFrame:
    """apply_results over a stream of results: LEDGER's rows, each result once however often it comes.

    A claim's state is its status and confidence, and a map of the results that
    it has had, in the state store, of which only the batch's own ids are looked
    up.  In a batch results count by id; of batches the earlier counts first.
    claims (claim_id, truth_status, confidence; one row each) is joined to each
    batch and gives the first state.  Memory: one batch's results of one claim.
    Needs the RocksDB state store.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    ship(results.sparkSession)

    class Apply(StatefulProcessor):
        def init(self, handle) -> None:
            self.now = handle.getValueState("now", "status string, confidence double")
            self.had = handle.getMapState("had", "result_id long", "status string")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            todo, first = {}, None
            for frame in rows:
                for r in frame.itertuples(index=False):
                    first = (r.asked_first, r.sure_first)
                    seen = (r.asked, float(r.sure))
                    todo[int(r.result_id)] = min(todo.get(int(r.result_id), seen), seen)
            status, confidence = self.now.get() if self.now.exists() else first
            out = []
            for ident, (asked, sure) in sorted(todo.items()):
                if self.had.containsKey((ident,)):
                    continue
                was = status
                if asked != "unverified":
                    if {was, asked} == {"corroborated", "refuted"} and sure <= confidence + AHEAD:
                        asked, sure = "disputed", min(CONFLICT, max(sure, confidence))
                    status, confidence = asked, round(sure, 4)
                self.had.updateValue((ident,), (asked,))
                out.append((ident, key[0], was, asked, round(sure, 4)))
            self.now.update((status, confidence))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LEDGER.split(", ")])

        def close(self) -> None:
            pass

    status = F.coalesce(*[F.when(F.col("result") == r, s) for r, s in STATUS.items()], F.lit("unverified"))
    sure = F.coalesce(F.when(F.isnan("confidence"), 0.0).otherwise(F.col("confidence")), F.lit(0.0))
    clean = results.where("result_id is not null and claim_id is not null").select("result_id", "claim_id", status.alias("asked"), F.greatest(F.lit(0.0), F.least(F.lit(MOST), sure)).alias("sure"))
    first = claims.select("claim_id", F.coalesce("truth_status", F.lit("unverified")).alias("asked_first"), F.coalesce("confidence", F.lit(0.0)).alias("sure_first"))
    return clean.join(first, "claim_id").groupBy("claim_id").transformWithStateInPandas(Apply(), LEDGER, "append", "none")
