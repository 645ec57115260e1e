"""Hypotheses, base rates and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def posteriors(priors: DataFrame, ratios: DataFrame, situation: str, hypothesis: str, floor: float = 0.03, bound: float = 8.0) -> DataFrame:
    """Posterior of each hypothesis of a situation: log prior plus the sum of log likelihood ratios (each within bound), softmax, a floor, and shares of one again.

    priors: situation, hypothesis, prior.  ratios: situation, hypothesis, ratio.
    Without evidence the prior counts.
    """
    term = F.ln(F.greatest(F.lit(1 / bound), F.least(F.lit(bound), F.col("ratio"))))
    evidence = ratios.groupBy(situation, hypothesis).agg(F.sum(term).alias("_e"), F.count("*").alias("n_evidence"))
    scored = priors.join(evidence, [situation, hypothesis], "left").withColumn("_s", F.ln("prior") + F.coalesce("_e", F.lit(0.0)))
    w = Window.partitionBy(situation)
    shifted = scored.withColumn("_x", F.exp(F.col("_s") - F.max("_s").over(w)))
    held = shifted.withColumn("_p", F.greatest(F.lit(floor), F.col("_x") / F.sum("_x").over(w)))
    return held.select(situation, hypothesis, F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"), (F.col("_p") / F.sum("_p").over(w)).alias("posterior"))


def base_rates(resolved: DataFrame, levels: list[str], outcome: Column) -> DataFrame:
    """(successes + 1) / (n + 2) for every level of a hierarchy in one pass (rollup); * stands for all."""
    found = resolved.rollup(*levels).agg(F.count("*").alias("n"), F.count_if(outcome).alias("successes"))
    return found.select(*[F.coalesce(c, F.lit("*")).alias(c) for c in levels], "n", "successes", ((F.col("successes") + 1) / (F.col("n") + 2)).alias("rate"))


def calibration(forecasts: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """One row: n, brier, log_loss (natural), ece over equal bins."""
    rows = forecasts.select(F.col(p).cast("double").alias("p"), F.col(y).cast("double").alias("y")).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)))
    safe = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("p")))
    loss = -(F.col("y") * F.ln(safe) + (1 - F.col("y")) * F.ln(1 - safe))
    each = rows.groupBy("bin").agg(F.count("*").alias("n"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sq"), F.sum(loss).alias("loss"), F.sum("p").alias("sp"), F.sum("y").alias("sy"))
    n = F.sum("n")
    return each.agg(n.alias("n"), (F.sum("sq") / n).alias("brier"), (F.sum("loss") / n).alias("log_loss"), (F.sum(F.abs(F.col("sp") - F.col("sy"))) / n).alias("ece"))
