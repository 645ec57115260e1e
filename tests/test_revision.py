"""Results of verification: windows and stream against a loop, each result once."""

import random

from pyspark.sql import functions as F
from wayfold.operators import revision

RESULTS = "result_id long, claim_id string, result string, confidence double, observed string"


def plain(claims, results):
    state, out = {c: (s, v) for c, s, v in claims}, {}
    for ident, claim, result, sure, _ in sorted(results, key=lambda r: r[0]):
        status, confidence = state[claim]
        asked, sure = revision.STATUS.get(result, "unverified"), max(0.0, min(0.99, sure or 0.0))
        if {status, asked} == {"corroborated", "refuted"} and sure <= confidence + 0.1:
            asked, sure = "disputed", min(0.7, max(sure, confidence))
        if asked != "unverified":
            state[claim] = asked, round(sure, 4)
        out[ident] = (claim, status, asked, round(sure, 4))
    return out


def case(seed):
    rng = random.Random(seed)
    claims = [(f"c{i}", rng.choice(["corroborated", "refuted", "unverified", "disputed"]), rng.randrange(100) / 100) for i in range(6)]
    kinds = ["supports", "refutes", "supports", "refutes", "mixed", "revises", "inconclusive", None]
    return claims, [(i, rng.choice(["c0", "c0", f"c{rng.randrange(6)}"]), rng.choice(kinds[:4] if i < 300 else kinds), rng.choice([None, rng.randrange(110) / 100, 0.61237, 0.8]), None) for i in range(600)]


def ledger(rows):
    return {r.result_id: (r.claim_id, r.previous_status, r.truth_status, r.confidence) for r in rows}


def test_windows_equal_a_loop(spark):
    claims, results = case(1)
    known = spark.createDataFrame(claims, "claim_id string, truth_status string, confidence double")
    df = spark.createDataFrame([*results, results[5], (None, "c0", "supports", 0.5, None), (9000, "unknown", "supports", 0.5, None)], RESULTS)
    nothing = df.select("result_id").limit(0)
    rows = revision.apply_results(known, df, nothing)
    want = plain(claims, results)
    assert ledger(rows.collect()) == want and {v[2] for v in want.values()} >= {"disputed", "corroborated", "refuted", "superseded", "unverified"}
    after = {r.claim_id: r.truth_status for r in revision.settled(known, rows).collect()}
    assert after == {c: [v[2] for _, v in sorted(want.items()) if v[0] == c and v[2] != "unverified"][-1] for c, _, _ in claims}
    # In two batches, the second with everything again.
    first = revision.apply_results(known, df.where("result_id < 250"), nothing).cache()
    then = revision.apply_results(revision.settled(known, first), df, first.select("result_id"))
    assert ledger(first.collect()) | ledger(then.collect()) == want and then.where("result_id < 250").count() == 0
    assert revision.apply_results(known, df.limit(0), nothing).count() == 0


def test_stream_applies_each_result_once(spark, tmp_path):
    claims, results = case(2)
    known = spark.createDataFrame(claims, "claim_id string, truth_status string, confidence double")
    parts = [results[:200], results[150:400], results[100:200], results[380:]]
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, part in enumerate(parts):  # the same sink and checkpoint go on from batch to batch
            spark.createDataFrame(part, RESULTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = revision.stream_results(known, spark.readStream.schema(RESULTS).parquet(str(tmp_path / "in")))
            q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
            if i == 1:
                seen = spark.read.parquet(str(tmp_path / "out")).count()
            if i == 2:
                assert spark.read.parquet(str(tmp_path / "out")).count() == seen == 400
    finally:
        spark.conf.set(key, old)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 600 and ledger(rows) == plain(claims, results)


def test_a_revised_value_opens_a_claim(spark):
    known = spark.createDataFrame([("a", "s", "seismic.magnitude", "5", "corroborated", 0.8), ("b", "s", "seismic.magnitude", " 6.1", "unverified", 0.0), ("c", None, "topic.x", "1", None, None)], "claim_id string, situation string, predicate string, value string, truth_status string, confidence double")
    rows = [(1, "a", "revises", 0.9, '{"magnitude":6.1}'), (2, "a", "revises", 0.9, '{"magnitude":7}'), (3, "b", "revises", 0.7, '{"magnitude":7}'), (4, "c", "revises", 0.9, '{"magnitude":7}'), (5, "a", "revises", 0.9, "{"), (6, "a", "supports", 0.9, '{"magnitude":8}')]
    done = revision.apply_results(known, spark.createDataFrame(rows, RESULTS), spark.range(0).select(F.col("id").alias("result_id")))
    assert [tuple(r) for r in revision.revised_claims(known, done).collect()] == [("revision:2", "s", "seismic.magnitude", "7", "corroborated", 0.9, "a")]
