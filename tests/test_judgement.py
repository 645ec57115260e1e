"""Outcomes, situations and judgement on small frames, by hand."""

import datetime

import pytest
from pyspark.sql import functions as F
from wayfold.operators import judgement, outcomes, situations

T = datetime.datetime


def test_outcomes_take_precedence(spark):
    t = lambda m: T(2024, 1, 1, 0, m)
    docs = spark.createDataFrame([
        (1, "s", "p", t(0), "active", 0.5, ["a", "b"], ["k"]), (2, "s", "q", t(4), "active", 0.7, ["a", "b"], []), (3, "s", "r", t(9), "active", 0.8, [], ["k"]), (4, "s", "q", t(1), "deleted", 0.7, ["z"], []),
        (5, "t", "p", t(0), "deleted", 0.5, [], []), (6, "t", "q", t(6), "active", 0.96, [], []), (7, "s", "p", None, "active", 0.9, ["a"], ["k"])], "doc long, situation string, publisher string, at timestamp, status string, credibility double, tokens array<string>, claims array<string>")
    backing = outcomes.corroborators(docs)
    assert sorted((r.doc, r.other) for r in backing.collect()) == [(1, 2), (1, 3)]
    against = spark.createDataFrame([(4, 0.99)], "doc long, credibility double")
    got = {r.doc: (r.outcome, pytest.approx(r.confidence), r.was_early) for r in outcomes.delayed_outcome(docs, backing, against).collect()}
    assert got == {1: ("confirmed", 0.82, False), 4: ("contradicted", 0.98, False), 5: ("deleted_unverified", 0.35, False)}
    assert outcomes.corroborators(docs.limit(0)).count() == 0


def test_reputation_moves_by_steps(spark):
    rows = [("p", "confirmed", 0.8, True)] * 3 + [("q", "contradicted", 0.9, False)] + [("r", "confirmed", 0.9, False)] * 20
    found = spark.createDataFrame(rows, "publisher string, outcome string, confidence double, was_early boolean")
    before = spark.createDataFrame([("p", 0.7, 0.72, 0), ("q", 0.7, 0.7, 0), ("r", 0.5, 0.5, 4), ("s", 0.6, 0.65, 2)], "publisher string, baseline double, learned double, evaluated long")
    got = {r.publisher: r for r in outcomes.reputation(found, before).collect()}
    assert got["p"].learned == 0.7 and (got["p"].lower, got["p"].upper) == (0.45, 0.95) and got["p"].early == 3
    assert got["q"].learned == pytest.approx(0.67) and got["s"].learned == 0.65 and got["s"].n == 0
    assert got["r"].learned == pytest.approx(0.5 + 0.03 * 4, abs=1e-4)


def test_relations_and_leave_one_out(spark):
    rows = spark.createDataFrame([("s", "p", "x", 1, True), ("s", "p", "x", 2, True), ("s", "p", "y", 3, True), ("s", "q", "x", 4, False), ("s", "q", "y", 5, False)], "s string, p string, v string, i long, single boolean")
    got = {(r.left_id, r.right_id, r.relationship) for r in outcomes.relations(rows, "s", "i", "p", "v").collect()}
    assert got == {(1, 2, "supports"), (1, 3, "contradicts")}
    pairs = outcomes.both_ways(outcomes.relations(rows, "s", "i", "p", "v"))
    assert {(r.id, r.other) for r in pairs.collect()} == {(1, 2), (2, 1), (1, 3), (3, 1)}
    ev = spark.createDataFrame([("c", "f", "a", "corroborated"), ("d", "f", "a", "corroborated"), ("d", "g", "b", "corroborated"), ("e", "f", "a", "refuted"), ("d", "g", "b", "corroborated"), ("x", "f", "a", "unverified")], "claim string, family string, publisher string, status string")
    got = {(r.claim, r.publisher, r.outcome, r.others) for r in outcomes.claim_outcomes(ev, "claim", "family", "publisher").collect()}
    assert got == {("d", "a", "confirmed", 1), ("d", "b", "confirmed", 1), ("e", "a", "refuted", 0)}


def test_situations_by_hand(spark):
    claims = spark.createDataFrame([("s", 0.5, "active", False), ("s", 0.7, "contested", False), ("s", 0.9, "superseded", True), ("t", 0.4, "active", True)], "sit string, confidence double, status string, closed boolean")
    families = spark.createDataFrame([("s", 3), ("t", 9)], "sit string, n_families long")
    got = {r.sit: (r.status, r.confidence, r.claims) for r in situations.refreshed(claims, families, "sit").collect()}
    assert got == {"s": ("contested", 0.68, 2), "t": ("resolved", 0.52, 1)}
    now = F.lit("2024-02-01").cast("timestamp")
    rows = spark.createDataFrame([(1, "storm", "active", T(2024, 1, 1), 3), (2, "storm", "active", T(2024, 1, 1), 3), (3, "news", "active", T(2023, 1, 1), 1), (4, "news", "active", T(2023, 1, 1), 2), (5, "storm", "resolved", T(2023, 1, 1), 1), (6, None, "active", T(2023, 1, 1), 1)], "i long, category string, status string, last_seen timestamp, publishers long")
    found = situations.lifecycle(rows, rows.where("i = 2").select("i"), rows.limit(0).select("i"), now, {"storm": 3}, {"news": 30}, "i")
    assert {r.i: r.status for r in found.collect()} == {1: "expired", 2: "active", 3: "archived", 4: "active", 5: "resolved", 6: "active"}
    members = spark.createDataFrame([("s", "news", 0.0, 0.0, T(2024, 1, 1)), ("s", "news", 9.0, 0.0, T(2024, 3, 1)), ("t", "storm", None, None, T(2024, 1, 1)), ("t", "storm", None, None, T(2024, 3, 1))], "sit string, category string, lat double, lon double, at timestamp")
    flags = situations.integrity_flags(members, spark.createDataFrame([("t", 2)], "sit string, n long"), "sit", "at", ["news"])
    assert {(r.sit, r.flag) for r in flags.collect()} == {("s", "wide_geography"), ("t", "long_evidence_span"), ("t", "incompatible_claims")}
    lanes = [("a", F.col("x") > 5, [F.desc("x")], 2), ("b", F.lit(True), ["x"], 2)]
    numbers = spark.createDataFrame([(i, i) for i in range(8)], "i long, x long")
    assert {r.i: r.lane for r in situations.reserved_lanes(numbers, lanes, "i", 9).collect()} == {7: "a", 6: "a", 0: "b", 1: "b"}


def test_prose_claims(spark):
    text = "Mayor Jane Roe said that the bridge is closed. Floods came because dams broke. It could rain again soon. Nothing here at all.\nThe minister denied any delay in work."
    got = {(r.predicate, r.claim_type, r.speaker, r.statement) for r in judgement.prose_claims(spark.createDataFrame([(1, text), (2, None), (3, "")], "i long, t string"), "t", "i").collect()}
    assert got == {("statement.attributed", "attributed_assertion", "Mayor Jane Roe", "the bridge is closed"), ("event.causal_explanation", "causal_claim", None, "Floods came because dams broke."), ("event.prediction", "prediction", None, "It could rain again soon."), ("statement.attributed", "denied_assertion", "The minister", "any delay in work")}


def test_verification_by_hand(spark):
    ev = spark.createDataFrame([("a", "f", 0.7, False), ("a", "g", 0.6, False), ("b", "f", 0.97, True), ("c", "f", 0.9, False)], "claim string, family string, credibility double, authoritative boolean")
    got = {r.claim: (pytest.approx(r.confidence), r.primary) for r in judgement.signal(ev, "claim").collect()}
    assert got == {"a": (0.81, False), "b": (0.97, True)}
    contrary = spark.createDataFrame([("a", 0.8, True), ("z", 0.81, False)], "claim string, confidence double, primary boolean")
    got = {r.claim: (r.result, r.confidence) for r in judgement.verification_results(judgement.signal(ev, "claim"), contrary, "claim").collect()}
    assert got == {"a": ("mixed", 0.65), "b": ("supports", 0.97), "z": ("refutes", 0.81)}
    s = lambda x: F.lit(x).cast("string")
    cases = [("seismic.magnitude", "5.0", "5.04", True, "supports"), ("seismic.magnitude", "5.0", "5.2", True, "revises"), ("event.status", "10", "12", True, "refutes"), ("event.status", "Open", " open", True, "supports"), ("cyber.known_exploited", "true", None, False, "refutes"), ("economic.value", "1", None, False, "inconclusive")]
    out = spark.range(1).select(*[judgement.compared(s(p), s(e), s(o), F.lit(f), F.lit(True))["result"].alias(f"c{i}") for i, (p, e, o, f, _) in enumerate(cases)]).first()
    assert list(out) == [c[-1] for c in cases]


def test_assessment_framing_and_rates(spark):
    members = spark.createDataFrame([(1, "f", False, 0.6), (2, "f", False, 0.5), (2, "g", False, 0.5), (3, "f", True, 0.5), (4, "f", True, 0.9), (4, "g", False, 0.9)], "event long, family string, direct boolean, base double")
    got = {r.event: (r.status, r.confidence) for r in judgement.event_assessment(members, spark.createDataFrame([(4,), (4,)], "event long"), "event").collect()}
    assert got == {1: ("early-signal", 0.49), 2: ("corroborated", 0.7), 3: ("directly-observed", 0.7), 4: ("contested", 0.75)}
    frames = spark.createDataFrame([(1, "x", 0.2, 0.5), (1, "x", 0.4, 0.7), (1, "y", 1.0, 0.6)], "capture long, dimension string, strength double, confidence double")
    r = judgement.framing_means(frames, "capture").first()
    assert r.scores == {"x": pytest.approx(0.3), "y": 1.0} and r.evidence == 3 and r.confidence == pytest.approx(0.6)
    asked = spark.createDataFrame([("a", "k", "h"), ("a", "other", "h"), ("none", "k", "h")], "category string, kind string, horizon string")
    seen = spark.createDataFrame([("a", "k", "h", True), ("a", "k", "h", False), ("a", "k", "h", True)], "category string, kind string, horizon string, happened boolean")
    got = {(r.category, r.kind): (r.rate, r.level, r.lower is None) for r in judgement.base_rate(asked, seen).collect()}
    assert got == {("a", "k"): (0.6, "cell", False), ("a", "other"): (0.6, "category", True), ("none", "k"): (0.5, "none", True)}
