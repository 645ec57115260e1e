"""Groundings, lookups and the rotation of lanes on small cases."""

import random

from pyspark.sql import functions as F
from wayfold.operators import grounding, selection


def docs(spark, rows):
    return spark.createDataFrame(rows, "claim long, document string, source string, external_id string, title string, summary string, lat double, lon double, at string, metadata string").select(
        *[F.col(c) for c in ("claim", "document", "source", "external_id", "title", "summary", "lat", "lon")], F.lit(None).cast("timestamp").alias("published_at"), F.to_timestamp("at").alias("retrieved_at"), "metadata")


def test_groundings_and_targets(spark):
    claims = spark.createDataFrame([(1, "x CVE-2024-12345", "The Mayor", "checkable", "a"), (2, "y", None, "checkable", "a"), (3, "z", "x", "checkable", "event.category"), (4, None, "", "checkable", "a"), (None, "x", "x", "checkable", "a")], "claim long, object string, speaker string, verifiability string, predicate string")
    rows = [(1, "d1", "usgs_earthquakes", " us7000 ", "So says the mayor", "GHSA-2345-cfgh-jmpq, cve-2024-12345", 10.0, 200.0, "2024-01-01 00:00:00", None)]
    rows += [(2, f"e{i}", "gdacs", f"g{i}", None, None, 1.0, 2.0, f"2024-01-{i + 1:02d} 00:00:00", '{"series_id":"gdp","observation_date":"2020"}' if i == 0 else "{") for i in range(10)]
    rows += [(2, "e0", "gdacs", "g0", None, None, 1.0, 2.0, "2024-01-01 00:00:00", '{"series_id":"gdp","observation_date":"2020"}'), (3, "f", "usgs_earthquakes", "us1", "x", None, None, None, None, None)]
    evidence = docs(spark, rows)
    found = grounding.groundings(claims, evidence).cache()
    got = {(r.claim, r.type, r.value) for r in found.collect()}
    # A longitude of 200 is no place; the two documents of claim 2 that were read first don't count.
    assert {g for g in got if g[0] == 1} == {(1, "authority_record", "us7000"), (1, "security_identifier", "CVE-2024-12345"), (1, "security_identifier", "GHSA-2345-CFGH-JMPQ"), (1, "named_entity", "The Mayor")}
    assert {g[2] for g in got if g[0] == 2 and g[1] == "authority_record"} == {f"g{i}" for i in range(2, 10)} and {g[0] for g in got} == {1, 2}
    asked = [(i, c, a) for i, (c, a) in enumerate([(1, "usgs"), (1, "cisa-kev"), (1, "github-advisories"), (1, "firms"), (2, "gdacs"), (2, "firms"), (2, "fred"), (2, "usgs"), (2, "world-bank"), (2, "other"), (4, "usgs"), (99, "usgs")])]
    tasks = spark.createDataFrame(asked, "task int, claim long, adapter string")
    out = {r.task: (r.identifier_type, r.identifier, r.ready) for r in grounding.targets(tasks, claims, evidence, found).collect()}
    assert out == {
        0: ("usgs_event_id", "us7000", True), 1: ("cve", "CVE-2024-12345", True), 2: ("cve", "CVE-2024-12345", True), 3: ("", "", False), 4: ("event_id", "g9", True), 5: ("geo_time_window", "", True),
        6: ("fred_observation", "GDP:2020", True), 7: ("geo_time_window", "", True), 8: ("", "", False), 9: ("", "", False), 10: ("", "", False)}
    assert grounding.groundings(claims, evidence.limit(0)).where("type <> 'security_identifier'").count() == 0


def test_rotation_equals_leasing_one_by_one(spark):
    rng, sequence = random.Random(4), ["v", "v", "g", "v", "h"]
    jobs = [(i, rng.choice(["v", "v", "g", "h", "other", None])) for i in range(120)]
    left = {lane: [i for i, x in jobs if x == lane] for lane in "vgh"}
    cursor, want = 3, []
    while any(left.values()) and len(want) < 70:
        for offset in range(len(sequence)):
            at = (cursor + offset) % len(sequence)
            if left[sequence[at]]:
                want.append(left[sequence[at]].pop(0))
                cursor = (at + 1) % len(sequence)
                break
    df = spark.createDataFrame(jobs, "id int, lane string")
    assert [r.id for r in selection.lane_rotation(df, "lane", [], sequence, 3, 70, "id").orderBy("place").collect()] == want
    assert selection.lane_rotation(df, "lane", [], [], 3, 70, "id").count() == 0


def test_a_claims_documents_are_read_once_and_fields_parsed_once(spark):
    claims = spark.createDataFrame([(1, None, " B ", "checkable", "a"), (2, None, None, "checkable", "a")], "claim long, object string, speaker string, verifiability string, predicate string")
    rows = [(1, "d", "gdacs", "g1", "b", None, 1.0, 2.0, "2024-01-01 00:00:00", '{"ye\\u0061r":"2020","series_id":7,"country_code":""}'), (1, "d", "gdacs", "g1", "b", None, 1.0, 2.0, "2024-01-01 00:00:00", '{"year":"2020"}'), (1, "e", "gdacs", "g1", None, None, None, 2.0, "2024-01-02 00:00:00", '{"year":"2020"'), (None, "f", "gdacs", "g1", None, None, None, None, None, None)]
    evidence = docs(spark, rows)
    found = grounding.groundings(claims, evidence)
    told = found._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("get_json_object") == len(grounding.METADATA) and told.count("Window [row_number") == 1
    window = '{"latitude":1.0,"longitude":2.0,"observed_at":"2024-01-01T00:00:00"}'
    assert sorted((r.place, r.claim, r.type, r.value, r.document) for r in found.collect()) == [
        (0, 1, "authority_record", "g1", "e"), (1, 1, "authority_record", "g1", "d"), (2, 1, "series_id", "7", "d"), (3, 1, "year", "2020", "d"), (4, 1, "geo_time_window", window, "d"), (5, 1, "named_entity", "B", None)]


def test_what_lookups_are_made_of_is_worked_out_once(spark):
    claims = spark.createDataFrame([(1, None, None, "checkable", "a")], "claim long, object string, speaker string, verifiability string, predicate string")
    evidence = docs(spark, [(1, "d", "nws_alerts", "a-1", "cve-2024-1000", None, None, None, "2024-01-01 00:00:00", '{"s\\u0065ries_id":"gdp"}'), (1, "e", "nws_alerts", None, "CVE-2024-2000", None, None, None, "2024-01-01 00:00:00", "{"), (1, "f", "press", "x", "ghsa-2345-cfgh-jmpq", None, None, None, None, None)])
    grounded = grounding.groundings(claims, evidence)
    tasks = spark.createDataFrame([(i, 1, a) for i, a in enumerate(["nws-alerts", "cisa-kev", "github-advisories", "fred"])], "task int, claim long, adapter string")
    found = grounding.targets(tasks, claims, evidence, grounded)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("get_json_object") == len(grounding.METADATA) + 5
    assert {r.task: (r.identifier, r.ready) for r in found.collect()} == {0: ("", False), 1: ("CVE-2024-2000", True), 2: ("CVE-2024-2000", True), 3: ("GDP:", True)}
