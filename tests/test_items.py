"""Functions over items, by values written from their rules."""

import datetime

import pytest
from pyspark.sql import functions as F
from wayfold.functions import items
from wayfold.operators import ingest, spans

T = datetime.datetime
S = lambda x: F.lit(x).cast("string")
D = lambda x: F.lit(x).cast("double")


def row(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_names_and_titles(spark):
    r = row(
        spark, title=items.normal_title(S("Breaking: the Flood hits the town, flood!")), none=items.normal_title(S(None)), tokens=items.report_tokens(S("they said that Rivers over banks will rise")),
        phrases=items.named_phrases(S("Storm over New York City and Weather in U.S. Statement")), keys=items.item_names(S("Fire in Big Bear"), S('{"country": "France", "places": ["Big Bear", "x", null], "actor": ""}')), empty=items.item_names(S(None), S(None)))
    assert r.title == "flood hits town" and r.none == "" and r.tokens == ["rivers", "banks", "rise"]
    assert r.phrases == ["new-york-city", "u-s-statement"] and r.empty == []
    assert r["keys"] == ["big-bear", "fire", "france"]


def test_places_fingerprints_and_overlaps(spark):
    a, b, none = F.array(*map(S, "ab")), F.array(*map(S, "bcd")), F.array().cast("array<string>")
    r = row(spark, at=items.location_key(D(1.26), D(-0.04)), nowhere=items.location_key(D(None), D(1.0)), short=items.item_fingerprint(S("a b c"), S("d e")), announced=items.item_fingerprint(S("Breaking news of the day at noon"), S(" ")), said=items.item_fingerprint(S("Breaking news of the day at noon"), S("x")), most=items.max_overlap(a, b), zero=items.max_overlap(a, none))
    assert (r.at, r.nowhere, r.short, r.announced) == ("1.3,0.0", "", "", "") and len(r.said) == 64 and r.most == pytest.approx(1 / 3) and r.zero == 0


def test_kinds_and_severity(spark):
    families = {c: items.category_family(S(c)) for c in ("Wildfire", "civil protest", "Disease", "humanitarian aid", "world-news", "Odd  kind!", "")}
    assert list(row(spark, **{f"c{i}": c for i, c in enumerate(families.values())})) == ["hazard", "conflict", "health", "emergency", "news", "odd-kind", "general"]
    r = row(
        spark, quake=items.severity(S("earthquake"), S("red"), D(6.0), D(None)), big=items.severity(S("earthquake"), S(""), D(9.5), D(None)), fire=items.severity(S("wildfire"), S("nominal"), D(None), D(80.0)), share=items.severity(S("wildfire"), S("95"), D(None), D(1.0)),
        other=items.severity(S("flood"), S(" Orange"), D(None), D(None)), none=items.severity(S("flood"), S(None), D(None), D(None)), kind=items.feature_type(S("Severe Tropical Cyclone")), no_kind=items.feature_type(S(None)), topic=items.topic(S("Severe_Storms")), general=items.topic(S(" ")))
    assert (r.quake, r.big, r.fire, r.share, r.other, r.none, r.kind, r.no_kind, r.topic, r.general) == (0.75, 1.0, 0.8, 0.95, 0.72, 0.5, "storm", "", "weather", "general")


def test_links_numbers_and_metadata(spark):
    r = row(
        spark, urls=items.urls(S("see (https://a.org/x), HTTP://b.org. and ftp://c")), cves=items.vulnerability_ids(S("cve-2024-12345 CVE-2024-1 GHSA-2345-cfgh-jmpq")), ids=items.identifiers(S('{"usgs": "7", "gdacs": "", "x": "1"}'), S("src"), ["usgs", "gdacs"]), same=items.content_key(S("a"), S(None)), other=items.content_key(S(None), S("a")),
        stable=items.without_keys(S('{"b": "2", "retrieved": "now", "a": 1}'), ["retrieved"]), score=items.context_score(S("Rain in the hills"), ["rain", "sun"]))
    assert r.urls == ["https://a.org/x", "HTTP://b.org"] and r.cves == ["CVE-2024-12345", "GHSA-2345-CFGH-JMPQ"] and r.ids == {"src:usgs": "7"} and r.same != r.other and r.stable == {"a": "1", "b": "2"} and r.score == 0.5
    times = row(spark, a=items.when_said(S("nonsense"), S("2024-01-02T03:04:05Z")), b=items.when_said(S("1700000000")), c=items.when_said(S("1700000000000")), d=items.when_said(S(None)), h=items.horizon_bucket(F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-03").cast("timestamp")))
    assert times.a == T(2024, 1, 2, 3, 4, 5) and times.b == times.c == T(2023, 11, 14, 22, 13, 20) and times.d is None and times.h == "1-3d"


def test_copies_and_passages(spark):
    rows = spark.createDataFrame([(1, "a", "s"), (2, "a", "t"), (3, None, "s"), (4, "b", "s"), (5, None, "s")], "i long, k string, s string")
    got = {r.i: (r.copies, r.first and r.first.i) for r in ingest.with_copies(rows, "k", "i", ["s"]).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (1, None), 4: (1, None), 5: (1, None)}
    assert ingest.with_copies(rows.limit(0), "k", "i").count() == 0
    found = spans.literal(spark.createDataFrame([(1, "one two"), (2, "b c d e f g h"), (3, ""), (4, None), (5, "ne tw")], "item long, p string"), "p", spark.createDataFrame([(7, "say one two"), (8, "a b c d e f g h i"), (9, None), (7, "say one two")], "doc long, t string"), "t")
    assert sorted((r.item, r.doc, r.start) for r in found.collect()) == [(1, 7, 4), (1, 7, 4), (2, 8, 2), (5, 7, 5), (5, 7, 5)]
