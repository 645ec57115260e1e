"""Replays of small bundles, and values that spread until nothing changes."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from wayfold.operators import replay

START = datetime(2024, 5, 1)


def report(source, ident, hours, title="Flood at Aldo Bridge", summary="water rises over the old bridge and more rain is due", **more):
    row = {"source": source, "external_id": ident, "captured_at": START + timedelta(hours=hours), "title": title, "summary": summary, "url": f"https://{source}.test/{ident}", "category": "flood", "status": "active", "lat": 10.0, "lon": 20.0, "metadata": "{}", "publisher": source, "credibility": 0.6}
    return row | more


def replayed(spark, rows, cutoff=None, parts=1):
    names = [c.split()[0] for c in replay.BUNDLE.split(", ")]
    bundle = spark.createDataFrame([tuple(r[c] for c in names) for r in rows], replay.BUNDLE)
    return replay.stages(bundle.repartition(parts), F.lit(cutoff or START + timedelta(days=30)))


def test_a_correction_is_a_version_and_takes_the_place_of_the_first(spark):
    rows = [report("a", "1", 0, metadata='{"magnitude": "5"}'), report("a", "1", 5, title="Flood at Aldo Bridge ends", metadata='{"magnitude": "6"}')]
    tables = replayed(spark, rows)
    assert tables["versions"].count() == 2
    assert [(r.outcome, r.supersedes is not None) for r in tables["decisions"].orderBy("outcome").collect()] == [("create", False), ("link", True)]
    event = tables["events"].first()
    assert event.observations == 1 and event.title == "Flood at Aldo Bridge ends"
    assert [r.value for r in tables["claims"].where("predicate = 'magnitude'").collect()] == ["6"]
    early = replayed(spark, rows, START + timedelta(hours=1))
    assert early["versions"].count() == 1 and early["events"].first().title == "Flood at Aldo Bridge"


def test_repeats_syndication_and_deletion(spark):
    copy = report("b", "7", 2, metadata='{"alert": "red"}')
    rows = [report("a", "1", 0, metadata='{"alert": "red"}'), report("a", "1", 0, metadata='{"alert": "red"}'), copy, report("c", "9", 3, title="Rain over Aldo Bridge", summary="the mayor calls for help at the river", status="deleted")]
    tables = replayed(spark, rows)
    assert tables["versions"].count() == 3
    assert {r.members for r in tables["families"].collect()} == {2}
    event = tables["events"].first()
    assert (event.observations, event.families, event.sources) == (2, 1, 2)
    alert = tables["claims"].where("predicate = 'alert_level'").first()
    assert (alert.value, alert.n_families) == ("red", 1)


def test_one_manifest_for_any_partitioning(spark):
    rng = random.Random(4)
    rows = [report(rng.choice("abcd"), str(i % 9), i, title=f"Flood at {rng.choice(['Aldo Bridge', 'Berrin Dam'])}", lat=rng.choice([10.0, 10.2, None]), metadata=json.dumps({"magnitude": rng.randint(1, 3)})) for i in range(40)]
    first = replay.manifest(replayed(spark, rows)).collect()
    again = replay.manifest(replayed(spark, rng.sample(rows, 40) + rows[:5], parts=5)).collect()
    assert sorted(first) == sorted(again) and {r.stage for r in first} == {"versions", "families", "decisions", "events", "claims", "all"}


def test_fingerprints_tell_bags_of_rows_apart(spark):
    rows = [(1, "a", None), (1, "a", None), (2, "b", 0.5), (None, "", 1.5)]

    def of(some, kinds="x int, y string, z double"):
        return replay.fingerprint(spark.createDataFrame(some, kinds)).first().fingerprint

    assert of(rows) == of(rows[::-1]) == of([(z, x, y) for x, y, z in rows], "z double, x int, y string")
    assert len({of(rows), of(rows[1:]), of(rows[:1] + rows), of([]), of([(1, "a", 0.0), *rows[1:]])}) == 5
    summed = {r.stage: r for r in replay.manifest({"one": spark.createDataFrame(rows, "x int, y string, z double"), "none": spark.createDataFrame([], "x int")}).collect()}
    assert (summed["one"].rows, summed["none"].rows, summed["all"].rows) == (4, 0, 4)


def test_least_values_reach_along_links(spark):
    rng = random.Random(5)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(90)] + [(100 + i, 101 + i) for i in range(12)] + [(None, 1), (1, None), (2, 2)]
    values = [(i, rng.randint(0, 1000)) for i in range(0, 60, 2)] + [(100, -5), (7, None), (None, -9), (4, 999)]
    best = {}
    for i, v in values:
        if i is not None and v is not None:
            best[i] = min(v, best.get(i, v))
    while True:
        new = dict(best)
        for a, b in links:
            if a in new and b is not None and (b not in new or new[a] < new[b]):
                new[b] = new[a]
        if new == best:
            break
        best = new
    found, rounds = replay.least_reaching(spark.createDataFrame(values, "id long, value int"), spark.createDataFrame(links, "a long, b long"))
    assert {r.id: r.value for r in found.collect()} == best and rounds >= 12
    with pytest.raises(ValueError):
        replay.least_reaching(spark.createDataFrame(values, "id long, value int"), spark.createDataFrame(links, "a long, b long"), most=3)
