"""Places named in texts, families of reports, ordered events: against loops in Python."""

import os
import random
import re
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from wayfold.operators import assignment, families, fusion, gazetteer
from wayfold.plans import graph_queries

PLACES = [(1, "Port Aldo", "AA", 10.0, 10.0), (1, "Aldo", "AA", 10.0, 10.0), (2, "Aldo Airport", "AA", 10.1, 10.1), (3, "Berrin", "BB", 50.0, 5.0), (4, "Reading", "BB", 51.0, 5.0), (5, "Nowhere Town", None, None, None), (6, "Xy", "BB", 1.0, 1.0), (7, "Berrin Naval Base", "BB", 70.0, 5.0)]
COUNTRIES = [("AA", "Aland"), ("BB", "Bor Land"), ("CC", "Coy")]


def plain(text):
    return " ".join(re.findall("[a-z0-9]+", (text or "").lower()))


def near(text, phrase):
    return re.search(rf"(?<![a-z0-9])(?:in|near|at|inside|outside|across|throughout|around|off|over|east of|west of|north of|south of)(?: [a-z0-9]+){{0,4}} {phrase}(?![a-z0-9])", text) is not None


def inferred(spark, rows):
    docs = spark.createDataFrame(rows, "id long, title string, place string, country string, country_code string")
    places = spark.createDataFrame(PLACES, "place_id long, alias string, code string, lat double, lon double")
    out = gazetteer.infer(docs, "id", F.col("title"), places, spark.createDataFrame(COUNTRIES, "code string, name string"))
    return {r.id: (r.status, r.origin, r.label, r.country) for r in out.collect()}


def test_places_of_reports(spark):
    rows = [
        (1, "Fire in the old quarter of Berrin", None, None, None),
        (2, "Berrin speaks", None, None, None),
        (3, "Aldo Airport is shut", None, None, None),
        (4, "Storm near Aldo and Aldo Airport", None, None, None),
        (5, "Talks at Port Aldo, then at Berrin, in Aland", None, None, None),
        (6, "Nothing in Aland", None, None, None),
        (7, "Fire in Berrin", "Harbour", None, "aa"),
        (8, "in Aland and in Bor Land", None, None, None),
        (9, None, None, " ", None),
        (10, "at Reading, in Nowhere Town, at Xy, in Coy", None, None, None),
        (11, "in one two three four five Berrin", None, None, None),
        (12, "the Berrin naval base", None, None, None),
        (13, "west of Berrin", None, None, "ZZ"),
        (14, "in Berrinville", None, None, None),
        (15, "x " * 30_000 + "off Berrin", None, None, None),
    ]
    none = ("no-grounded-location", None, None, None)
    assert inferred(spark, rows) == {
        1: ("located", "gazetteer", "Berrin", "Bor Land"),
        2: none,
        3: ("located", "gazetteer", "Aldo Airport", "Aland"),
        4: ("located", "gazetteer", "Aldo Airport", "Aland"),
        5: ("country-only", "country", "Aland", "Aland"),
        6: ("country-only", "country", "Aland", "Aland"),
        7: ("country-only", "source", "Harbour", "Aland"),
        8: none,
        9: none,
        10: none,
        11: none,
        12: ("located", "gazetteer", "Berrin Naval Base", "Bor Land"),
        13: ("located", "gazetteer", "Berrin", "Bor Land"),
        14: none,
        15: ("located", "gazetteer", "Berrin", "Bor Land"),
    }
    assert inferred(spark, []) == {}


def test_mentions_against_patterns(spark):
    rng = random.Random(3)
    parts = ["in", "east", "of", "south", "near", "base", "naval", "air", "port", "town", "aldo", "big", "x", "In,", "of.", "Ålo"]
    phrases = ["aldo", "aldo port", "big town", "naval base", "big naval base", "x air base", "town", "aldo big x"]
    texts = [(i, " ".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(300)] + [(900, None), (901, "")]
    table = spark.createDataFrame([(p, len(p.split())) for p in phrases], "phrase string, size int")
    got = {(r.id, r.phrase): r.near for r in gazetteer.mentions(spark.createDataFrame(texts, "id long, t string"), "id", F.col("t"), table).collect()}
    expected = {}
    for i, t in texts:
        for p in phrases:
            if re.search(rf"(?<![a-z0-9]){p}(?![a-z0-9])", plain(t)) and (near(plain(t), p) or re.search(r"\b(?:airport|air base|port|harbour|harbor|terminal|naval base)$", p)):
                expected[i, p] = near(plain(t), p)
    assert got == expected and len(got) > 100


# --------------------------------------------------------------------- families


def grouped(links):
    low = {}
    for a, b in links:
        low.setdefault(a, a), low.setdefault(b, b)
    while True:
        new = dict(low)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


def found_components(spark, links, parts=3):
    table = spark.createDataFrame(links, "a long, b long").repartition(parts, "a", "b")
    rows = families.components(table).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: r.component for r in rows}


def test_components_of_chains_hubs_and_noise(spark):
    rng = random.Random(7)
    chain = [(i, i + 1) for i in range(60)]
    hub = [(500, 1000 + i) for i in range(2000)] + [(1999, 499)]
    noise = [(rng.randint(5000, 5400), rng.randint(5000, 5400)) for _ in range(250)]
    odd = [(7, 7), (None, 3), (3, None), (1, 0), (0, 1)]
    expected = grouped([x for x in chain + hub + noise if x[0] != x[1]])
    assert found_components(spark, chain + hub + noise + odd) == expected
    assert found_components(spark, []) == {} and found_components(spark, [(5, 5)]) == {}


def test_families_and_their_keys(spark):
    rows = [
        (1, "p1", "f1", None, "u1", None),
        (2, "p2", "f1", None, None, None),  # copy of 1
        (3, "p3", "f3", None, None, ["u1", "u1", "gone"]),  # links to 1
        (4, "p4", None, "chan:9", None, None),
        (5, "p5", "f5", "chan:9", None, []),  # forwarded from one origin
        (6, "p6", "f6", None, "u1", ["u9"]),  # has the URL of 1
        (7, "p7", None, None, None, None),
        (8, "p8", "f8", "chan:1", "u9", ["u9"]),  # 6 links to it, so its origin names the family of 1
        (9, "p9", None, None, "", [""]),
        (10, "p9", None, None, "u10", None),
        (11, "p9", None, None, None, ["u10"]),
    ]
    docs = spark.createDataFrame(rows, "id long, publisher string, fingerprint string, forward_key string, url string, links array<string>")
    alike = spark.createDataFrame([(7, 4, 0.95), (4, 7, 0.91), (7, 7, 1.0)], "a long, b long, score double")
    links = families.relationships(docs, alike)
    assert sorted((r.left_id, r.right_id, r.relationship, r.score) for r in links.collect()) == [
        (1, 2, "copied", 1.0), (1, 3, "linked-source", 0.9), (1, 6, "linked-source", 0.9), (4, 5, "forwarded", 1.0), (4, 7, "syndicated", 0.95), (6, 8, "linked-source", 0.9), (10, 11, "linked-source", 0.9)]
    got = {r.id: (r.root, r.members, r.family) for r in families.families(docs, links).collect()}
    first, second = (1, 5, "forward:chan:1"), (4, 3, "forward:chan:9")
    assert got == {1: first, 2: first, 3: first, 6: first, 8: first, 4: second, 5: second, 7: second, 9: (9, 1, "p9"), 10: (10, 2, "report:10"), 11: (10, 2, "report:10")}


def test_one_text_in_most_reports(spark):
    docs = spark.range(3000).selectExpr("id", "'p' as publisher", "if(id % 3 = 0, concat('f', id), 'same') as fingerprint", "cast(null as string) as forward_key", "cast(null as string) as url", "cast(null as array<string>) as links")
    links = families.relationships(docs)
    assert links.count() == 1999
    assert {(r.root, r.members, r.family) for r in families.families(docs, links).where("id % 3 > 0").collect()} == {(1, 2000, "report:same")}


# ------------------------------------------------------------------- assignment


def loop(items, pairs, link=0.82, review=0.65):
    """All reports in one list, one after another; every event keeps its reports."""
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    state, where, out = {}, {}, {}
    for x in sorted(items, key=lambda x: (x["at"], x["id"])):
        x = dict(x, tokens=set(x["tokens"]), entities=set(x["entities"]))
        options = []
        if x["revises"] in where:
            options = [(1.0, where[x["revises"]], [])]
        else:
            for e in state:
                if any(where.get(i) == e for i in near.get(x["id"], ())):
                    options.append((*(r := assignment.rating(x, state[e]))[:1], e, r[1]))
        options = [(s, e, v + (["barred"] if e in x["barred"] else [])) for s, e, v in options if e != x["current"]]
        best = min(((-s, e) for s, e, v in options if not v), default=(0.0, None))
        score = -best[0]
        if best[1] is not None and score >= link:
            outcome, event, stay = "link", best[1], best[1]
        elif best[1] is not None and score >= review:
            outcome, event, stay = "review", best[1], x["current"]
        elif x["current"] is not None:
            outcome, event, stay = "retain", x["current"], x["current"]
        else:
            outcome, event, stay = "create", x["id"], x["id"]
        gone = x["revises"] if outcome == "link" and x["revises"] in where else None
        if stay is not None:
            where[x["id"]] = stay
            if stay in state:
                assignment.absorbed(state[stay], x)
            else:
                state[stay] = assignment.opened(stay, x)
        if gone is not None:
            where.pop(gone)
        out[x["id"]] = (event, outcome, score, len(options), sum(bool(v) for _, _, v in options), gone)
    return out


def test_event_assignments_equal_one_loop(spark):
    path = os.environ.get("WAYFOLD_DATA", "/root/testdata") + "/sf0.001"
    items = graph_queries.observations(spark, path)
    pairs = [(r.a, r.b) for r in graph_queries.near_observations(items).collect()]
    rows = [r.asDict() for r in items.collect()]
    got = {r.id: tuple(r)[1:] for r in graph_queries.event_assignments(spark, path).collect()}
    expected = loop(rows, pairs)
    assert got == expected
    assert Counter(x[1] for x in got.values()).keys() == {"link", "review", "retain", "create"} and any(x[5] for x in got.values())


def test_ratings_are_the_columns(spark):
    """The score for single reports is the one that fusion has for columns."""
    path = os.environ.get("WAYFOLD_DATA", "/root/testdata") + "/sf0.001"
    items = graph_queries.observations(spark, path).where("id < 1200").withColumn("at", F.col("at").cast("timestamp"))
    keep = ["id", "at", "tokens", "entities", "lat", "lon", "family", "category", "identifiers"]
    b = items.select(*keep[:-1], F.transform_values("identifiers", lambda k, v: F.array(v)).alias("identifiers"))
    pairs = items.select((F.col("id") % 40).alias("g"), F.struct(*keep).alias("a")).join(b.select((F.col("id") % 40).alias("g"), F.struct("*").alias("b")), "g")
    got = {(r.a.id, r.b.id): (r.score, sorted(r.vetoes)) for r in fusion.event_score(pairs, "at").collect()}
    rows = {r.id: r.asDict() | {"tokens": set(r.tokens), "entities": set(r.entities)} for r in items.collect()}
    for (x, y), (score, vetoes) in got.items():
        s, v = assignment.rating(rows[x], assignment.opened(y, rows[y]))
        assert abs(s - score) < 1.1e-4 and sorted(v) == vetoes
    assert len(got) > 1000


def test_one_block_makes_many_units(spark):
    """Two hundred far chains of one block are units of their own, and give what the loop gives; revisions, repeats and nulls."""
    at = datetime(2024, 1, 1)
    base = {"title": "t", "tokens": ["a"], "entities": ["n"], "lat": 1.0, "lon": 1.0, "family": "news", "category": "news", "identifiers": {}, "revises": None, "current": None, "barred": []}
    items = [base | {"id": 10 * c + i, "at": at + timedelta(days=30 * c, hours=i)} for c in range(200) for i in range(3)]
    items += [base | {"id": 5, "at": at + timedelta(days=1), "revises": 1}, base | {"id": 6, "at": at + timedelta(days=2), "revises": 999, "tokens": []}]
    pairs = [(10 * c + i, 10 * c + i + 1) for c in range(200) for i in range(2)]
    kinds = "id long, at timestamp, title string, tokens array<string>, entities array<string>, lat double, lon double, family string, category string, identifiers map<string,string>, revises long, current long, barred array<long>"
    rows = [tuple(x[c] for c in assignment.COLUMNS) for x in items]
    near = spark.createDataFrame([*pairs, (1, 0), (3, 3), (None, 4), (4, 12345)], "a long, b long")
    got = {r.id: tuple(r)[1:] for r in assignment.assign(spark.createDataFrame(rows + [(None, *rows[0][1:])], kinds), near).collect()}
    assert got == loop(items, pairs) and got[5] == (0, "link", 1.0, 1, 0, 1) and got[6][1] == "create"
    assert assignment.assign(spark.createDataFrame([], kinds), near).count() == 0
