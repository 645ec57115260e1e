"""Evidence operators on small frames."""

import datetime
import math
import random
import re

import pytest
from pyspark.sql import functions as F
from wayfold.functions import measures, text
from wayfold.operators import evidence, forecasts, fusion, ingest, joins, memory, pairs, places, work

T = datetime.datetime


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_text_functions(spark):
    assert one(spark, text.canonical_url(F.lit("HTTPS://Ex.org:443//a///b/?utm_x=1&b=2&a=1&ref=z#f"))) == "https://ex.org/a/b?a=1&b=2"
    # written by hand from the rules: only a scheme's own port goes, the root path stays, values are decoded and encoded again
    by_hand = {"http://ex.org:443/a": "http://ex.org:443/a", "https://ex.org:80/a": "https://ex.org:80/a", "http://ex.org:80": "http://ex.org/", "https://ex.org/": "https://ex.org/", "https://ex.org//": "https://ex.org/", "https://u:p@Ex.org/a/": "https://ex.org/a", "https://ex.org/?b&a=x%20y&a=%7E*": "https://ex.org/?a=x+y&a=~%2A&b=", "https://ex.org:x/a": "https://ex.org:x/a", " https://ex.org/a?&UTM_a=1#f ": "https://ex.org/a", "": ""}
    assert {u: one(spark, text.canonical_url(F.lit(u))) for u in by_hand} == by_hand
    assert one(spark, text.canonical_url(F.lit(None).cast("string"))) == ""
    assert one(spark, text.canonical_url(F.lit("mailto:x"))) == "mailto:x"
    assert one(spark, text.url_domain(F.lit("http://WWW.a.org:80/x"))) == "a.org"
    assert one(spark, text.tokens(F.lit("The big big Dog ran to it"), 3, text.STOP_WORDS)) == ["big", "dog", "ran"]
    assert one(spark, text.fingerprint(F.lit("a b c d e"))) is None
    assert one(spark, text.fingerprint(F.lit("A, b c d e f"))) == one(spark, text.fingerprint(F.lit("a b  c d e F!")))
    assert one(spark, text.sentences(F.lit("Short. This one is long enough! And the end of it"))) == ["This one is long enough!", "And the end of it"]
    assert [one(spark, text.script_language(F.lit(t))) for t in ("hello", "привет мир", "你好", "")] == ["en", "ru", "zh", "en"]
    assert [one(spark, text.normalized_value(F.lit(t))) for t in (" A b/c ", "!!", "5.5")] == ["a-b-c", "unknown", "5.5"]
    assert one(spark, text.clean(F.lit(" a \n b "))) == "a b"


def test_measures(spark):
    a, b, none = F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "bcde")), F.array().cast("array<string>")
    assert one(spark, measures.jaccard(a, b)) == pytest.approx(2 / 5) and one(spark, measures.overlap(a, b)) == pytest.approx(2 / 3)
    assert one(spark, measures.jaccard(none, none)) == 0 == one(spark, measures.overlap(a, none))
    v = lambda *x: F.array(*map(F.lit, x))
    assert one(spark, measures.cosine(v(1.0, 0.0), v(1.0, 1.0))) == pytest.approx(math.sqrt(0.5)) and one(spark, measures.cosine(v(1.0), v(1.0, 2.0))) == 0
    assert one(spark, measures.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(111.19, abs=0.01)
    assert one(spark, measures.haversine_km(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0))) is None
    assert one(spark, measures.in_box(F.lit(0.0), F.lit(-179.0), -10, 170, 10, -170)) and not one(spark, measures.in_box(F.lit(0.0), F.lit(0.0), -10, 170, 10, -170))
    assert one(spark, measures.pooled([(F.lit(0.8), 0.5), (F.lit(None).cast("double"), 0.5)])) == pytest.approx(0.8)
    assert one(spark, measures.grid_key(F.lit(0.3), F.lit(-0.3))) == "z6:180:359"


def test_versions(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, "b"), ("k", 4, "a"), ("l", 1, "a")], "key string, at int, body string")
    log = ingest.version_log(rows, ["key"], ["at"], F.col("body"))
    assert sorted((r.key, r.at, r.version) for r in log.collect()) == [("k", 1, 1), ("k", 3, 2), ("k", 4, 3), ("l", 1, 1)]
    assert sorted((r.key, r.at) for r in ingest.latest(log, ["key"], ["version"]).collect()) == [("k", 4), ("l", 1)]
    assert {r.key: r.previous_hash for r in ingest.predecessor(log, ["key"]).where("version = 1").collect()} == {"k": None, "l": None}
    late = spark.createDataFrame([("k", 2, "late"), ("l", 1, "same time"), ("m", 1, "new")], "key string, at int, body string")
    assert {r.key: r.body for r in ingest.upsert(rows.where("at = 4 or key = 'l'"), late, ["key"], "at").collect()} == {"k": "a", "l": "same time", "m": "new"}
    assert [r.key for r in ingest.append_missing(rows, late, ["key"]).collect()] == ["m"] == [r.key for r in ingest.deleted(late, rows, ["key"]).collect()]


def test_joins(spark):
    left = spark.createDataFrame([(1, "x", T(2024, 1, 10)), (2, "x", T(2024, 3, 1)), (3, "y", T(2024, 1, 1))], "i int, k string, at timestamp_ntz")
    right = spark.createDataFrame([(7, "x", T(2024, 1, 10)), (8, "x", T(2024, 1, 9, 23)), (9, "x", T(2023, 12, 1))], "j int, k string, start timestamp_ntz")
    assert sorted((r.i, r.j) for r in joins.band_join(left, right, "at", "start", 14, 1, ["k"]).collect()) == [(1, 7), (1, 8)]
    got = {r.i: r.j for r in joins.as_of(left, right, ["k"], "at", "start", ["j"], "j").collect()}
    assert got == {1: 7, 2: 7, 3: None}
    a = spark.createDataFrame([(1, 0.0, 179.9), (2, 89.9, 0.0), (3, 0.0, 0.0)], "a_id int, a_lat double, a_lon double")
    b = spark.createDataFrame([(1, 0.0, -179.9), (2, 89.9, 180.0), (3, 10.0, 10.0)], "b_id int, b_lat double, b_lon double")
    assert sorted((r.a_id, r.b_id) for r in joins.within_km(a, b, 100.0, 5.0).collect()) == [(1, 1), (2, 2)]


def test_evidence(spark):
    rows = spark.createDataFrame([("c", "f1", 0.5), ("c", "f1", 0.9), ("c", "f2", 0.4), ("d", "f1", 0.0)], "claim string, family string, weight double")
    got = {r.claim: (r.n_families, r.confidence) for r in evidence.noisy_or(rows, ["claim"], "family", "weight").collect()}
    assert got["c"] == (2, pytest.approx(1 - (1 - 0.78 * 0.9) * (1 - 0.78 * 0.4))) and got["d"] == (1, 0.05)
    claims = spark.createDataFrame([("s", "a", 2, 0.9, False, True), ("s", "b", 1, 0.3, False, True), ("t", "a", 1, 0.6, False, True), ("u", "a", 1, 0.6, True, True), ("v", "a", 2, 0.5, False, True), ("v", "b", 1, 0.4, False, True), ("w", "a", 2, 0.8, False, False), ("x", "a", 2, 0.8, False, False), ("x", "b", 1, 0.2, False, True)], "s string, o string, n_families long, base double, authoritative boolean, factual boolean")
    got = {(r.s, r.o): (r.truth, r.confidence) for r in evidence.truth_status(claims, "s", "o").collect()}
    assert got == {("s", "a"): ("disputed", 0.65), ("s", "b"): ("refuted", 0.9), ("t", "a"): ("unverified", 0.6), ("u", "a"): ("corroborated", 0.6), ("v", "a"): ("disputed", 0.5), ("v", "b"): ("unverified", 0.4), ("w", "a"): ("indeterminate", 0.55), ("x", "a"): ("disputed", 0.55), ("x", "b"): ("refuted", 0.8)}
    rows = spark.createDataFrame([("s", "p", "1", "f", 1), ("s", "p", "2", "f", 2), ("t", "p", "1", "f", 1), ("t", "p", "2", "g", 2), ("u", "p", "1", "f", 1)], "s string, p string, o string, f string, at int")
    got = {(r.s, r.o): r.state for r in evidence.contested(rows, ["s", "p"], "o", "f", "at").collect()}
    assert got == {("s", "1"): "superseded", ("s", "2"): "stands", ("t", "1"): "contested", ("t", "2"): "contested", ("u", "1"): "stands"}


def test_beta_posterior_waits_for_evidence(spark):
    rows = spark.createDataFrame([("p", "a", "confirmed")] * 3 + [("q", "a", "refuted")], "pub string, topic string, outcome string")
    got = {(r.pub, r.topic): (r.status, r.reliability) for r in evidence.beta_posterior(rows, "pub", "topic", F.lit(0.7)).collect()}
    assert got["p", "*"] == ("provisional", 0.7) and got["q", "a"] == ("contradiction-responsive", pytest.approx(5.6 / 9.5)) and len(got) == 4


def test_places(spark):
    cells = spark.createDataFrame([("c", "k", d, n) for d, n in ((1, 2), (2, 2), (3, 6), (4, 3))], "cell string, kind string, day int, n long")
    found = places.density_anomalies(cells, "cell", "kind").collect()
    assert [(r.day, r.score) for r in found] == [(3, pytest.approx(4 / 6))]
    members = spark.createDataFrame([("g", 1, 0.0, 0.0, 1.0), ("g", 2, 0.0, 1.0, 1.0), ("g", 3, 0.0, 5.0, 1.0), ("h", 4, 1.0, 1.0, 1.0)], "g string, i int, lat double, lon double, w double")
    assert {r.g: (r.medoid, r.members) for r in places.medoids(members, "g", "i", "lat", "lon", "w").collect()} == {"g": (2, 3), "h": (4, 1)}
    moves = spark.createDataFrame([(1, 1, 0.1), (1, 2, 0.4), (1, 3, 0.45)], "f int, at int, severity double")
    assert [r.at for r in places.changes(moves, ["f"], ["at"], "severity", 0.2).collect()] == [2]


def test_work(spark):
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 3), ("b", 1), ("c", 2)) for i in range(n)], "k string, i int")
    assert [(r.k, r.turn) for r in work.round_robin(rows, "k", ["i"], "a", 5).collect()] == [("b", 1), ("c", 1), ("a", 1), ("c", 2), ("a", 2)]
    spans = spark.createDataFrame([("k", 1, 3), ("k", 2, 4), ("k", 4, 5), ("k", 7, 8), ("k", 9, 6)], "k string, a int, b int")
    assert sorted((r.begins, r.ends, r.parts) for r in work.merged_intervals(spans, "k", "a", "b").collect()) == [(1, 5, 3), (7, 8, 1)]
    aliases = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99)], "i int, t int")
    assert {r.i: r.root for r in work.roots(aliases, "i", "t").collect()} == {1: 1, 2: 1, 3: 1, 4: None, 5: None, 6: 99}
    assert [r.i for r in work.page(rows.where("k = 'a'"), 0, "i", 1).collect()] == [1]
    assert one(spark, work.backoff_seconds(F.lit(3), 10.0, 1000.0, 5)) == 40.0


def test_forecasts(spark):
    priors = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.5), (2, "a", 0.99), (2, "b", 0.01)], "s int, h string, prior double")
    ratios = spark.createDataFrame([(1, "a", 3.0), (1, "a", 100.0)], "s int, h string, ratio double")
    got = {(r.s, r.h): r.posterior for r in forecasts.posteriors(priors, ratios, "s", "h").collect()}
    assert got[1, "a"] == pytest.approx((24 / 25) / (24 / 25 + 1 / 25)) and got[2, "b"] == pytest.approx(0.03 / 1.02)
    rows = spark.createDataFrame([(0.9, 1), (0.9, 1), (0.1, 0), (0.4, 1)], "p double, y int")
    r = forecasts.calibration(rows, "p", "y").first()
    assert r.n == 4 and r.brier == pytest.approx((0.01 * 3 + 0.36) / 4) and r.ece == pytest.approx((0.2 + 0.1 + 0.6) / 4)


def test_memory_ranks_by_rarity(spark):
    rows = spark.createDataFrame([(1, "common word here"), (2, "common rare word"), (3, "nothing"), (4, None)], "id int, t string")
    found = {r.id: r.score for r in memory.bm25(rows, ["id"], "t", ["common", "rare", "is"]).collect()}
    assert set(found) == {1, 2} and found[2] > found[1]


ITEM = "id string, tokens array<string>, entities array<string>, at timestamp_ntz, lat double, lon double, fingerprint string, family string, category string, title string, identifiers map<string,string>"
EVENT = ITEM.replace("map<string,string>", "map<string,array<string>>")


def event(i, words, entities, at, lat, lon, fp=None, family="hazard", category="flood", **ids):
    return (i, words.split(), entities.split(), at, lat, lon, fp, family, category, words, ids)


def scored(spark, score, left, right):
    pairs = fusion.candidates(spark.createDataFrame(left, ITEM).withColumn("block", F.lit("b")), spark.createDataFrame(right, EVENT).withColumn("block", F.lit("b")), "block", "at")
    return score(pairs.withColumns({"a": F.col("a").withField("at", F.col("a.at").cast("timestamp")), "b": F.col("b").withField("at", F.col("b.at").cast("timestamp"))}))


def test_situation_scores(spark):
    t = T(2024, 1, 10)
    left = [event("x", "big quake hits town", "e1 e2", t, 1.0, 1.0, "f", category="earthquake")]
    right = [event("same", "big quake hits town", "e1 e2", t, 1.0, 1.0), event("copy", "other", "", t, None, None, "f"), event("far", "big quake", "e1", T(2023, 12, 1), 1.0, 1.0), event("else", "none at all", "e9", t, 60.0, 60.0), event("early", "big quake hits town", "e1 e2", T(2024, 1, 9, 12), 1.0, 1.0), event("nowhere", "big quake", "e1 e2", t, None, None), event("title", "big quake hits town", "e1 e2", t, None, None)]
    rows = scored(spark, fusion.situation_score, left, right)
    got = {r.b.id: (round(r.score, 4), r.relationship, set(r.vetoes)) for r in rows.collect()}
    assert got.pop("early")[1:] == ("independent", {"quake time"})
    assert got == {"same": (1.0, "independent", set()), "copy": (0.98, "copied", set()), "else": (0.15, "independent", {"place", "hazard place", "quake place"}), "nowhere": (round(0.19 + 0.27 + 0.15 + 0.13, 4), "independent", {"hazard place unknown"}), "title": (round(0.38 + 0.27 + 0.15 + 0.13, 4), "independent", set())}
    assert [tuple(r)[:2] + (r.decision,) for r in fusion.decisions(rows).collect()] == [("x", "same", "link")]
    news = [event("n", " ".join(f"w{i}" for i in range(25)), "e1", t, None, None, category="traditional-news")]
    near = scored(spark, fusion.situation_score, news, [event("m", " ".join(f"w{i}" for i in range(24)), "e1", T(2023, 12, 30), None, None)]).first()
    assert near.relationship == "syndicated" and near.score == 0.9


def test_event_scores_and_vetoes(spark):
    t = T(2024, 1, 10)
    left = [event("x", "flood in the valley", "v", t, 1.0, 1.0, src="7")]
    right = [event("far", "flood in the valley", "v", t, 9.0, 1.0), event("other", "flood in the valley", "v", t, 1.0, 1.0, src=["8"]), event("news", "flood valley report", "v", t, None, None, family="news"), event("odd", "flood in the valley", "v", t, 1.0, 1.0, family="market"), event("one", "flood", "", t, 1.0, 1.0, src=["6", "7"])]
    rows = scored(spark, fusion.event_score, left, right)
    got = {r.b.id: set(r.vetoes) for r in rows.collect()}
    assert got == {"far": {"distance"}, "other": {"identifier"}, "news": set(), "odd": {"category"}, "one": set()}
    assert {r.b.id: r.score for r in rows.collect()}["news"] == pytest.approx(0.27 * 2 / 5 + 0.20 + 0.22 * 0.35 + 0.11 + 0.065)
    best = fusion.decisions(rows).first()
    assert best.event == "one" and best.score == pytest.approx(0.27 / 4 + 0.20 + 0.22 + 0.10 + 0.10 + 0.08) and best.decision == "review"
    quake = [event("q", "quake", "", t, 1.0, 1.0, category="Earthquake report")]
    got = {r.b.id: set(r.vetoes) for r in scored(spark, fusion.event_score, quake, [event("late", "quake", "", T(2024, 1, 9, 17), 1.0, 1.0), event("off", "quake", "", t, 2.0, 1.0)]).collect()}
    assert got == {"late": {"quake time"}, "off": {"quake place"}}
    # the limit is the observation's: 250 km for a hazard, though the event's family has 1000
    got = scored(spark, fusion.event_score, [event("h", "flood", "", t, 1.0, 1.0)], [event("n", "flood", "", t, 5.0, 1.0, family="news")]).first()
    assert got.vetoes == ["distance"]


def test_ordered_assignment_sees_earlier_items(spark):
    rows = spark.createDataFrame([("b", i, T(2024, 1, d), x) for i, d, x in ((1, 1, 0.0), (2, 2, 0.1), (3, 3, 0.5), (4, 4, 0.3), (5, 28, 0.5))] + [("c", 9, T(2024, 1, 1), 0.0)], "block string, i long, at timestamp_ntz, x double")
    found = fusion.ordered_assignment(rows, "block", "i", "at", lambda a, e: 1 - abs(a["x"] - e["x"]), 0.75)
    assert {r.i: r.event for r in found.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 9: 9}


def test_claims_of_items(spark):
    items = spark.createDataFrame([("s", "1", "Title", "quake", '{"magnitude": 5.5, "countries": ["A", "b", "A"], "status": null}')], "source string, external_id string, title string, category string, metadata string")
    got = {(r.predicate, r.value) for r in fusion.structured_claims(items, {"magnitude": "magnitude", "status": "status"}, {"countries": "country"}).collect()}
    assert got == {("event.category", "quake"), ("event.reported", "title"), ("magnitude", "5.5"), ("country", "a"), ("country", "b")}


def test_event_summary_and_memberships(spark):
    t = T(2024, 1, 1)
    rows = spark.createDataFrame([("e", "o1", "f1", "s1", "news", "late", 0.5, t, t), ("e", "o2", "f2", "s2", "quake", "best", 0.9, t, t), ("e", "o3", "f2", "s2", "quake", "third", 0.9, T(2024, 1, 2), t)], "event string, observation string, family string, source string, category string, title string, credibility double, captured_at timestamp_ntz, at timestamp_ntz")
    r = fusion.event_summary(rows).first()
    assert (r.title, r.category, r.families, r.observations) == ("best", "quake", 2, 3) and r.confidence == pytest.approx(0.42 + 0.28 + 0.12)
    log = spark.createDataFrame([(1, "link", "a", "e1"), (2, "move", "a", "e2"), (3, "link", "b", "e1"), (4, "remove", "b", None), (5, "link", "c", "e1"), (6, "separate", "c", "e1"), (7, "link", "c", "e1"), (8, "link", "d", "e1"), (9, "separate", "d", "e1"), (10, "link", "d", "e2")], "seq int, op string, observation string, event string")
    assert {r.observation: r.event for r in fusion.memberships(log).collect()} == {"a": "e2", "d": "e2"}


def test_pairs_of_similar_sets(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 40)
    monkeypatch.setattr(pairs, "COMMON", 3)
    rng = random.Random(2)
    words = [f"w{i:02}" for i in range(90)]
    rows = [(i, rng.choice("xy"), rng.choice("pq"), " ".join(rng.sample(words, rng.choice([1, 2, 5, 20, 40])))) for i in range(300)]
    rows += [(900, "x", "p", "first words differ here alpha beta gamma"), (901, "x", "p", "other start and here alpha beta gamma"), (902, "x", "q", "first words differ here alpha beta gamma"), (903, "x", "q", "Other start, and HERE alpha beta gamma"), (904, "x", "p", "first words differ; here alpha beta gamma")]
    rows += [(910, "x", "p", None), (911, "x", "p", "a b"), (912, None, "p", "first words differ here"), (913, None, "p", "first words differ there")]
    first, expected = {}, set()
    for i, lang, source, t in rows:
        every = re.findall("[a-z0-9]+", (t or "").lower())
        if lang and any(len(w) > 2 for w in every):
            first.setdefault((lang, source, *every), (i, lang, source, {w for w in every if len(w) > 2}))
    for a in first.values():
        for b in first.values():
            k, every = len(a[3] & b[3]), len(a[3] | b[3])
            if a[0] < b[0] and a[1:3] == b[1:3] and 10 * k >= 3 * every:
                expected.add((a[0], b[0], k, every))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")
    sets = pairs.token_sets(docs, "doc_id", "text", ["lang", "source"])
    got = [tuple(r) for r in pairs.similar_sets(sets, "doc_id", ["lang", "source"], 30).collect()]
    assert len(got) == len(expected) and set(got) == expected and {(900, 901), (902, 903)} <= {g[:2] for g in got}
    assert pairs.similar_sets(sets.limit(0), "doc_id", ["lang", "source"], 30).count() == 0


def test_long_alias_chains_end(spark):
    chain = [(i, i - 1 if i else None) for i in range(300)] + [(1000 + i, 1000 + (i + 1) % 3) for i in range(3)]
    aliases = spark.createDataFrame(chain, "i long, t long")
    expected = {i: 0 for i in range(300)} | {1000 + i: None for i in range(3)}
    assert {r.i: r.root for r in work.roots(aliases, "i", "t").collect()} == expected
    assert {r.i: r.root for r in work.roots(aliases, "i", "t", 4).collect()} == expected


def test_best_cosine_of_every_vector(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 30)
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), [rng.gauss(0, 1) for _ in range(rng.choice([3, 3, 4]))]) for i in range(1, 150)] + [(200, "a", [0.0, 0.0, 0.0]), (201, "alone", [1.0]), (202, None, [1.0]), (203, "a", None)]
    expected = {}
    for i, g, v in rows:
        others = [w for j, h, w in rows if j != i and h == g and w]
        if g and v and others:
            size = lambda x: math.sqrt(sum(y * y for y in x))
            expected[i] = max(sum(x * y for x, y in zip(v, w)) / (size(v) * size(w)) if len(v) == len(w) and size(v) and size(w) else 0.0 for w in others)  # noqa: B905
    got = {r.i: r.best for r in pairs.best_cosine(spark.createDataFrame(rows, "i long, g string, v array<float>"), "i", "g", "v").collect()}
    assert len(got) == 150 and got == pytest.approx(expected, abs=1e-6)
