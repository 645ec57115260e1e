"""What lets operators grow: plans without broadcasts of what grows, chunks, and the same results as loops in Python."""

import math
import os
import random
import re
import time
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import functions as F
from wayfold import session
from wayfold.functions import text as tx
from wayfold.operators import assignment, families, joins, outcomes, pairs, places
from wayfold.plans import evidence_queries, record_queries, view_queries, world_queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def km(a, b):
    lat1, lon1, lat2, lon2 = map(math.radians, (*a, *b))
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2)))


def test_nothing_is_broadcast_among_reports_of_one_place(spark):
    rows = spark.range(50).select("id", (F.col("id") % 3).alias("place"), F.timestamp_seconds(F.col("id") * 40_000).alias("at"))
    both = joins.band_join(rows, rows.select("place", F.col("id").alias("other"), F.col("at").alias("start")), "at", "start", 14, 1, ["place"])
    assert "Broadcast" not in plan(both)
    assert both.count() == sum(a % 3 == b % 3 and -14 * 86400 <= (b - a) * 40_000 <= 86400 for a in range(50) for b in range(50))
    assert "Broadcast" not in plan(families.star(rows, "place", "id", F.lit(True)))
    assert "Broadcast" not in plan(families.met(rows, "place", rows.groupBy("place").agg(F.max("id").alias("m")), "id"))


def test_medoids_in_chunks_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(places, "TILE", 7)
    draw = random.Random(5)
    rows = [(g, 100 * g + i, draw.uniform(-90, 90), draw.uniform(-180, 180), draw.uniform(0, 9)) for g in range(3) for i in range((1, 2, 60)[g])]
    rows += [(2, 50, *rows[-1][2:]), (4, 7, 0.0, 0.0, 1.0), (4, 6, 0.0, 90.0, 1.0)]  # one place twice; a tie
    found = {r.g: (r.medoid, r.members) for r in places.medoids(spark.createDataFrame(rows, "g int, i long, lat double, lon double, w double"), "g", "i", "lat", "lon", "w").collect()}
    for g in (0, 1, 2, 4):
        mine = [r for r in rows if r[0] == g]
        far = lambda r: round(sum(o[4] * km(r[2:4], o[2:4]) for o in mine), 3)  # noqa: E731, B023
        assert found[g] == (min(mine, key=lambda r: (far(r), r[1]))[1], len(mine))


def test_a_member_of_unknown_place_is_no_medoid_beside_others(spark):
    rows = spark.createDataFrame([(1, 1, None, None, 1.0), (1, 2, 0.0, 0.0, 1.0), (1, 3, 0.0, 50.0, 2.0), (2, 4, None, None, 1.0)], "g int, i long, lat double, lon double, w double")
    assert {r.g: (r.medoid, r.members) for r in places.medoids(rows, "g", "i", "lat", "lon", "w").collect()} == {1: (3, 3), 2: (4, 1)}


def test_places_within_reach_go_to_all_partitions(spark):
    draw = random.Random(6)
    a, b = ([(i, draw.uniform(-90, 90), draw.uniform(-180, 180)) for i in range(n)] for n in (60, 300))
    found = joins.within_km(spark.createDataFrame(a, "a_id long, a_lat double, a_lon double"), spark.createDataFrame(b, "b_id long, b_lat double, b_lon double"), 900.0, 2.0)
    assert "Broadcast" not in plan(found) and "REPARTITION_BY_NUM" in plan(found)
    assert {(r.a_id, r.b_id) for r in found.collect()} == {(i, j) for i, *p in a for j, *q in b if km(p, q) <= 900}


def test_texts_that_begin_alike_are_compared_in_tiles(spark, tmp_path):
    docs = [(1, "one two red green", "en", "a"), (2, "One, two! red green blue", "en", "a"), (3, "one two red GREEN", "en", "a"), (4, "two one red green", "en", "a"), (5, "one two zzz yyy xxx www vvv", "en", "a"), (6, None, "en", "a"), (7, "a b", "en", "a"), (8, "one two red green blue grey", None, "a"), (9, "one two red green blue grey", "en", "a")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    found = record_queries.pair_lexical_scores(spark, str(tmp_path))
    assert "array_intersect" not in plan(found)  # no pair of whole token lists in a join
    # 3 is a copy of 1, 9 one of 8, whose null language has no equal.
    assert [tuple(r) for r in found.collect()] == [(1, 2, 4, 5)]


def test_sets_are_sent_to_a_bounded_number_of_tiles(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 5)
    monkeypatch.setattr(pairs, "USUAL", 6)
    draw = random.Random(11)
    rows = [(i, "g", sorted(draw.sample(range(-40, 40), draw.choice([8, 12, 16])))) for i in range(400)]
    sets = spark.createDataFrame(rows, "i long, g string, tokens array<long>")
    want = {(i, j, k, n) for i, _, x in rows for j, _, y in rows if i < j and 10 * (k := len({*x} & {*y})) >= 3 * (n := len({*x} | {*y}))}
    tiles = {}
    for sides, most in ((2, 16_000), (2, 100)):
        monkeypatch.setattr(pairs, "SIDES", sides)
        monkeypatch.setattr(pairs, "MOST", most)
        found = pairs.similar_sets(sets, "i", ["g"], 30)
        assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
        assert "REPARTITION_BY_NUM" in plan(found)
        placed = found._jdf.queryExecution().optimizedPlan().children().head()
        tiles[most] = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, placed).count()
    # Two chunks for each of two classes, whatever the rows; more only where chunks would be too large.
    assert tiles[16_000] <= 4 * len(rows) < tiles[100]


def test_texts_that_begin_differently_are_compared(spark, tmp_path):
    docs = [(1, "one two red green", "en", "a"), (2, "red green one two", "en", "b"), (3, "ONE two red green", "en", "b"), (4, "green, red two one blue", "en", "a"), (5, "red green one two!", "en", "a"), (6, "red green one two", None, "a")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    # 5 says what 2 says, but in another source, so it is compared in its own.
    assert {tuple(r) for r in record_queries.pair_lexical_scores(spark, str(tmp_path)).collect()} == {(1, 4, 4, 5), (1, 5, 4, 4), (4, 5, 4, 5), (2, 3, 4, 4)}


def test_nearest_cosines_in_chunks_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(pairs, "TILE", 5)
    draw = random.Random(8)
    rows = [(i, draw.choice([1, 2, None]), [float(draw.randint(-2, 2)) for _ in range(3)]) for i in range(60)] + [(60, 1, None), (61, 2, [1.0])]
    df = spark.createDataFrame(rows, "i long, g int, v array<double>")

    def cosine(a, b):
        if a is None or b is None:
            return None
        na, nb = (math.sqrt(sum(x * x for x in v)) for v in (a, b))
        return round(sum(x * y for x, y in zip(a, b, strict=True)) / (na * nb), 6) + 0.0 if len(a) == len(b) and na * nb > 0 else 0.0

    wanted = set()
    for i, g, v in rows:
        if i % 3 == 0 and g is not None:
            others = sorted((-(s if (s := cosine(v, w)) is not None else -9), j, s) for j, h, w in rows if h == g and j != i)
            wanted |= {(i, j, s, n + 1) for n, (_, j, s) in enumerate(others[:4])}
    assert {tuple(r) for r in pairs.nearest_cosines(df.where("i % 3 = 0"), df, "i", "g", "v", 4, 6).collect()} == wanted


def test_every_vector_asks_for_its_nearest(spark, tmp_path):
    rows = [(i, i % 2, [1.0, float(i)]) for i in range(1, 16)] + [(100 + i, 7, [2.0, 2.0]) for i in range(40)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {}
    for r in evidence_queries.embedding_cosine_topk(spark, str(tmp_path)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert found.keys() == {i for i, *_ in rows} and all(len(x) == 5 for x in found.values())
    # Copies are ties: the five smallest ids, whichever of them asks.
    assert all(sorted(found[100 + i]) == list(enumerate([x for x in range(100, 140) if x != 100 + i][:5], 1)) for i in range(40))


def test_a_long_line_without_an_end_takes_no_square(spark):
    draw = random.Random(9)
    texts = ["".join(draw.choice("abc .!?\n") for _ in range(400)) for _ in range(30)] + ["", "a sentence. and what follows it\n", "no end at all here", "cut off by the line\nthen a sentence!\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = {r.i: r.s for r in df.select("i", tx.sentences(F.col("t"), 3, 20).alias("s")).collect()}
    assert found == {i: [s for s in (m.strip(" ") for m in re.findall(r"[^.!?\n]+(?:[.!?]|\Z)", t)) if 3 <= len(s) <= 20] for i, t in enumerate(texts)}
    began = time.time()
    assert spark.range(1).select(tx.sentences(F.concat(F.repeat(F.lit("word "), 100_000), F.lit("\nOne sentence here."))).alias("s")).head().s == ["One sentence here."]
    assert time.time() - began < 20  # half a million characters: minutes where each start is tried


def test_only_keys_of_very_many_rows_are_dealt_to_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(i, 7 if i % 3 == 0 else i % 40 if i % 5 else None) for i in range(200)], "i long, k int")
    other = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = sorted((i, k * 10 if k is not None and k < 30 else None) for i, k in ((r.i, r.k) for r in rows.collect()))
    light = families.met(rows, "k", other, "i")
    assert plan(light).count("Exchange hashpartitioning") <= 2 and "pmod" not in plan(light)
    monkeypatch.setattr(families, "BIG", 50)
    dealt = families.met(rows, "k", other, "i")
    assert "pmod" in plan(dealt) and "Broadcast" not in plan(dealt)
    for found in (light, dealt):
        assert sorted((r.i, r.v) for r in found.collect()) == want


def test_links_of_a_block_leave_few_for_the_rounds(spark, monkeypatch):
    """A random mesh of 40 blocks: what goes through the rounds is the links between blocks, not those inside."""
    draw, left = random.Random(12), {}
    links = [(100 * g + i, 100 * g + draw.randrange(i), g) for g in range(40) for i in range(1, 100)] + [(100 * g + 7, 100 * (g - 1) + 50, 99) for g in range(1, 30)]
    draw.shuffle(links)
    df = spark.createDataFrame(links, "a long, b long, g int").repartition(4)
    monkeypatch.setattr(families, "written", lambda df, name, put=session.written: (out := put(df, name), left.setdefault(name, out.count()))[0])
    found = {r.id: r.component for r in families.components(df, "g").collect()}
    assert left["work"] <= 60 and found == {i: 0 if i < 3000 else i // 100 * 100 for i in range(4000)}


def test_bands_of_any_width_equal_a_loop(spark):
    draw = random.Random(13)
    rows = [(i, draw.choice("ab"), datetime(1969, 12, 20) + timedelta(minutes=draw.randrange(40 * 1440))) for i in range(150)]
    df = spark.createDataFrame(rows, "i int, k string, at timestamp_ntz")
    other = df.select("k", F.col("i").alias("j"), F.col("at").alias("start"))
    for back, ahead in ((0, 0), (1, 0), (14, 1), (2, 5)):
        want = sorted((i, j) for i, k, t in rows for j, m, s in rows if k == m and t - timedelta(days=back) <= s <= t + timedelta(days=ahead))
        assert sorted((r.i, r.j) for r in joins.band_join(df, other, "at", "start", back, ahead, ["k"]).collect()) == want
    made = joins.band_join(df, other, "at", "start", 14, 1, ["k"])._jdf.queryExecution().optimizedPlan().toString()
    assert "/ 8" in made  # a row goes to the three or so spans of its band, not to each of its days


def test_rows_of_a_batch_are_unpacked(spark):
    kinds = pa.schema([("component", pa.int64()), ("at", pa.timestamp("us", "UTC")), ("tokens", pa.list_(pa.string())), ("identifiers", pa.map_(pa.string(), pa.string())), ("near", pa.list_(pa.int64())), ("lat", pa.float64())])
    rows = [(i, datetime(2024, 1, 1 + i, 3), None if i == 2 else ["x", f"t{i}"], [("k", str(i))] * (i % 2), [i, 5], None if i == 1 else 0.5) for i in range(6)]
    batch = pa.record_batch([pa.array([r[c] for r in rows], kinds.field(c).type) for c in range(6)], schema=kinds)
    want = [(i, {"at": at, "tokens": set(t or ()), "identifiers": dict(m), "near": n, "lat": lat}) for i, at, t, m, n, lat in rows]
    assert list(assignment.unpacked(batch)) == want and list(assignment.unpacked(batch.slice(2, 3))) == want[2:5] and list(assignment.unpacked(batch.slice(0, 0))) == []


def test_opposition_reads_its_claims_once(spark, monkeypatch):
    claims = spark.createDataFrame([(i, i % 2, "p" if i % 3 else None, "ab"[i % 5 // 3], True) for i in range(60)], "id long, situation long, predicate string, value string, single boolean")
    runs = []
    for big in (50_000, 3):
        monkeypatch.setattr(families, "BIG", big)
        found = outcomes.opposition(claims, "situation", "id", "predicate", "value")
        assert plan(found).count("Exchange hashpartitioning") <= 2 and "ExistingRDD" not in plan(found)  # read back, not worked out again
        runs.append(sorted(map(tuple, found.collect()), key=repr))
    rows = [(r.id, r.situation, r.predicate, r.value) for r in claims.collect()]
    group = lambda r: [o for o in rows if o[1:3] == r[1:3] and r[2] is not None]
    want = []
    for r in rows:
        mine, others = [o[0] for o in group(r) if o[3] == r[3]] or [r[0]], [o[0] for o in group(r) if o[3] != r[3]]
        want.append((r[0], min(mine), len(mine), len(others), min(others, default=None)))
    assert runs[0] == runs[1] == sorted(want, key=repr)


def test_partitions_of_lines_grow_with_the_table(spark, monkeypatch):
    data = os.environ.get("WAYFOLD_DATA", "/root/testdata") + "/sf0.001"
    splits = spark.read.parquet(f"{data}/lineitem.parquet").rdd.getNumPartitions()
    for query in (world_queries.claim_dedup, view_queries.article_framing):
        for each in (8, 50):
            monkeypatch.setattr(session, "PER_SPLIT", each)
            told = plan(query(spark, data))
            assert told.count("Exchange hashpartitioning") == told.count("REPARTITION_BY_NUM") == 2 and told.count(f", {each * splits})") == 2
