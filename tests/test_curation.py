"""Operations on events, selection under ceilings, shapes; each against a plain loop."""

import json
import random

import pytest
from pyspark.sql import functions as F
from wayfold.functions.geometry import shape
from wayfold.operators import operations, selection


def plain_replay(events, members, log):
    """One loop over whole snapshots: memberships after every operation, and each operation's status."""
    born = {e: (0, b) for e, b in events}
    place, aliases, kept, status, undone, after = dict(members), {}, {}, {}, {}, {0: dict(members)}
    lit = {}

    def root(e):
        while e in aliases:
            e = aliases[e]
        return e

    def show(seq, live):
        if seq in undone:
            show(undone[seq], not live)
            status[undone[seq]] = "reversed" if live else "applied"
        elif seq in lit:
            a, b = lit[seq]
            if live:
                aliases[a] = b
            elif aliases.get(a) == b:
                del aliases[a]

    for seq, kind, left, right, named, target in log:
        status[seq] = "refused"
        if kind == "merge":
            a, b = root(left), root(right)
            if a != b and a in born and b in born:
                win, lose = sorted((a, b), key=lambda e: (born[e], e))
                kept[seq] = {o: e for o, e in place.items() if e in (a, b)}
                place = {o: win if e == lose else e for o, e in place.items()}
                aliases[lose], lit[seq], status[seq] = win, (lose, win), "applied"
        elif kind == "split":
            source = root(left)
            if named and all(place.get(o) == source for o in named) and right != source and right not in aliases:
                born.setdefault(right, (1, seq))
                kept[seq] = {o: e for o, e in place.items() if e == source}
                place |= dict.fromkeys(named, right)
                status[seq] = "applied"
        elif kind == "reattribute":
            event = root(right)
            if len(named) == 1 and named[0] in place and event in born and place[named[0]] != event:
                kept[seq] = {named[0]: place[named[0]]}
                place = place | {named[0]: event}
                status[seq] = "applied"
        elif kind == "rollback" and status.get(target) == "applied":
            undone[seq] = target
            kept[seq] = {o: place[o] for o in kept[target]}
            place = place | kept[target]
            show(target, False)
            status[target], status[seq] = "reversed", "applied"
        after[seq] = dict(place)
    return after, status


@pytest.mark.parametrize("seed", range(3))
def test_operations_equal_one_loop(spark, seed):
    rng = random.Random(seed)
    events = [(f"e{i}", rng.randrange(20)) for i in range(14)]
    members = [(f"o{i}", f"e{rng.choice([0, 0, 0, rng.randrange(14)])}") for i in range(60)]
    log, names = [], [e for e, _ in events] + ["gone"]
    for seq in range(1, 61):
        kind = rng.choice(["merge", "merge", "split", "reattribute", "rollback", "rollback", "paint"])
        if kind == "rollback":
            log.append((seq, kind, None, None, [], rng.randrange(max(1, seq - 8), seq + 1)))
        elif kind == "split":
            so_far = plain_replay(events, members, log)[0][seq - 1]
            one = rng.choice(sorted(so_far))
            inside = [o for o, e in so_far.items() if e == so_far[one]]
            log.append((seq, kind, so_far[one], f"s{seq}", sorted(rng.sample(inside, min(2, len(inside)))), None))
            names.append(f"s{seq}")
        else:
            log.append((seq, kind, rng.choice(names), rng.choice(names), [rng.choice(members)[0]] if kind == "reattribute" else [], None))
    after, status = plain_replay(events, members, log)
    assert {"applied", "refused", "reversed"} <= set(status.values())
    held = spark.createDataFrame(members, "observation string, event string")
    done = operations.replay(spark.createDataFrame(events, "event string, born long"), held, spark.createDataFrame(log, operations.LOG).repartition(3)).cache()
    ways = operations.histories(held, done).collect()
    for seq, want in after.items():
        assert {r.observation: r.event for r in ways if r.from_seq <= seq and (r.to_seq is None or r.to_seq > seq)} == want, seq
    assert {r.seq: r.status for r in done.where("what = 'operation'").collect()} == status


def test_undoing_an_undoing(spark):
    events = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "event string, born long")
    members = spark.createDataFrame([("x", "a"), ("y", "b"), ("y", "b"), (None, "a"), ("z", "free")], "observation string, event string")
    log = spark.createDataFrame([(1, "merge", "b", "a", [], None), (2, "rollback", None, None, [], 1), (3, "rollback", None, None, [], 2), (4, "rollback", None, None, [], 1), (5, "rollback", None, None, [], 1), (None, "merge", "a", "b", [], None)], operations.LOG)
    done = operations.replay(events, members, log)
    ways = operations.histories(members, done)
    at = lambda n: {r.observation: r.event for r in operations.as_of(ways, n).collect()}
    assert [at(n)["y"] for n in range(6)] == ["b", "a", "b", "a", "b", "b"]
    assert at(5)["z"] == "free" and len(at(5)) == 3
    assert {(r.from_seq, r.to_seq) for r in done.where("what = 'alias'").collect()} == {(1, 2), (3, 4)}
    assert {r.seq: r.status for r in done.where("what = 'operation'").collect()} == {1: "reversed", 2: "reversed", 3: "applied", 4: "applied", 5: "refused"}
    none = log.limit(0)
    assert operations.replay(events, members, none).count() == 0
    assert operations.histories(members, operations.replay(events, members, none)).count() == 3


def plain_queue(rows, active, per_publisher, overall, most):
    count, total, taken = dict(active), {}, []
    for (_, kind), n in active.items():
        total[kind] = total.get(kind, 0) + n
    for turn, publisher, kind in sorted(rows):
        if len(taken) == most:
            break
        if kind in per_publisher:
            if count.get((publisher, kind), 0) >= per_publisher[kind] or total.get(kind, 0) >= overall[kind]:
                continue
            count[publisher, kind] = count.get((publisher, kind), 0) + 1
            total[kind] = total.get(kind, 0) + 1
        taken.append(turn)
    return taken


@pytest.mark.parametrize("most", [30, 10_000])
def test_ceilings_equal_one_loop(spark, most):
    rng = random.Random(most)
    rows = [(i, rng.choice("aaaaaabcdefgh"), rng.choice(["fresh", "backfill", "full"])) for i in range(900)]
    active = {("a", "fresh"): 3, ("b", "backfill"): 9, ("zz", "fresh"): 4}
    per, overall = {"fresh": 20, "backfill": 9}, {"fresh": 70, "backfill": 40}
    df = spark.createDataFrame(rows, "turn long, publisher string, kind string")
    opened = spark.createDataFrame([(*k, n) for k, n in active.items()], "publisher string, kind string, n long")
    found = selection.within_ceilings(df, "publisher", "kind", "turn", opened, per, overall, most).orderBy("place").collect()
    assert [r.turn for r in found] == plain_queue(rows, active, per, overall, most)
    assert [r.place for r in found] == list(range(len(found)))
    assert selection.within_ceilings(df.limit(0), "publisher", "kind", "turn", opened, per, overall, most).count() == 0


def test_turns_and_places(spark):
    rows = [(i, p) for i, p in enumerate(["b"] * 50 + ["a", "c", "a", None])]
    df = spark.createDataFrame(rows, "version long, publisher string")
    found = selection.turns(df, "publisher", [F.col("version")], "version", 7, "a").orderBy("turn").collect()
    assert [(r.publisher, r.version) for r in found] == [("b", 0), ("c", 51), ("a", 50), ("b", 1), ("a", 52), ("b", 2), ("b", 3)]
    numbers = selection.numbered(df, [F.col("publisher"), F.col("version")], "n", 5).orderBy("n").collect()
    assert [r.n for r in numbers] == list(range(54)) and [r.version for r in numbers[:3]] == [53, 50, 52]


def test_shapes_of_any_depth(spark):
    deep = lambda n: "[" * n + "10,20],[30,40]" + "]" * (n - 1)
    rows = [(n, f'{{"type":"T","coordinates":{deep(n)}}}' if n > 1 else '{"type":"T","coordinates":[10,20]}', 1.0, 2.0) for n in range(1, 12)]
    many = {"type": "LineString", "coordinates": [[1.25, 2.5]] * 5000 + [[9, 9]] * 40_000}
    rows += [(20, None, 5.0, 6.0), (21, "{", None, 6.0), (22, '{"coordinates":[]}', 5.0, 6.0), (23, '{"coordinates":["1","2"]}', 5.0, 6.0), (24, '{"coordinates":[[true,1],[200,1],[7,8,9]]}', None, None), (25, json.dumps(many), None, None), (26, "[1,2]", 5.0, 6.0)]
    df = spark.createDataFrame(rows, "id int, text string, lat double, lon double")
    plan = df.select("id", shape(F.col("text"), F.col("lat"), F.col("lon")).alias("s"))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r.id: r.s for r in plan.collect()}
    assert (got[1].latitude, got[1].longitude, got[1].points) == (20.0, 10.0, 1)
    for n in range(2, 10):
        assert (got[n].latitude, got[n].longitude, got[n].points, got[n].west, got[n].north, got[n].type) == (30.0, 20.0, 2, 10.0, 40.0, "T"), n
    assert all((got[n].latitude, got[n].type) == (1.0, "Point") for n in (10, 11))
    assert all((got[n].latitude, got[n].longitude, got[n].type) == (5.0, 6.0, "Point") for n in (20, 22, 23, 26)) and got[21] is None
    assert (got[24].longitude, got[24].points) == (7.0, 1) and json.loads(got[24].geometry)["coordinates"][2] == [7, 8, 9]
    assert (got[25].points, got[25].north) == (5000, 2.5) and json.loads(got[25].geometry) == {"type": "Point", "coordinates": [1.25, 2.5]}


def test_components_are_replayed_in_a_stream_of_batches(spark):
    n = 40
    events = spark.range(2 * n).select(F.concat(F.lit("e"), "id").alias("event"), F.col("id").alias("born"))
    log = spark.range(n).select(F.col("id").alias("seq"), F.lit("merge").alias("kind"), F.concat(F.lit("e"), 2 * F.col("id")).alias("left"), F.concat(F.lit("e"), 2 * F.col("id") + 1).alias("right"), F.lit(None).cast("array<string>").alias("observations"), F.lit(None).cast("long").alias("target_seq"))
    members = spark.range(6 * n).select(F.concat(F.lit("o"), "id").alias("observation"), F.concat(F.lit("e"), F.col("id") % (2 * n)).alias("event"))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "2")  # a component's three rows never fit
        done = operations.replay(events, members, log)
        assert "MapInArrow" in done._jdf.queryExecution().executedPlan().toString()
        rows = done.collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((r.seq, r.status, r.moved) for r in rows if r.what == "operation") == [(i, "applied", 1) for i in range(n)]
    assert sorted((r.token, r.value) for r in rows if r.what == "member" and r.to_seq is None) == sorted((f"e:e{i}", f"e{i // 2 * 2}") for i in range(2 * n))
