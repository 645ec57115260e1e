"""Literal passages, snapshots at many times, and what contradicts each claim, against loops."""

import hashlib
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from wayfold.operators import outcomes, snapshots, spans


def test_passages_of_any_length(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice(["ab", "b", "a", " ", "c d", "\n", "é", "  "]) for _ in range(40))) for i in range(60)] + [(90, None), (91, ""), (92, "w" * 3000 + " end")]
    cut = [(k, t[a : a + n]) for k, (t, a, n) in enumerate((rng.choice(texts[:60])[1], rng.randint(0, 30), rng.randint(1, 30)) for _ in range(150))]
    items = cut + [(500, None), (501, ""), (502, "zz none"), (503, "www"), (504, "w end"), (505, "e"), (505, "e")]
    got = sorted((r.k, r.i, r.start) for r in spans.literal(spark.createDataFrame(items, "k int, p string"), "p", spark.createDataFrame(texts, "i int, t string"), "t").collect())
    blank = [p for _, p in items if p and not p.strip(" \n")]
    expected = sorted((k, i, t.index(p)) for k, p in set(items) if p and p not in blank for i, t in texts if t and p in t)
    assert sorted(set(got)) == expected and len(expected) > 100
    none = spark.createDataFrame([], "k int, p string")
    assert spans.literal(none, "p", spark.createDataFrame(texts, "i int, t string"), "t").count() == 0


def test_snapshots_equal_a_scan_for_each_cutoff(spark):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(rng.choice("abc"), rng.randint(0, 9), rng.choice([None, 1, 2]), start + timedelta(days=rng.randint(0, 40)) if rng.random() < 0.95 else None, rng.random() < 0.5) for _ in range(300)]
    rows += [("late", 1, 1, start + timedelta(days=900), True), (None, 3, 1, start, False)]
    ends = [start + timedelta(days=d) for d in (-3, 0, 7, 7, 20, 33)]
    table = spark.createDataFrame(rows, "g string, doc int, fam int, at timestamp, good boolean")
    cutoffs = spark.createDataFrame([(e,) for e in [*ends, None]], "cutoff timestamp")
    got = {(r.g, r.cutoff): (r.docs, r.fams, r.good_rows, r.snapshot_hash) for r in snapshots.at_cutoffs(table, "g", "at", cutoffs, {"docs": "doc", "fams": "fam"}, {"good_rows": F.col("good")}).collect()}
    expected = {}
    for g in {r[0] for r in rows}:
        for e in set(ends):
            known = [r for r in rows if r[0] == g and r[3] is not None and r[3] <= e]
            counts = {"docs": len({r[1] for r in known}), "fams": len({r[2] for r in known if r[2] is not None}), "good_rows": sum(r[4] for r in known)}
            expected[g, e] = (*counts.values(), hashlib.sha256(",".join(f"{k}={counts[k]}" for k in sorted(counts)).encode()).hexdigest())
    assert got == expected
    assert snapshots.at_cutoffs(table, "g", "at", cutoffs.limit(0), {"docs": "doc"}, {}).count() == 0
    assert snapshots.at_cutoffs(table.limit(0), "g", "at", cutoffs, {"docs": "doc"}, {}).count() == 0


def test_every_claim_has_its_opposition(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("st"), rng.choice("pq"), rng.choice("xyz")) for i in range(80)] + [(900 + i, "s", "p", "x") for i in range(400)] + [(2000, "u", "p", "x"), (2001, None, "p", "x")]
    table = spark.createDataFrame([(*r, r[2] == "p") for r in rows], "i long, s string, p string, v string, single boolean")
    got = {r.i: (r.first_id, r.equal, r.contrary, r.contrary_id) for r in outcomes.opposition(table, "s", "i", "p", "v").collect()}
    for i, s, p, v in rows:
        same = [x[0] for x in rows if s is not None and x[1:] == (s, p, v)] or [i]
        other = [x[0] for x in rows if p == "p" and s is not None and x[1:3] == (s, p) and x[3] != v]
        assert got[i] == (min(same), len(same), len(other), min(other, default=None))
    assert len(got) == len(rows)
