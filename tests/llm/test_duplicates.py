"""Near duplicates and components against brute force; the pipeline's stages."""

import math
import random
import re

import corpus_pipeline
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from wayfold.llm import embed_dedup, minhash
from wayfold.llm.common import connected_components


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randint(100, 260), rng.randint(100, 260)) for _ in range(110)] + [(500, i) for i in range(501, 600)] + [(7, 7)]
    df = spark.createDataFrame([*edges, (None, 3), edges[0]], "a long, b long").repartition(7)
    got = {r.id: r.component for r in connected_components(df).collect()}
    edges = [(a, b) for a, b in edges if a != b]
    assert got == components({n for e in edges for n in e}, edges)
    assert connected_components(df.limit(0)).count() == 0


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rng.randint(60, 300))]
        for _ in range(rng.randint(2, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
        rows.append(" ".join(base).upper())
    passage = " ".join(word() for _ in range(55))
    rows += [" ".join(word() for _ in range(rng.randint(1, 200))) + " " + passage for _ in range(30)]
    rows += [None, "", " \n ", "one two", "One  two\n", "one two three", "É one two three four", "é one two three four", "x " * 30_000, "x " * 20_000]
    return list(enumerate(rows))


def test_estimate_loses_less_than_bands():
    n, chance = minhash.MINIMA, 2.0**-minhash.BITS
    for s in (0.8, 0.85):
        p, least = s + (1 - s) * chance, s - minhash.MARGIN
        lost = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1) if (k / n - chance) / (1 - chance) < least - 1e-12)
        assert lost < (1 - s**minhash.ROWS) ** minhash.BANDS / 10


def test_minhash_against_all_pairs(spark):
    rows = near_corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    sets = {i: shingles(t) for i, t in rows}
    for percent in (80, 85):
        links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
        expected = {i: (len(sets[i]), c, c == i) for i, c in components(sets, links).items()}
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, percent).collect()}
        assert got == expected
    kept = minhash.keep_one(docs, 80)
    assert kept.columns == docs.columns


def test_minhash_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b  c d e f"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("3", 3, True), ("None", None, True)]
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(str(r.doc_id) for r in minhash.keep_one(docs).collect()) == ["1", "1", "3", "None"]


def test_estimate_counts_equal_minima(spark):
    flips, factors = minhash.sketch_parameters()
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 400, dtype=np.uint64)
    other = np.concatenate([base[:300], rng.integers(0, 2**64, 100, dtype=np.uint64)])
    a, b = (minhash.sketch(np.unique(x), flips, factors)[0].tolist() for x in (base, other))
    fields = ", ".join(f"{s} long" for s in minhash.SIGNATURE)
    left, right = (spark.createDataFrame([(1, *x)], f"id int, {fields}") for x in (a, b))
    got = left.alias("a").join(right.alias("b"), F.expr("a.id = b.id")).select(F.expr(minhash.estimate("a", "b"))).first()[0]
    lanes = lambda x: [(v >> k) & 15 for v in (y & (2**64 - 1) for y in x) for k in range(0, 64, 4)]
    same = sum(p == q for p, q in zip(lanes(a), lanes(b), strict=True))
    assert abs(got - (same / 128 - 1 / 16) / (15 / 16)) < 1e-12 and abs(got - 0.6) < 0.2


def test_shingle_sets_are_whole():
    texts = ["a b c d e f", "a b", None, " ", "x y z w v " * 3]
    assert [len(s) for s in minhash.shingle_sets(pa.array(texts))] == [len(shingles(t)) for t in texts]


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 16))
    rows, label = [], []
    for b in base:
        for _ in range(rng.integers(1, 9)):
            rows.append(b * rng.uniform(0.5, 2) + rng.normal(size=16) * rng.choice([0.0, 0.1, 0.2, 0.4]))
            label.append(int(rng.integers(0, 3)))
    data = [(i, [float(x) for x in v], k) for i, (v, k) in enumerate(zip(rows, label, strict=True))]
    n = len(data)
    data += [(n, data[0][1], data[0][2]), (n + 1, data[0][1], data[0][2]), (n + 2, None, 1), (n + 3, [0.0] * 16, 1), (n + 4, [float("nan")] * 16, 1), (n + 5, data[0][1], None), (n + 6, [], 1), (n + 7, [1.0, 2.0], 1), (n + 8, [2.0, 4.0], 1), (n + 9, [None] * 16, 1)]
    sound = {i: (np.array(v) / np.linalg.norm(v), k) for i, v, k in data if i < n + 2 or i in (n + 7, n + 8)}
    links = [(a, b) for a in sound for b in sound if a < b and sound[a][1] == sound[b][1] and len(sound[a][0]) == len(sound[b][0]) and sound[a][0] @ sound[b][0] >= 0.98]
    count = {i: sum(i in e for e in links) for i, _, _ in data}
    expected = {i: (count[i], c, c == i) for i, c in components([i for i, _, _ in data], links).items()}
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, 0.98).collect()}
    assert got == expected and len(links) > 50
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_one_crowded_cell(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 20)
    monkeypatch.setattr(embed_dedup, "BLOCK", 3)
    rng = np.random.default_rng(7)
    centers = np.eye(8)[0] * 5 + rng.normal(size=(300, 8)) * 0.5
    rows = np.concatenate([centers, centers[:200] + rng.normal(size=(200, 8)) * 0.2, np.repeat(centers[:5], 30, axis=0), rng.normal(size=(40, 8))])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(near, 1)), strict=True)]
    expected = {i: (int(near[i].sum()) - 1, c, c == i) for i, c in components(range(len(rows)), links).items()}
    df = spark.createDataFrame([(i, v.tolist(), "l") for i, v in enumerate(rows)], "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df, 0.98).collect()}
    assert got == expected
    twice = embed_dedup.near_duplicates(df.limit(50).union(df.limit(50)), 0.98)
    assert twice.count() == 100


def test_minhash_of_one_huge_group(spark):
    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr(f"if(id % 3 = 0, null, if(id % 3 = 1, '{text}', concat('{text} x', id)))").alias("text"))
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(docs, 80).collect()}
    assert got == {i: (i, True) if i % 3 == 0 else (1, i == 1) for i in range(3000)}


def test_compare_stops_without_losing_links():
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 64))
    b = np.concatenate([a[:50] + rng.normal(size=(50, 64)) * 0.1, rng.normal(size=(150, 64))])
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    i, j = embed_dedup.compare(a, b, False, 0.98)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(a @ b.T >= 0.98)), strict=True))


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    good = [" ".join(word() for _ in range(100)) for _ in range(80)]
    toxic = [" ".join([*(word() for _ in range(80)), "vilest", "vilest", "grumbly"]) for _ in range(20)]
    junk = [" ".join(word() + "###" for _ in range(100)) for _ in range(10)]
    texts = good + toxic + junk + [good[0], good[1] + " extra", "mail me at a@b.cd " + good[2] + " tail end", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(80 <= i < 100)) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sizes, at = [], spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns and at.dtypes == docs.dtypes
        sizes.append(at.count())
    assert sizes == [94, 83, 80, 80]
    assert not [r for r in at.collect() if "a@b.cd" in r.text]
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r.doc_id for r in at.collect()}
