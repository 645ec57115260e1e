"""Token counts, the audit of filters and vector codes against the library and brute force."""

import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_tokens import texts
from tokenizers import Tokenizer
from wayfold.llm import filter_audit, token_counts, vector_codes

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def library(strings):
    return [len(e.ids) for e in Tokenizer.from_file(BYTE).encode_batch(strings, add_special_tokens=False)]


def test_counts_are_the_library_s():
    strings = [*texts(4000, 9), "", "ab" * 4000, "\n" * 300, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "aaaa" * 33 + "é" * 50]
    counted = token_counts.Merges(BYTE)
    assert [counted.of_text(s) for s in strings] == library(strings)


def test_a_heap_and_a_scan_of_all_pairs_agree():
    counted, rng = token_counts.Merges(BYTE), random.Random(4)
    for _ in range(300):
        word = bytes(rng.choice(b"aabcdeinrst ") for _ in range(rng.randint(1, 30)))
        symbols = [counted.symbol[b] for b in word]
        while True:
            found = [(counted.merge[p][0], i) for i, p in enumerate(itertools.pairwise(symbols)) if p in counted.merge]
            if not found:
                break
            _, i = min(found)
            symbols[i : i + 2] = [counted.merge[symbols[i], symbols[i + 1]][1]]
        assert counted.merged(word) == len(symbols)


def test_a_long_word_takes_n_log_n():
    counted = token_counts.Merges(BYTE)
    took = []
    for n in (50_000, 200_000):
        word = bytes(random.Random(1).choices(b"abcdefghijklmnopqrstuvwxyz", k=n))
        began = time.perf_counter()
        assert counted.merged(word) == library([word.decode()])[0]
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * took[0] + 1


def test_counts_on_spark(spark):
    rows = [(i, t) for i, t in enumerate(texts(60, 7))] + [(100, None), (101, ""), (101, "twice"), (101, "twice"), (None, "no id"), (102, "word " * 9000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_tokens int")
    out = token_counts.count(docs, BYTE, limit=512).collect()
    n = library([t or "" for _, t in rows])
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == Counter((i, len((t or "").encode()), k, k > 512) for (i, t), k in zip(rows, n, strict=True))
    assert token_counts.count(docs.limit(0), BYTE, limit=512).count() == 0


# ------------------------------------------------------------------------ audit

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_audit(rows, labels):
    """Every order applied to every document, one after another."""
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > low[t]}
        docs.append((i, lang or "", {k for k, v in fails.items() if v}))
    out = {}
    for part in {d[1] for d in docs}:
        total = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = [d for d in docs if d[1] == part], []
            for step, f in enumerate(order, 1):
                hit = [d for d in left if f in d[2]]
                left = [d for d in left if f not in d[2]]
                redundant, alone = sum(f in d[2] for d in gone), sum(d[2] == {f} for d in docs if d[1] == part)
                gone += hit
                total[f] += len(hit)
                out[part, order, step] = (len(left), len(hit), redundant, alone, sum(d[0] in good for d in hit), sum(d[0] in toxic for d in hit))
        for (p, order, step), row in list(out.items()):
            if p == part:
                out[p, order, step] = (*row, total[order[step - 1]])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, lang, True, 3) for i, t, lang in rows], "doc_id long, text string, lang string, good boolean, n int")
    said = spark.createDataFrame([(i, q, t, "x") for i, q, t in labels], "doc_id long, quality int, toxic int, part string")
    out = filter_audit.audit(docs, said)
    assert dict(out.dtypes)["step"] == "int"
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}


def audit_rows():
    rng, rows = random.Random(8), []
    for i in range(150):
        words = [rng.choice(["Alpha", "beta", "GAMMA", "d#", "e"]) + (str(rng.randint(0, 400)) if rng.random() < 0.9 else "") for _ in range(rng.choice([0, 5, 99, 100, 130]))]
        rows.append((i, rng.choice([" ", "\n", "\t"]).join(words), rng.choice(["en", "de", None])))
    rows += [(200 + k, rows[k % 7][1], "en") for k in range(60)]  # copies
    rows += [(3, rows[3][1], "en"), (3, rows[3][1], "fr"), (3, "another text of one id", "en"), (None, rows[4][1], "en"), (None, None, "en"), (None, "", "de"), (500, None, "de"), (501, "", "de"), (502, "word " * 30_000, "en"), (503, "\xa0 \x85", "")]
    return rows


def test_audit_against_every_order(spark):
    rng = random.Random(3)
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 260, 2)] + [(4, 1, 1), (4, 1, 0), (None, 1, 1), (9999, 1, 1)]
    assert audited(spark, audit_rows(), labels) == brute_audit(audit_rows(), labels)


def test_audit_of_one_text_in_most_rows(spark):
    rows = [(i, "one # text", "en") for i in range(3000)] + [(5000 + i, f"text {i}", "de") for i in range(10)]
    found = audited(spark, rows, [(2, 1, 0)])
    assert found == brute_audit(rows, [(2, 1, 0)])
    assert found["en", "EABCD", 1][:2] == (1, 2999)


def test_audit_of_empty_tables(spark):
    assert audited(spark, [], []) == {} and len(audited(spark, [(1, "a", "en")], [])) == 600


def test_shapley_adds_up_to_all_that_goes(spark):
    found = audited(spark, audit_rows(), [])
    for part in ("en", "de"):
        each = {order[step - 1]: row[6] for (p, order, step), row in found.items() if p == part}
        last = next(row[0] for (p, order, step), row in found.items() if p == part and step == 5)
        everything = sum(row[1] for (p, order, _), row in found.items() if p == part and order == "ABCDE") + last
        assert sum(each.values()) == math.factorial(5) * (everything - last)


# ------------------------------------------------------------------------ codes


def brute_codes(vectors, parts=8, entries=16, rounds=6):
    """Codes, errors and codebooks by distances to all entries, in whole numbers of any size."""
    grid = [[math.floor(4096 * x) for x in v] for v in vectors]
    w = len(grid[0]) // parts
    cut = [[g[p * w : (p + 1) * w] for p in range(parts)] for g in grid]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(best(p, c[p])[1], []).append(c[p])
            books[p] = [[sum(col) // len(members[k]) for col in zip(*members[k], strict=True)] if k in members else e for k, e in enumerate(books[p])]
    found = [[best(p, c[p]) for p in range(parts)] for c in cut]
    text = ",".join(str(x) for b in books for e in b for x in e)
    return ["".join(f"{k:02x}" for _, k in f) for f in found], [sum(d for d, _ in f) for f in found], hashlib.sha256(text.encode()).hexdigest()


def test_filtering_drops_no_nearest_entry():
    rng = np.random.default_rng(1)
    for n, d, k, spread in [(1, 2, 3, 9), (17, 1, 16, 4), (500, 3, 16, 6), (3000, 8, 16, 900), (800, 4, 1, 50)]:
        points, entries = rng.integers(-spread, spread, (n, d)).astype(np.int32), rng.integers(-spread, spread, (k, d)).astype(np.int64)
        tree = vector_codes.Tree.build(points)
        sums, counts, codes = tree.assign(entries, True)
        expected = ((points[:, None, :].astype(np.int64) - entries[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert (codes == expected).all() and (counts == np.bincount(expected, minlength=k)).all()
        assert all((sums[e] == points[expected == e].sum(axis=0)).all() for e in range(k))


def test_whole_subtrees_are_assigned():
    """On points in clumps most rows are assigned by nodes, not looked at one by one."""
    rng = np.random.default_rng(2)
    centers = rng.integers(-9000, 9000, (8, 6))
    points = (centers[rng.integers(0, 8, 4000)] + rng.integers(-20, 20, (4000, 6))).astype(np.int32)
    tree, seen = vector_codes.Tree.build(points), []
    leaves = tree._leaves
    tree._leaves = lambda entries, starts, nodes, *rest: (seen.append(int((starts[nodes + 1] - starts[nodes]).sum())), leaves(entries, starts, nodes, *rest))
    tree.assign(centers.astype(np.int64), True)
    assert sum(seen) < 400


def compressed(spark, rows, **args):
    table = spark.createDataFrame([(i, v, k, 1) for i, v, k in rows], "vec_id long, embedding array<float>, label int, code int").repartition(3)
    return sorted(vector_codes.compress(table, **args).collect(), key=lambda r: (-1 if r.vec_id is None else r.vec_id, r.code))


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 32)], None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(400)]
    rows += [(500 + i, rows[0][1], 1) for i in range(200)]  # copies of one vector
    rows += [(900, [0.0] * 32, 2), (901, [-0.0] * 32, 2), (902, [1e-9] * 32, 2)]
    bad = [(1000, None, 1), (1001, [None] * 32, 1), (1002, [float("nan")] * 32, 1), (1003, [float("inf")] + [0.0] * 31, 1), (-5, [0.0] * 31 + [float("-inf")], 0), (1005, [], 1), (1006, [1.0] * 24, 1), (1007, [1.0] * 31, 1)]
    good = sorted(rows)
    codes, errors, digest = brute_codes([v for _, v, _ in good])
    sums = Counter()
    for (_, _, k), e in zip(good, errors, strict=True):
        sums[k] += e
    found = compressed(spark, rows + bad)
    assert [tuple(r) for r in found] == [(i, c, e, sums[k], digest) for (i, _, k), c, e in zip(good, codes, errors, strict=True)]


def test_few_repeated_and_huge_vectors(spark):
    one = [float(x) for x in range(8)]
    found = compressed(spark, [(1, one, None), (1, one, None), (2, one[::-1], None), (None, one, 4)])
    assert [(r.vec_id, r.code, r.error, r.label_error) for r in found] == [(None, "00" * 8, 0, 0), (1, "00" * 8, 0, 0), (1, "00" * 8, 0, 0), (2, "01" * 8, 0, 0)]
    assert [r.error for r in compressed(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)])] == [0, 0]
    assert compressed(spark, []) == [] and compressed(spark, [(1, None, 1), (2, [1.0] * 7, 1)]) == [] and compressed(spark, [(None, one, 1)]) == []


def test_blocks_bear_on_nothing(spark):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(x) for x in rng.normal(0, 1, 16)], i % 2) for i in range(300)], "vec_id long, embedding array<float>, label int")
    usable, width = vector_codes.usable(rows, "vec_id", "embedding", "label", 8)
    start = vector_codes.planted(usable, width, 8, 16)
    books = [vector_codes.improved(vector_codes.trees(usable.repartition(n), width, 8, block), start, width) for n, block in ((1, 1 << 20), (5, 160), (2, 1))]
    assert (books[0] == books[1]).all() and (books[0] == books[2]).all()
    assert usable.where(F.size("vector") != width).count() == 0


@pytest.mark.parametrize("entries", [0, 257])
def test_codes_have_two_digits(spark, entries):
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int"), parts=1, entries=entries)
