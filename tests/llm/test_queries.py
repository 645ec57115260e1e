"""The registered queries on the smallest tables: against SQL, the libraries, or brute force."""

import glob
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer
from wayfold.llm import html_text, oracle, queries, quality, toxicity
from wayfold.llm.common import table

DATA = os.environ.get("WAYFOLD_DATA", "/root/testdata") + "/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def ran(spark, name):
    return queries.queries()[name](spark, DATA)


def library(path):
    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


def steady(value):
    return float(f"{value:.9g}") if isinstance(value, float) else None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = ran(spark, name)
    found = tables.sql(oracle.SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    columns = ", ".join(f'"{c}"' for c in sorted(found.columns))
    expected = sorted(([steady(x) for x in r] for r in tables.sql(f"select {columns} from ({oracle.SQL[name]}) t").fetchall()), key=repr)
    assert sorted(([steady(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=repr) == expected


def encoded(tables, path):
    rows = tables.sql("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall()
    return {i: e.ids for (i, _), e in zip(rows, library(path).encode_batch([t for _, t in rows], add_special_tokens=False), strict=True)}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(spark, tables):
    ids = {i: [*x, 2] for i, x in encoded(tables, queries.WORD_BPE).items()}
    rows = ran(spark, "op1_pack_ffd").collect()
    places, pieces = {}, {}
    for r in rows:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, found in pieces.items():
        assert [sum(n for _, n in sorted(found)[:k]) for k in range(len(found))] == [s for s, _ in sorted(found)] and sum(n for _, n in found) == len(ids[i])
    for found in places.values():
        assert [sum(n for _, n in sorted(found)[:k]) for k in range(len(found))] == [o for o, _ in sorted(found)] and sum(n for _, n in found) <= 4096
    assert set(pieces) == set(ids)


def test_token_store(spark, tables):
    start, expected = 0, {}
    for i, x in encoded(tables, queries.BYTE_BPE).items():
        expected[i] = (start, len(x) + 1, crc([*x, 2]))
        start += len(x) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ran(spark, "op2_token_store").collect()} == expected


def test_personal_data(spark, tables):
    from test_text_rules import brute_spans

    texts = dict(tables.sql("select doc_id, coalesce(text, '') from documents").fetchall())
    rows = {r.doc_id: r for r in ran(spark, "op3_pii_bootstrap").collect()}
    assert set(rows) == set(texts)
    for i, t in texts.items():
        base = brute_spans(t)
        text = ",".join(f"{'email ip card phone'.split()[k]}:{a}:{b}" for k, a, b in base)
        r = rows[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and set(filter(None, text.split(","))) <= set(r.spans.split(","))


def grouped(ids, links):
    low = {i: i for i in ids}
    while True:
        new = dict(low)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == low:
            return low
        low = new


def test_embeddings(spark, tables):
    rows = tables.sql("select vec_id, label, embedding from embeddings").fetchall()
    unit = np.array([x[2] for x in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    links = [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(near), strict=True) if i != j and rows[i][1] == rows[j][1] and rows[i][1] is not None]
    low = grouped([x[0] for x in rows], links)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ran(spark, "op4_embedding_tiles").collect()}
    assert got == {i: (sum(a == i for a, _ in links), c, c == i) for i, c in low.items()}


def test_near_duplicates(spark, tables):
    word, sets = re.compile("[^\x20\x09-\x0d]+"), {}
    for i, t in tables.sql("select doc_id, coalesce(text, '') from documents").fetchall():
        words = word.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), t))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in ran(spark, "op8_minhash_bbit").collect()}
    assert links and got == {i: (len(sets[i]), c, c == i) for i, c in grouped(sets, links).items()}


def test_token_counts(spark, tables):
    rows = dict(tables.sql("select doc_id, coalesce(text, '') from documents").fetchall())
    expected = {i: (len(rows[i].encode()), len(ids), len(ids) > 512) for i, ids in encoded(tables, queries.BYTE_BPE).items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in ran(spark, "op11_token_counts").collect()} == expected


def test_bpe(spark, tables):
    own, expected = library(queries.BYTE_BPE), {}
    for i, ids in encoded(tables, queries.BYTE_BPE).items():
        expected[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in ran(spark, "op9_bpe_trie").collect()} == expected


def test_toxicity_scores_are_the_model_by_hand(spark, tables):
    """The query's severities are the sum of both thresholds' probabilities, from weights and features that Python takes again."""
    docs = table(spark, DATA, "documents")
    model = toxicity.fit_on(docs, toxicity.labelled_grades(table(spark, DATA, "labels")))
    again = toxicity.fit_on(docs, toxicity.labelled_grades(table(spark, DATA, "labels")))
    assert model.cuts == again.cuts
    got = {r.doc_id: r for r in ran(spark, "op7_toxicity").collect()}
    by_operator = {r[0]: r[1] for r in toxicity.score(docs, model).select("_row.doc_id", "severity").collect()}
    assert set(got) == set(by_operator) and all(abs(got[i].severity - by_operator[i]) < 1e-9 for i in got)
    assert all(r.rejected == (r.severity >= toxicity.REJECT) and 0 <= r.severity <= len(model.cuts) for r in got.values())


def test_html(spark, tables):
    """A page's text has the words of its article and none from elsewhere, by regular expressions over these pages' own layout."""
    import html

    rows = {r.page_id: r for r in ran(spark, "op10_html_text").collect()}
    pages = tables.sql("select page_id, url, html from pages").fetchall()
    assert len(rows) == len(pages)
    for i, url, page in pages:
        inner = re.search(r"<article[^>]*>(.*?)</article>", page, re.S).group(1)
        inner = re.sub(r"<!--.*?-->|<(script|style|form|aside|nav)\b.*?</\1>", " ", inner, flags=re.S)
        inner = re.sub(r"<(div|section|p|ul)\s[^>]*class=[^>]*(?:comment|ad|share|related|notice)[^>]*>.*?</\1>", " ", inner, flags=re.S)
        plain = html.unescape(re.sub(r"<[^>]+>", " ", inner)).split()
        assert rows[i].text.split() == plain and rows[i].url == url and rows[i].n_chars == len(rows[i].text)
    assert not math.isnan(len(rows)) and html_text.main_text(None) == "" and quality.ROUNDS > 0
