"""PII, quality, URL lists, toxicity and HTML against brute force and small cases."""

import datetime
import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from wayfold.llm import html_text, pii, quality, toxicity, url_filter

FORMS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for k, form in enumerate(FORMS.values()):
        for m in re.finditer(form, text):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 1 and max(map(int, m.group().split("."))) > 255:
                continue
            if k == 2 and not (16 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if k == 3 and not 8 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


def test_base_spans_are_the_forms():
    rng = random.Random(3)
    letters = [*"01234567890123456789..@@--  +() ab%_é\n", "4845168114407329", "1.2.3.4", "a@b.c", "+1 (555) 555-1234"]
    for _ in range(20_000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text)
    assert pii.base_spans("9" * 50_000 + ".1.1.1") == [] and pii.base_spans("a" * 50_000) == []


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"please call me at +1 (555) 555-{1000 + i} today") for i in range(30)] + [(100, "oh please call me at 555-010-2000 today"), (101, "order 555-010-2000 now or so"), (102, None), (103, ""), (104, "é please call me at 555-010-2001 today")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kind string")
    found = {r._row.doc_id: r for r in pii.find(docs).collect()}
    assert len(found) == len(rows)
    text = dict(rows)
    for i, r in found.items():
        assert [tuple(s) for s in r.base] == brute_spans(text[i] or "")
        assert set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert [tuple(s) for s in found[100].spans] == [(3, 21, 33)] and [tuple(s) for s in found[104].spans] == [(3, 20, 32)]
    assert found[102].spans == [] == found[103].spans
    # The second context of that number isn't trusted by itself.
    assert found[101].spans == []
    masked = {r.doc_id: r for r in pii.masked(docs).collect()}
    assert masked[0].text == "please call me at [PHONE] today" and masked[100].text == "oh please call me at [PHONE] today" and masked[102].text is None and masked[0].kind == "x"
    assert pii.masked(docs).columns == docs.columns
    assert pii.find(docs.limit(0)).count() == 0


def test_rendered_spans(spark):
    docs = spark.createDataFrame([(1, "a@b.c 1.2.3.4 +1 (555) 555-1234"), (2, "none")], "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.find(docs, carried=["doc_id"]).select("_row.doc_id", F.sha2(F.expr(pii.rendered("base")), 256).alias("h"), F.expr(pii.rendered("spans")).alias("s")).collect()}
    assert rows[1].s == "email:0:5,ip:6:13,phone:14:31" and rows[1].h == hashlib.sha256(rows[1].s.encode()).hexdigest() and rows[2].s == ""


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(covered), len(re.findall("[A-Z]", text)), text.count("!")]


def test_quality_counts(spark):
    rng = random.Random(4)
    parts = ["a", "b", "the", "é😀", "X!", "#*", "|", "<&>", " ", "\n", "\t", "\x0b", "  ", "\xa0", "\r\n", "a b c ", "l l\n"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(300)] + [None, "", " \n", "w " * 20_000, "x"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_words int")
    got = {r[0]: list(r[1:]) for r in quality.with_counts(docs).select("_row.doc_id", *quality.COUNTS).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def test_quality_estimation_separates(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 7)))
    good = [" ".join(word() for _ in range(120)) for _ in range(150)]
    junk = [" ".join(word() + "###" for _ in range(120)) for _ in range(25)] + [" ".join(word().upper() + "!!" for _ in range(120)) for _ in range(25)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(good + junk)], "doc_id long, text string")
    kept = {r._row.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert all(kept[i] for i in range(150)) and not any(kept[i] for i in range(150, 200))
    assert quality.keep_good(docs).columns == docs.columns and quality.keep_good(docs).count() == 150
    assert quality.judge(docs.limit(0)).count() == 0
    short = quality.judge(spark.createDataFrame([(1, None), (2, "few words")], "doc_id long, text string")).collect()
    assert all(r.base_failed and not r.kept for r in short)


def test_quality_posterior_by_hand():
    model = quality.fit([(0, 3), (sum(3**i for i in range(len(quality.RULES))), 7)], rounds=0)
    g, b = quality.START_GOOD, quality.START_BAD
    odds = np.log(0.7 / 0.3) + len(quality.RULES) * np.log(g[0] / b[0])
    assert abs(model["posterior"][0] - 1 / (1 + np.exp(-odds))) < 1e-12
    assert quality.fit([])["posterior"] == {}


def test_url_lists(spark):
    t = datetime.datetime
    log = spark.createDataFrame(
        [("spam", "bad.org", "add", t(2024, 1, 10)), ("spam", "bad.org", "add", t(2024, 1, 12)), ("spam", "bad.org", "remove", t(2024, 2, 1)), ("spam", "bad.org", "add", t(2024, 3, 1)), ("ads", "www.bad.org", "add", t(2024, 1, 1)), ("ads", "x.org", "add", t(2024, 1, 1)), ("ads", "x.org", "remove", t(2024, 1, 1)), (None, "bad.org", "add", t(2024, 1, 1)), ("spam", "bad.org", "odd", t(2024, 1, 1))],
        "list string, domain string, action string, at timestamp_ntz",
    )
    spans = {tuple(r) for r in url_filter.intervals(log).collect()}
    assert spans == {("spam", "bad.org", t(2024, 1, 10), t(2024, 2, 1)), ("spam", "bad.org", t(2024, 3, 1), None), ("ads", "www.bad.org", t(2024, 1, 1), None)}
    rows = [(1, "http://BAD.org/x", t(2024, 1, 10)), (2, "https://u:p@www.bad.org:8080?q", t(2024, 1, 15)), (3, "http://bad.org", t(2024, 2, 1)), (4, "http://notbad.org", t(2024, 1, 15)), (5, None, t(2024, 1, 15)), (6, "nonsense", t(2024, 1, 15)), (7, "http://bad.org", None), (8, "http://x.org", t(2024, 1, 2)), (9, "http://bad.org./", t(2024, 3, 1)), (9, "http://bad.org./", t(2024, 3, 1))]
    captures = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, fetched_at timestamp_ntz, host string")
    got = url_filter.judge(captures, log).collect()
    lists = {r._row.page_id: [m.list for m in r.matches] for r in got}
    assert lists == {1: ["spam"], 2: ["ads", "spam"], 3: [], 4: [], 5: [], 6: [], 7: [], 8: [], 9: ["spam"]} and len(got) == 10
    assert all(r.blocked == bool(r.matches) for r in got)
    assert url_filter.judge(captures.limit(0), log).count() == 0 and not any(r.blocked for r in url_filter.judge(captures, log.limit(0)).collect())


def toxic_corpus(n=600, seed=8):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 8)))
    out = []
    for i in range(n):
        grade = i % 3
        words = [word() for _ in range(60)] + rng.sample(["grumbly", "mildbad"], k=1) * (grade > 0) + ["vilest"] * 3 * (grade > 1)
        rng.shuffle(words)
        out.append((i, " ".join(words), grade))
    return out


def test_ordinal_regression_on_held_out_texts(spark):
    rows = toxic_corpus()
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, severity double")
    grades = spark.createDataFrame([(i, g) for i, _, g in rows if i < 300], "doc_id long, grade int")
    model = toxicity.fit_on(docs, grades)
    assert model.cuts == sorted(model.cuts) and len(model.cuts) == 2
    severity = {r[0]: r[1] for r in toxicity.score(docs, model).select("_row.doc_id", "severity").collect()}
    mean = [np.mean([severity[i] for i, _, g in rows if g == k and i >= 300]) for k in range(3)]
    assert mean[0] < 0.3 and mean[0] + 0.4 < mean[1] < mean[2] - 0.2
    held = [(severity[i] >= toxicity.REJECT) == (g > 0) for i, _, g in rows if i >= 300]
    assert np.mean(held) > 0.97


def test_ordinal_slopes_are_derivatives():
    rng = np.random.default_rng(1)
    score, cuts, y = rng.normal(size=40), np.array([-0.5, 0.7]), rng.integers(0, 3, 40)
    loss = lambda s, c: -np.log(np.subtract(*toxicity.around(s, c, y))).sum()
    low, high = toxicity.around(score, cuts, y)
    e = 1e-6
    by_score = [(loss(score + e * np.eye(40)[i], cuts) - loss(score - e * np.eye(40)[i], cuts)) / (2 * e) for i in range(40)]
    by_cut = [(loss(score, cuts + e * np.eye(2)[i]) - loss(score, cuts - e * np.eye(2)[i])) / (2 * e) for i in range(2)]
    assert np.allclose(low + high - 1, by_score, atol=1e-5) and np.allclose(toxicity.cut_slopes(low, high, y, 2), by_cut, atol=1e-4)


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, "same"), (2, "same"), (None, "x")], "doc_id long, text string")
    none = toxicity.fit_on(docs, spark.createDataFrame([], "doc_id long, grade int"))
    assert {r.severity for r in toxicity.score(docs, none).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 0, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert sorted(map(tuple, toxicity.labelled_grades(labels).collect())) == [(1, 0), (2, 2), (3, 1)]
    assert toxicity.score(docs.limit(0), none).count() == 0


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var x="</p>";</script></head><body><header>Site name</header>
<nav><ul><li><a href=/a>Menu</a></li></ul></nav><div class="ad">Buy &amp; save now</div><div id="cookie-notice"><p>We use cookies</p></div>
<article><h1>Head &amp; line</h1><p>First   para<br>second&nbsp;line.<p>Third <b>bold</b> one<!-- gone --></p><form><p>Sign up</p></form><ul><li>one<li>two</ul>
<section class="comments"><p>Great post</p></section></article><aside><p>Related stories that are long enough to look like text to a naive counter of characters</p></aside><footer>&copy; me</footer></body></html>"""


def test_html_pages():
    assert html_text.main_text(PAGE) == "Head & line First para second line. Third bold one one two"
    assert html_text.main_text(None) == "" == html_text.main_text("") == html_text.main_text("<nav>x</nav>")
    body = " ".join(["Plain text without an article element goes on for quite some time here."] * 3)
    assert html_text.main_text(f"<body><div class=menu><a href=x>Home</a></div><div><p>{body}</p><p>{body}</p></div><div class='footer'>end</div></body>") == f"{body} {body}"
    assert html_text.main_text("<p>unclosed <b>markup") == "unclosed markup"


def test_html_pages_of_short_blocks():
    blocks = [f"A short block no. 000{i}" for i in range(9)]
    for n in range(1, 10):
        assert html_text.main_text("".join(f"<p>{b}</p>" for b in blocks[:n])) == " ".join(blocks[:n])
    body = "Plain text without an article element goes on for quite some time here. " * 8
    menu = "".join(f"<li><a href={i}>entry {i}</a></li>" for i in range(4))
    lead = "".join(f"<p>{b}</p>" for b in blocks[:5])
    page = f"<div>Top</div><ul>{menu}</ul><div>{lead}<p>{body}</p><p>{body}</p><p>The end</p></div><ul>{menu}</ul><div>Back</div>"
    assert html_text.main_text(page) == " ".join([*blocks[:5], body.strip(), body.strip(), "The end"])
    assert html_text.main_text(f"<div>Aside</div><article><p>Short</p><nav>a</nav><nav>b</nav><nav>c</nav><p>No</p></article>") == "Short No"


def test_html_on_spark(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "old"), (2, None, None, None), (2, None, None, None)], "page_id long, url string, html string, text string")
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "url", "text"] and sorted(r.text for r in out.collect()) == ["", "", html_text.main_text(PAGE)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_windows_overrule_names():
    body = [f"Paragraph {i} of the long story, told at length and with care for the reader." for i in range(8)]
    text, page = " ".join(body), "".join(f"<p>{b}</p>" for b in body)
    # wrappers that are no article: windows outside are far larger
    assert html_text.main_text(f"<article>card one</article><div>{page}</div><nav>a</nav><nav>b</nav><nav>c</nav><article>card two</article>").startswith("card one " + text)
    # the only text stands in a part that a class calls a widget
    assert html_text.main_text(f"<div class='widget'>{page}</div><div>Top</div>") == text + " Top"
    # a real article keeps even its shortest lines, and nothing beside it comes in
    assert html_text.main_text(f"<div>Some line beside it</div><article>{page}<p>End</p><div class='ad'>Buy</div><div class='ad'>now</div><div class='ad'>or</div><p>.</p></article><div>Other line</div>") == text + " End ."
    # long lists of links weigh nothing
    links = "".join(f"<li><a href=x>a link number {i} with quite a long text to it</a></li>" for i in range(60))
    assert html_text.main_text(f"<ul>{links}</ul><div>{page}</div><ul>{links}</ul>") == text
    # without windows that surge there is nothing to overrule: the same page with another window keeps less
    spread = f"<div><p>{text}</p><ul>{links[:400]}</ul><p>x</p></div>"
    assert html_text.main_text(spread, window=1) != html_text.main_text(spread, window=30)


def test_html_takes_time_in_proportion():
    import time

    for part in ("<a", "<a x='", "<a \">\"", "<div></x>", "<script>", "<select>", "<head>", "<", "<!--", "<li>", "<textarea></textarea", "<a class ", "&amp"):
        began = time.process_time()
        html_text.main_text(part * (400_000 // len(part)) + ">")
        assert time.process_time() - began < 5, part


def planted(rng, n=400):
    """Texts with identifiers in several contexts, decoys in others: doc_id, text, spans that should be added."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    forms = [("call", "today"), ("phone :", "or"), ("reach us at", "please"), ("tel", ".")]
    rows = []
    for i in range(n):
        before, after = forms[i % len(forms)]
        left, right = " ".join(word() for _ in range(6)), " ".join(word() for _ in range(5))
        number = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        kind = i % 10
        if kind < 6:  # seeds
            value, wanted = f"+1 ({number[:3]}) {number[4:]}", False
        elif kind < 8:  # the same contexts, unseen writing
            value, wanted = number, True
        else:  # decoys
            before, after, value, wanted = rng.choice(["order", "version", "invoice no"]), "shipped", number, False
        text = f"{left} {before} {value} {after} {right}"
        at = text.index(value)
        rows.append((i, text, [(3, at, at + len(value))] if wanted else []))
    # a context without a seed, taught by numbers that the others gave
    taught = [(w, t[s[0][1] : s[0][2]]) for w, t, s in rows if s][:12]
    for k, (_, number) in enumerate(taught):
        text = f"{word()} {word()} extension {number} {word()}"
        rows.append((n + k, text, [(3, text.index(number), text.index(number) + len(number))]))
    for k in range(3):
        number = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)}"
        text = f"{word()} {word()} extension {number} {word()}"
        rows.append((2 * n + k, text, [(3, text.index(number), text.index(number) + len(number))]))
    rows.append((5000, "x" * 5000 + " call 555-666-7777 today " + "y" * 200_000, [(3, 5006, 5018)]))
    rows.append((5001, 'token = "1234-567-8901abc" and 9f555-666-7777', []))
    return rows


def test_contexts_recall_and_precision(spark):
    rows = planted(random.Random(9))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 2, "doc_id long, text string").repartition(5)
    found = {r._row.doc_id: {tuple(s) for s in r.spans} - {tuple(s) for s in r.base} for r in pii.find(docs).collect()}
    wanted = {i: set(s) for i, _, s in rows}
    hit = sum(len(found[i] & wanted[i]) for i in found)
    assert hit / sum(map(len, wanted.values())) >= 0.95 and hit / sum(map(len, found.values())) >= 0.95
    assert all(found[i] == wanted[i] for i in found if i >= 5000) and sum(bool(found[i]) for i in range(800, 803)) == 3


def test_url_lists_with_one_domain_above_all(spark):
    t = datetime.datetime
    log = spark.createDataFrame([("l", "com", "remove", t(2024, 1, 1)), ("l", "h7.com", "add", t(2024, 1, 1)), ("l", ".".join(["a"] * 200) + ".com", "add", t(2024, 1, 1))], "list string, domain string, action string, at timestamp_ntz")
    deep = ".".join(["b", *["a"] * 200]) + ".com"
    rows = [(i, f"http://www.h{i % 50}.com/{i}", t(2024, 1, 1 + i % 28)) for i in range(3000)] + [(9000, f"http://{deep}/", t(2024, 2, 1)), (9001, "http://x.com/" + "y" * 300_000, t(2024, 2, 1))]
    got = {r._row.page_id: r.blocked for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string, fetched_at timestamp_ntz"), log).collect()}
    assert got == {i: i % 50 == 7 for i in range(3000)} | {9000: True, 9001: False}


def test_severity_orders_documents_of_one_quality(spark):
    rows = [(i, t, g) for i, t, g in toxic_corpus(seed=12) if g != 2]
    docs = spark.createDataFrame([(i, t + " ordinary" * 200 * (i % 2)) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.fit_on(docs, spark.createDataFrame([(i, g) for i, _, g in rows if i < 300], "doc_id long, grade int"))
    severity = {r[0]: r[1] for r in toxicity.score(docs, model).select("_row.doc_id", "severity").collect()}
    held = [(severity[i], g) for i, _, g in rows if i >= 300]
    assert np.mean([s for s, g in held if g]) > np.mean([s for s, g in held if not g]) + 0.3


def test_quality_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "same words in a text " * 3)] * 3 + [(2, None)] * 2, "doc_id long, text string")
    assert [r.kept for r in quality.judge(docs).collect()] == [False] * 5


def test_broken_pages_take_time_in_proportion():
    """Quotes that never close in step, and list items below many open elements, at a megabyte each."""
    for page in ('<a "' + '><b" "' * 170_000 + ">", "<div>" * 80_000 + "<li>x</li>" * 60_000, "<li><ul>" + "<div>" * 80_000 + "<li>x</li>" * 60_000, "<a '" + "><b' \"" * 150_000 + ">"):
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 12
