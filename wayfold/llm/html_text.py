"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page.  A line's weight
is its number of visible characters outside links.  Weights are summed over
windows of some lines.  A run of lines lasts until the sums dive to zero; it is
text if they surge over a threshold anywhere in it.  The threshold is a share
of the page's own mean sum, and limited, so a page of short lines only keeps
them.

Names of elements and classes move weights, as far as the window sums bear them
out.  Lines of menus, notices, forms and the like weigh nothing; but where the
largest window of parts that only a class name marks is far larger than any
other, those marks are dropped.  If the largest window inside article or main
elements is at least half as large as the page's largest, lines inside get the
weight of a surge each and lines outside none; else those elements are taken
for wrappers of something else and move nothing.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

NAME = re.compile(r"[a-zA-Z][^\s/><]*")
PLAIN = re.compile(r"[^>\"']*+")
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PARTS = re.compile(r"[a-z0-9]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)

# Fixed values of HTML: elements whose content is no text, elements without content, elements inside a line.
SILENT = frozenset("script style noscript template iframe svg math object canvas audio video head title select textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
LISTS = frozenset("ul ol li".split())
#: Elements that hold no article text, outside an article also header.
ASIDE = frozenset("nav footer aside form menu dialog fieldset".split())
#: Words in class, id or role of elements that hold no article text.
WORDS = frozenset("ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside widget widgets footer foot masthead comment comments commentlist disqus reply replies respond discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar skip complementary contentinfo".split())

#: Lines of a window, the share of the mean window that a run's largest window needs, and the characters that always suffice.
WINDOW, SHARE, SURGE = 3, 0.1, 86
#: An article's largest window over the page's, at least; the largest window of parts marked by class over all others, at least, for the marks to be dropped.
BELIEVED, OVERRULED = 0.5, 4.0
#: Marks of a line: none, by the name of a class, by the name of an element.
FREE, BY_CLASS, BY_ELEMENT = range(3)


class Scanner:
    """Tags of a page, from left to right in one pass; what is looked for in vain isn't looked for again, and a value that leads to no end of a tag isn't followed twice."""

    def __init__(self, html: str):
        self.html, self.quotes, self.missing, self.end = html, True, set(), 0
        self.astray: set[int] = set()  # quotes that begin a value from which no end of a tag was found
        self.last = {q: html.rfind(q) for q in "\"'>"}
        low = html.lower()
        self.low = low if len(low) == len(html) else html

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.low.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag_end(self, at: int) -> int:
        """The place after the > that ends a tag; in quotes it doesn't end one, unless a quote or the tag never ends."""
        html, to, begun = self.html, at, []
        while self.quotes:
            to = PLAIN.match(html, to).end()
            if to >= len(html):
                self.quotes = False
            elif html[to] == ">":
                return to + 1
            elif self.last[html[to]] == to or to in self.astray:
                break
            else:
                begun.append(to)
                to = html.index(html[to], to + 1) + 1
        self.astray.update(begun)
        return html.index(">", at) + 1

    def tags(self):
        """Yield (text before, closing, name, attributes, whether the tag ends itself); the caller may send a place to go on from."""
        html, at, text_from = self.html, 0, 0
        while True:
            at = html.find("<", at)
            if at < 0 or at > self.last[">"]:
                break
            if html.startswith("<!--", at):
                end = self.find("-->", at + 4)
                yield html[text_from:at], False, "", "", False
                at = text_from = end + 3 if end >= 0 else len(html)
                continue
            closing = html.startswith("/", at + 1)
            m = NAME.match(html, at + 1 + closing)
            if m is None:
                if html[at + 1 : at + 2] in ("!", "?"):
                    yield html[text_from:at], False, "", "", False
                    at = text_from = html.index(">", at) + 1
                else:
                    at += 1
                continue
            end = self.end = self.tag_end(m.end())
            go_on = yield html[text_from:at], closing, m.group().lower(), html[m.end() : end - 1], html[end - 2] == "/"
            at = text_from = end
            if go_on is not None:
                at = text_from = go_on
                yield None
        yield html[text_from:], False, "", "", False

    def silent_end(self, name: str, at: int) -> int:
        """Where the page goes on after the content of an element that holds no text."""
        if name == "head":  # its end may be left out
            ends = [p for p in (self.find(x, at) for x in ("</head", "<body", "<article", "<main")) if p >= at]
            return min(ends) if ends else at
        to = self.find("</" + name, at)
        if 0 <= to <= self.last[">"]:
            return self.html.index(">", to) + 1
        return len(self.html) if name in ("script", "style") else at


def lines_of(html: str) -> list[tuple[str, int, bool, int]]:
    """A page's lines: text, how it is marked as no article text, whether it stands in an article, characters in links."""
    lines: list[tuple[str, int, bool, int]] = []
    stack: list[tuple[str, int, bool]] = []  # name, mark, article
    is_open: dict[str, int] = {}
    parts: list[str] = []
    lists: list[int] = []  # where ul, ol and li stand in the stack
    marks = [0, 0, 0]
    linked = in_link = article = 0

    def end_line():
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            lines.append((text, BY_ELEMENT if marks[BY_ELEMENT] else BY_CLASS if marks[BY_CLASS] else FREE, article > 0, linked))
        parts.clear()
        linked = 0

    def pop():
        nonlocal article
        name, mark, inside = stack.pop()
        is_open[name] -= 1
        if name in LISTS:
            lists.pop()
        marks[mark] -= 1
        article -= inside

    scanner = Scanner(html)
    tags = scanner.tags()
    for text, closing, name, attributes, ended in tags:
        if text:
            text = unescape(text)
            parts.append(text)
            if in_link:
                linked += len(text)
        if not name:
            continue
        if name not in INLINE:
            end_line()
        if closing:
            if name == "a":
                in_link = max(0, in_link - 1)
            if is_open.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name in SILENT:
            if not ended:
                tags.send(scanner.silent_end(name, scanner.end))
            continue
        if name in VOID:
            continue
        if name == "a":
            in_link += 1
        if name not in INLINE:
            in_link = 0
            while stack and (stack[-1][0] in INLINE or stack[-1][0] == "p"):
                pop()
            if name == "li" and lists and stack[lists[-1]][0] == "li":  # the one before ends
                k = lists[-1]
                while len(stack) > k:
                    pop()
        inside = name in ("article", "main")
        mark = BY_ELEMENT if name in ASIDE or name == "header" and not article else FREE
        if attributes and not mark and name not in ("html", "body"):
            words = {w for found in NAMES.findall(attributes) for w in PARTS.findall("".join(found).lower())}
            if words & WORDS and not (name == "main" and not article):
                mark = BY_CLASS
            if HIDDEN.search(attributes):
                mark = BY_ELEMENT
        inside = inside and not mark
        stack.append((name, mark, inside))
        is_open[name] = is_open.get(name, 0) + 1
        if name in LISTS:
            lists.append(len(stack) - 1)
        marks[mark] += 1
        article += inside
    end_line()
    return lines


def windows(weights: list[int], size: int) -> list[int]:
    """Sums of each weight with those that follow it."""
    return [sum(weights[i : i + size]) for i in range(len(weights))]


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of one page; empty where there is none."""
    lines = lines_of(html or "")
    plain = [max(0, len(text) - 2 * linked) for text, _, _, linked in lines]

    def peak(chosen) -> int:
        return max(windows([w if chosen(line) else 0 for w, line in zip(plain, lines, strict=True)], window), default=0)

    if peak(lambda x: x[1] == BY_CLASS) > OVERRULED * peak(lambda x: x[1] == FREE):
        lines = [(text, mark if mark == BY_ELEMENT else FREE, article, linked) for text, mark, article, linked in lines]
    free = peak(lambda x: x[1] == FREE)
    inside = peak(lambda x: x[1] == FREE and x[2])
    named = any(mark == FREE and article for _, mark, article, _ in lines) and inside >= BELIEVED * free
    weights = [0 if mark or named and not article else w + surge * named for w, (_, mark, article, _) in zip(plain, lines, strict=True)]
    sums = windows(weights, window)
    full = [x for x in sums if x]
    need = min(surge, SHARE * sum(full) / len(full)) if full else surge
    keep, i = [], 0
    while i < len(lines):
        end = i  # the text dives after the last line whose window isn't empty
        while end < len(lines) and sums[end]:
            end += 1
        if max(sums[i:end], default=0) >= need:
            keep += [lines[k][0] for k in range(i, end) if weights[k]]
        i = end + 1
    return " ".join(keep)


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All columns but html_col, with text_col (string) as the last one.

    Null, empty and broken html: what text it has, else empty text.  A column
    called text_col is replaced.  Rows keep their number and order; ties and
    repeated rows don't matter, as every page stands alone.  An empty table
    gives none.
    """
    rest = [c for c in pages.columns if c not in (html_col, text_col)]
    schema = T.StructType([pages.schema[c] for c in rest] + [T.StructField(text_col, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*rest, text_col])

    return pages.select(*[pages[c] for c in rest], pages[html_col]).mapInArrow(run, schema)
