"""Personal data: fixed forms, and identifiers found by the contexts that known ones stand in.

The fixed forms give seeds.  Words around a seed, and its outer form, are
lexical patterns of several grains; the same words around other identifier-like
strings link patterns to instances.  Spark scores that graph in rounds: a
pattern is as good as the share of its occurrences whose instance is believed,
an instance is believed as far as the best pattern that is trusted by then is
good; what only looks like an identifier, as a card number with a wrong check
digit, is never believed and counts against its contexts.  Instances that are
believed firmly count as seeds in the next round, so what one context gave
teaches others.  Patterns that score high, with enough different seeds behind
them, turn the instances in their contexts into findings.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, text_sizes, written

# The kinds in order, and the forms that must be found.
KINDS = ["email", "ip", "card", "phone"]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Strings that may be identifiers in another writing: runs of digits with separators, and spelled-out addresses.
NUMBER = re.compile(r"\(?[0-9](?:[ ().:/-]{0,2}[0-9]){5,}")
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+ ?[(\[](?:at|AT|At)[)\]] ?[A-Za-z0-9-]+(?:(?:\.| ?[(\[](?:dot|DOT|Dot)[)\]] ?)[A-Za-z0-9-]+)+")
WORD = re.compile(r"[^\W_]+|[^\w\s]|_|\n")
DIGITS = re.compile("[0-9]+")

#: Rounds of scoring, and what a pattern needs: score, different seeds, and a pseudo-count against it.
ROUNDS, SCORE, SEEDS, DOUBT = 4, 0.7, 5, 1.0
#: Belief from which an instance counts as a seed.
FIRM = 0.8


def luhn(digits: str) -> bool:
    """Whether a number's check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c)
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def octet(digits: str) -> bool:
    """Whether a number is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's place in KINDS, start, end) of the fixed forms, by kind, then start; ends are exclusive, in code points."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:  # a match's local part is the whole run before its @, from the end of the match before
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in DOTTED.finditer(text):  # a chain of numbers gives its fours, one after another
        parts = m.group().split(".")
        start = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(map(octet, four)):
                out.append((1, start, end))
            start = end + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def fits(kind: int, value: str) -> bool | None:
    """Whether a string could be an identifier of a kind; null where it has no likeness to one.  One that looks like it and can't be one counts against its contexts."""
    digits = re.sub("[^0-9]", "", value)
    if kind == 0:
        return True if "at" in value.lower() else None
    if kind == 1:
        parts = re.findall("[0-9]+", value)
        return all(map(octet, parts)) if len(parts) == 4 else None
    if kind == 2:
        return luhn(digits) if 12 <= len(digits) <= 19 else None
    return True if 7 <= len(digits) <= 15 else None


def shape(value: str) -> str:
    """A string's outer form: runs of digits by their lengths, words as one letter."""
    return re.sub(r"[^\W\d_]+", "a", DIGITS.sub(lambda m: f"0{len(m.group())}", value))


class Contexts:
    """Patterns of occurrences in one text, whose words are found once; whole words, however long."""

    def __init__(self, text: str):
        found = list(WORD.finditer(text))
        self.starts = [m.start() for m in found]
        self.words = [m.group() for m in found]

    def word(self, i: int, edge: str) -> str:
        """A word in lower case, those with digits as 0; the edge of a line as such."""
        if not 0 <= i < len(self.words) or self.words[i] == "\n":
            return edge
        w = self.words[i].lower()
        return "0" if any(c.isdigit() for c in w) else w

    def patterns(self, start: int, end: int, value: str) -> list[str]:
        """Of an occurrence: the two words before it, the word before and after, and the word before with the value's form.  The start and the end of a line count as words; two edges alone are no pattern."""
        i, j = bisect_left(self.starts, start), bisect_left(self.starts, end)
        near, right = self.word(i - 1, "^"), self.word(j, "$")
        far = self.word(i - 2, "^") if near != "^" else "^"
        out = []
        if (far, near) != ("^", "^"):
            out.append(f"< {far} {near}")
        if near not in ("^", "0") and right not in ("$", "0"):
            out.append(f"<> {near} _ {right}")
        if near.isalpha():
            out.append(f"<~ {near} {shape(value)}")
        return out


def occurrences(text: str) -> tuple[list[tuple[int, int, int]], list[tuple]]:
    """Base spans of a text, and all occurrences: kind, start, end, instance, patterns, whether it is a seed, whether it could be one of that kind.  Digits inside a longer word are none."""
    base = base_spans(text)
    others = [*NUMBER.finditer(text), *(SPELLED.finditer(text) if "(" in text or "[" in text else ())]
    if not base and not others:
        return base, []
    contexts = Contexts(text)
    found = [(k, a, b, text[a:b].lower(), contexts.patterns(a, b, text[a:b]), True, True) for k, a, b in base]
    taken = sorted((a, b) for _, a, b in base)
    reach = [0, *accumulate((b for _, b in taken), max)]
    for m in others:
        a, b = m.span()
        if text[a] == "(" and ")" not in m.group():
            a += 1
        if a and text[a - 1].isalnum() or text[b : b + 1].isalnum():
            continue
        if reach[bisect_left(taken, (b, 0))] > a:  # one that begins before its end reaches into it
            continue
        patterns = contexts.patterns(a, b, text[a:b])
        if patterns:
            found += [(k, a, b, text[a:b].lower(), patterns, False, fit) for k in range(len(KINDS)) if (fit := fits(k, text[a:b])) is not None]
    return base, found


SPAN = "struct<kind: int, start: long, end: long>"
OCCURRENCE = "struct<kind: int, start: long, end: long, instance: string, patterns: array<string>, seed: boolean, fit: boolean>"


def scan(docs: DataFrame, text_col: str, carried: list[str]) -> DataFrame:
    """Carried columns as the struct _row, a number for each row, its base spans and its occurrences; written once."""
    rows = docs.select(F.struct(*[F.col(c) for c in carried]).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    schema = T.StructType([rows.schema["_row"], *T.StructType.fromDDL(f"_n long, base array<{SPAN}>, found array<{OCCURRENCE}>").fields])

    def run(batches):
        number = TaskContext.get().partitionId() << 40
        span = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
        occurrence = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_()), ("fit", pa.bool_())])
        names = [("kind", "start", "end"), ("kind", "start", "end", "instance", "patterns", "seed", "fit")]
        for batch in by_bytes(batches, text_sizes(1)):
            both = [occurrences(t) for t in batch.column(1).to_pylist()]
            spans, found = ([[dict(zip(n, x, strict=True)) for x in b[k]] for b in both] for k, n in enumerate(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(range(number, number + batch.num_rows), pa.int64()), pa.array(spans, pa.list_(span)), pa.array(found, pa.list_(occurrence))], names=["_row", "_n", "base", "found"])
            number += batch.num_rows

    return written(rows.mapInArrow(run, schema), "scan")


def good_patterns(scanned: DataFrame, rounds: int = ROUNDS, score: float = SCORE, seeds: int = SEEDS) -> DataFrame:
    """kind, pattern and score of patterns to trust, from the graph of patterns and instances of the whole corpus."""
    each = scanned.select(F.explode("found").alias("f")).select("f.kind", "f.instance", "f.seed", "f.fit", F.explode("f.patterns").alias("pattern"))
    edges = written(each.groupBy("kind", "pattern", "instance").agg(F.count("*").alias("n"), F.max("seed").alias("seed"), F.max("fit").alias("fit")), "edges")
    belief = edges.withColumn("belief", F.col("seed").cast("double"))
    trusted = (F.col("score") >= score) & (F.col("seeds") >= seeds)
    for step in range(rounds):
        known = F.count_if(F.col("seed") | (F.col("belief") >= FIRM)).alias("seeds")
        scores = belief.groupBy("kind", "pattern").agg((F.sum(F.col("n") * F.col("belief")) / (F.sum("n") + DOUBT)).alias("score"), known).where(trusted)
        if step + 1 < rounds:  # only patterns that are trusted by now lend belief, so doubtful ones can't raise themselves
            best = edges.where("fit and not seed").join(scores, ["kind", "pattern"]).groupBy("kind", "instance").agg(F.max("score").alias("b"))
            lent = F.when(F.col("seed"), 1.0).when(F.col("fit"), F.coalesce("b", F.lit(0.0))).otherwise(0.0)
            belief = written(edges.join(best, ["kind", "instance"], "left").select("kind", "pattern", "instance", "n", "seed", lent.alias("belief")), "belief")
    return scores.select("kind", "pattern", "score")


def find(docs: DataFrame, text_col: str = "text", carried: list[str] | None = None, rounds: int = ROUNDS, score: float = SCORE, seeds: int = SEEDS) -> DataFrame:
    """Rows of docs as the struct _row (carried columns, all by default) with base and spans, arrays of (kind, start, end).

    kind is a place in KINDS.  base holds the fixed forms, leftmost and without
    overlap within a kind; spans holds those and the occurrences in trusted
    contexts that overlap no base span, by kind, start and end.  A span that fits
    several kinds gets the one whose pattern scores highest, of equal ones the
    first in KINDS.

    Null and empty text: no spans.  Rows that repeat are found each, and each
    counts as an occurrence; an instance in many copies is one seed.  Columns of
    docs may have any names.  An empty table gives none.
    """
    scanned = scan(docs, text_col, carried or docs.columns)
    trusted = written(good_patterns(scanned, rounds, score, seeds), "patterns")
    open_ = scanned.select("_n", F.explode(F.expr("filter(found, f -> f.fit and not f.seed)")).alias("f")).select("_n", "f.kind", "f.start", "f.end", F.explode("f.patterns").alias("pattern"))
    new = open_.join(trusted, ["kind", "pattern"]).groupBy("_n", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("k"))).alias("b"))  # one kind for a span
    new = new.groupBy("_n").agg(F.collect_list(F.struct((-F.col("b.k")).cast("int").alias("kind"), "start", "end")).alias("more"))
    joined = scanned.select("_row", "_n", "base").join(new, "_n", "left")
    return joined.select("_row", "base", F.expr("sort_array(if(more is null, base, concat(base, more)))").alias("spans"))


def rendered(spans: str) -> str:
    """SQL of spans as text: kind:start:end, joined by commas."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({kinds}), x.kind + 1), ':', x.start, ':', x.end)), ',')"


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with every found span of text_col replaced by its kind in capitals and brackets; all columns and rows stay.

    Overlapping spans are replaced together, by the kind of the first.  Null text stays null.
    """
    found, kinds = find(docs, text_col), KINDS

    def run(batches):
        def sizes(batch):
            return pc.fill_null(pc.binary_length(batch.column(0).field(text_col)), 0)

        for batch in by_bytes(batches, sizes):
            rows, spans = batch.column(0), batch.column(1).to_pylist()
            place = rows.type.get_field_index(text_col)
            texts = rows.field(place).to_pylist()
            for i, found in enumerate(spans):
                if found and texts[i] is not None:
                    out, at = [], 0
                    for s in sorted(found, key=lambda s: (s["start"], s["kind"])):
                        if s["start"] >= at:
                            out += [texts[i][at : s["start"]], f"[{kinds[s['kind']].upper()}]"]
                        at = max(at, s["end"])
                    texts[i] = "".join(out) + texts[i][at:]
            columns = [rows.field(k) if k != place else pa.array(texts, pa.string()) for k in range(rows.type.num_fields)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=[f if k != place else pa.field(f.name, pa.string()) for k, f in enumerate(rows.type)])], names=["_row"])

    return found.select("_row", "spans").mapInArrow(run, T.StructType([found.schema["_row"]])).select("_row.*")
