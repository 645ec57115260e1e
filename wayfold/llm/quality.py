"""Document quality by weak supervision, in DataFrame functions alone.

Rules look at a text's counts and vote that it is good, vote that it is bad, or
abstain.  How often each rule is right isn't known: expectation-maximisation
over the vote patterns of the whole corpus estimates it without labels, and
gives every pattern the probability that its documents are good.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

SPACE = r"[\\x20\\x09-\\x0D]"

#: Counts that the rules read.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_capitals", "n_bangs"]

#: name: (votes bad, votes good), in SQL over COUNTS; neither: it abstains.
RULES = {
    "symbols": ("10 * n_symbols > n_words and n_words > 0", "100 * n_symbols <= n_words and n_words > 0"),
    "symbol_share": ("100 * n_symbols > 3 * word_chars", "200 * n_symbols <= word_chars and n_words > 0"),
    "word_length": ("n_words > 0 and (10 * word_chars < 35 * n_words or word_chars > 7 * n_words)", "10 * word_chars >= 40 * n_words and 10 * word_chars <= 68 * n_words and n_words > 0"),
    "repeats": ("10 * n_repeat_words > 4 * n_words", "4 * n_repeat_words <= n_words and n_words > 0"),
    "lines": ("10 * n_dup_lines > 4 * n_lines", "4 * n_dup_lines <= n_lines and n_lines > 1"),
    "capitals": ("10 * n_capitals > 4 * word_chars", "10 * n_capitals <= word_chars and n_words > 0"),
    "exclamations": ("10 * n_bangs > 3 * n_words", "20 * n_bangs <= n_words and n_words > 0"),
}

#: What no document may have, whatever the votes.
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"

ROUNDS, START_PRIOR = 20, 0.7
#: First guess at how often a rule votes bad, votes good and abstains, on good and on bad documents.
START_GOOD, START_BAD = (0.05, 0.75, 0.2), (0.4, 0.4, 0.2)
THRESHOLD = 0.5


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows as a struct, and their COUNTS: columns _row and one long for each count.

    Words are runs of characters other than blanks, tabs and line ends (ASCII);
    word_chars counts their code points.  n_repeat_words counts the words in
    3-word windows that the text holds twice or more; windows are compared by a
    64-bit hash.  n_lines counts lines with a word, n_dup_lines those equal to
    an earlier one.  Null text has no words.
    """
    t = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    t = t.select("_row", "_t", F.expr(f"array_remove(split(_t, '{SPACE}+'), '')").alias("_w"), F.expr(f"filter(split(_t, '\\n', -1), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("_l"))
    t = t.select("*", F.expr("transform(slice(_w, 1, greatest(size(_w) - 2, 0)), (x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2)))").alias("_h"))
    t = t.select(
        "_row",
        "_h",
        F.expr("cast(size(_w) as long)").alias("n_words"),
        F.expr("cast(char_length(array_join(_w, '')) as long)").alias("word_chars"),
        F.expr("cast(char_length(_t) - char_length(regexp_replace(_t, '[#*$%&|<>]', '')) as long)").alias("n_symbols"),
        F.expr("cast(size(_l) as long)").alias("n_lines"),
        F.expr("cast(size(_l) - size(array_distinct(_l)) as long)").alias("n_dup_lines"),
        F.expr("cast(char_length(_t) - char_length(regexp_replace(_t, '[A-Z]', '')) as long)").alias("n_capitals"),
        F.expr("cast(char_length(_t) - char_length(replace(_t, '!', '')) as long)").alias("n_bangs"),
        # Only texts with a window twice are sorted for the places of such windows.
        F.expr("if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (x, i) -> struct(x as h, i as p))), null)").alias("_s"),
    )
    t = t.select("*", F.expr("sort_array(array_compact(transform(_s, (x, i) -> if(x.h = get(_s, i - 1).h or x.h = get(_s, i + 1).h, x.p, null))))").alias("_d"))
    t = t.select("*", F.expr("coalesce(aggregate(transform(_d, (p, i) -> least(3, coalesce(get(_d, i + 1) - p, 3))), 0L, (a, x) -> a + x), 0L)").alias("n_repeat_words"))
    return t.select("_row", *COUNTS)


def votes() -> str:
    """SQL of the vote pattern: one base-3 digit for each rule, 0 bad, 1 good, 2 abstains."""
    return " + ".join(f"{3**i} * (case when {bad} then 0 when {good} then 1 else 2 end)" for i, (bad, good) in enumerate(RULES.values()))


def fit(patterns: list[tuple[int, int]], rounds: int = ROUNDS) -> dict:
    """How each rule votes on good and on bad documents, the share of good ones, and each pattern's posterior, from (pattern, documents).

    Patterns number 3 to the power of the rules at most, whatever the corpus.
    An estimate has one document more for each of a rule's three answers.
    """
    n = len(RULES)
    table = [(p, c, [(p // 3**j) % 3 for j in range(n)]) for p, c in sorted(patterns)]
    prior, good, bad = START_PRIOR, [START_GOOD] * n, [START_BAD] * n
    posterior: dict[int, float] = {}
    for step in range(rounds + 1):
        for p, _, vs in table:
            odds = math.log(prior / (1 - prior)) + sum(math.log(good[j][v] / bad[j][v]) for j, v in enumerate(vs))
            posterior[p] = 1 / (1 + math.exp(-min(max(odds, -500.0), 500.0)))
        if step == rounds or not table:
            break
        total = sum(c for _, c, _ in table)
        sure = sum(c * posterior[p] for p, c, _ in table)
        prior = (1 + sure) / (2 + total)
        for j in range(n):
            good[j] = tuple((1 + sum(c * posterior[p] for p, c, vs in table if vs[j] == v)) / (3 + sure) for v in range(3))
            bad[j] = tuple((1 + sum(c * (1 - posterior[p]) for p, c, vs in table if vs[j] == v)) / (3 + total - sure) for v in range(3))
    return {"prior": prior, "good": good, "bad": bad, "posterior": posterior}


def judge(docs: DataFrame, text_col: str = "text", keep_columns: list[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of docs as the struct _row, their COUNTS, votes (long), posterior (double), base_failed and kept (boolean).

    keep_columns: what _row holds (all columns by default; the text's column
    may be left out).  Counts are taken once and written to the shared folder;
    the fit reads the number of documents of each vote pattern.

    Null and empty text has no words and fails; rows that repeat count each;
    columns of docs may have any names, as they stay inside _row.  An empty
    table gives none.
    """
    counted = with_counts(docs, text_col).withColumn("votes", F.expr(f"cast({votes()} as long)"))
    if keep_columns is not None:
        counted = counted.withColumn("_row", F.struct(*[F.col("_row")[c].alias(c) for c in keep_columns]))
    counted = written(counted, "quality")
    model = fit([(r["votes"], r["count"]) for r in counted.groupBy("votes").count().collect()])
    rows = sorted(model["posterior"].items()) or [(0, 0.0)]
    verdict = counted.sparkSession.sql("select * from values " + ", ".join(f"({v}L, {p!r}D)" for v, p in rows) + " as t(votes, posterior)")
    found = counted.join(F.broadcast(verdict), "votes")  # 3 ** len(RULES) rows at most
    found = found.withColumn("base_failed", F.expr(BASE_FAILED))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that judge() keeps, with their own columns."""
    return judge(docs, text_col).where("kept").select("_row.*")


