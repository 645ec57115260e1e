"""What each filter of a chain removes in every order: edges of the lattice of filter sets, and paths along them.

A document's failures are a set of filters, and what happens to it when a
filter is applied depends on which filters came before, not on their order.  So
n filters have n * 2 ** (n - 1) edges (filters applied already, next filter)
however many orders there are.  Documents are counted by their failures first,
those counts go to the edges, and every order reads its steps from the edges
that it walks along.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which rows without an id are dealt.
SALTS = 64

#: The filters' failure conditions over _t (text) and _w (its words); E, a copy of an earlier text, needs the table.
FAILS = {
    "A": "size(_w) < 100",
    "B": "100L * size(array_distinct(_w)) < 80L * size(_w)",
    "C": "100L * (char_length(_t) - char_length(translate(_t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10L * char_length(_t)",
    "D": "_t rlike '[#$%&*|]'",
}
COPY = "E"
LETTERS = "".join(FAILS) + COPY


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Documents counted by what they fail: part, mask (bit i: fails LETTERS[i]), good, toxic (boolean) and n (long).

    A document fails E if its whole text is that of a row with a smaller id
    anywhere in the table; texts are compared by SHA-256.  All rows of a text
    have the same other failures, so a text's rows are counted together, with the
    smallest id among them, and no row is joined with its copies: a text that a
    third of all rows share is one row of each task before it is shuffled.

    Null text is empty, a null part the empty string.  A row without an id has
    no label, no smaller id and is no other row's smaller one.  Repeated rows
    count each.  An id with several labels is good, or toxic, if one of them says so.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.select("*", F.expr(r"array_remove(split(_t, '[\\x20\\x09-\\x0D]+'), '')").alias("_w"))
    mask = " + ".join(f"if({bad}, {1 << i}, 0)" for i, bad in enumerate(FAILS.values()))
    rows = rows.select("_id", "part", F.expr(mask).alias("mask"), F.unhex(F.sha2("_t", 256)).alias("_text"), F.expr(f"if(_id is null, pmod(xxhash64(_t), {SALTS}), 0)").cast("int").alias("_salt"))
    said = labels.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).withColumn("_salt", F.lit(0))
    rows = rows.join(said, ["_id", "_salt"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    group = ["_text", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("_id", "_salt", *group).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("_id").isNotNull(), F.struct("_id", "n"))).alias("_first")
    by_text = by_id.groupBy(*group).agg(F.sum("n").alias("n"), first, F.sum(F.when(F.col("_id").isNull(), F.col("n")).otherwise(0)).alias("_without"))
    earliest = F.min("_first._id").over(Window.partitionBy("_text"))
    by_text = by_text.withColumn("_own", F.col("_without") + F.when(F.col("_first._id") == earliest, F.col("_first.n")).otherwise(0))
    split = F.array(F.struct("mask", F.col("_own").alias("n")), F.struct((F.col("mask") + (1 << len(FAILS))).alias("mask"), (F.col("n") - F.col("_own")).alias("n")))
    each = by_text.select("part", "good", "toxic", F.explode(split).alias("s")).where("s.n > 0")
    return each.groupBy("part", "s.mask", "good", "toxic").agg(F.sum("s.n").alias("n"))


def edges(counted: DataFrame, n_filters: int) -> DataFrame:
    """Counts on every edge of the lattice: part, applied, next (bits), kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    counted: part, mask, good, toxic and n.  Every part has all edges, zeros
    included.  An order in which the filters of an edge's applied set come first
    is one of |applied|! * (n_filters - 1 - |applied|)!; shapley is a filter's
    removed over all orders.
    """
    lattice = [(s, 1 << f) for f in range(n_filters) for s in range(1 << n_filters) if not s >> f & 1]
    edge = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in lattice]))
    on = counted.select("*", edge.alias("e")).select("*", "e.*")
    before, now = F.col("mask").bitwiseAND(F.col("applied")) != 0, F.col("mask").bitwiseAND(F.col("next")) != 0

    def total(which: Column) -> Column:
        return F.sum(F.when(which, F.col("n")).otherwise(0))

    summed = on.groupBy("part", "applied", "next").agg(
        total(~before & ~now).alias("kept"),
        total(~before & now).alias("removed"),
        total(before & now).alias("redundant"),
        total(F.col("mask") == F.col("next")).alias("unique_fails"),
        total(~before & now & F.col("good")).alias("good_lost"),
        total(~before & now & F.col("toxic")).alias("toxic_lost"),
    )
    orders = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n_filters - 1 - k)) for k in range(n_filters)]), F.bit_count("applied") + 1)
    return summed.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "next")))


def paths(walked: DataFrame, letters: str) -> DataFrame:
    """The edges that every order of the filters walks along: filter_order, step (from 1) and the counts of edges().

    Orders number letters! whatever the input; their steps are broadcast.
    """
    steps = []
    for order in permutations(range(len(letters))):
        name, applied = "".join(letters[f] for f in order), 0
        for step, f in enumerate(order, 1):
            steps.append((name, step, applied, 1 << f))
            applied |= 1 << f
    table = walked.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, next int")
    return walked.join(F.broadcast(table), ["applied", "next"]).select("part", "filter_order", "step", *[c for c in walked.columns if c not in ("part", "applied", "next")])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (long).

    Filters, nulls and repeats as failures() says; columns of docs and labels
    that aren't named may have any names.  Texts of any length are read whole.
    An empty table of documents gives no parts and no rows; without labels
    nothing good or toxic is lost.
    """
    return paths(edges(failures(docs, labels, id_col, text_col, part_col), len(LETTERS)), LETTERS)
