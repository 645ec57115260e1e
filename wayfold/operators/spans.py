"""Passages that stand literally in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a run that finds candidates, at most; characters of a piece of a word that does, for passages of one or two words.
RUN, PIECE = 5, 8


def _runs(words: str, n: int) -> Column:
    """Hashes of the distinct runs of n words."""
    run = F.expr(f"transform(sequence(0, size({words}) - {n}), i -> xxhash64({', '.join(f'get({words}, i + {k})' for k in range(n))}))")
    return F.when(F.size(words) >= n, F.array_distinct(run))


def literal(items: DataFrame, passage: str, docs: DataFrame, text: str) -> DataFrame:
    """Rows of items with rows of docs whose text contains the passage, and start, the place of its first occurrence (from 0).

    All but the first and the last word of a passage stand whole wherever it
    does, so the first RUN of those are matched with the runs of texts by hash.
    A passage of one or two words has none: the first characters of its longer
    word are matched with the pieces of the texts' distinct words.  Then the
    passage itself is looked for.  All is by equal keys; a text sends only runs
    and pieces, and only those that some passage has go on to meet it.  Null
    passages, and those of white space alone, are found nowhere.
    """
    both = [c for c in docs.columns if c in items.columns]
    if both:
        raise ValueError(f"columns of both sides: {both}")
    asked = items.where(F.length(passage) > 0).withColumn("_w", F.split(passage, r"\s+"))
    asked = asked.withColumn("_n", F.least(F.lit(RUN), F.size("_w") - 2)).withColumn("_long", F.array_max(F.transform("_w", lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    asked = asked.where("_n > 0 or _long.n > 0")
    shapes = asked.groupBy(F.greatest("_n", F.lit(0)).alias("_n")).agg(F.min(F.least(F.lit(PIECE), "_long.n")).alias("q")).orderBy("_n").collect()  # RUN + 1 rows at most
    numbered = docs.withColumn("_d", F.xxhash64(*docs.columns))
    words = numbered.select("_d", F.split(text, r"\s+").alias("_t"))
    near = None
    for n, q in shapes:
        mine = asked.where(F.greatest("_n", F.lit(0)) == n)
        if n:
            keyed = mine.withColumn("_h", F.expr(f"xxhash64({', '.join(f'get(_w, {k + 1})' for k in range(n))})"))
            keys = words.select("_d", F.explode(_runs("_t", n)).alias("_h"))
        else:
            keyed = mine.withColumn("_h", F.xxhash64(F.substring("_long.w", 1, q)))
            letters = words.select("_d", F.explode(F.array_distinct("_t")).alias("_x")).where(F.length("_x") >= q).select("_d", F.split("_x", "").alias("_x"))
            piece = F.expr(f"transform(sequence(0, size(_x) - {q}), i -> xxhash64(concat({', '.join(f'get(_x, i + {k})' for k in range(q))})))")
            keys = letters.select("_d", F.explode(F.array_distinct(piece)).alias("_h"))
        hits = keys.join(keyed.select("_h").distinct(), "_h", "left_semi").distinct()
        found = hits.join(keyed.drop("_w", "_n", "_long"), "_h").drop("_h").distinct()
        near = found if near is None else near.union(found)
    if near is None:
        near = asked.drop("_w", "_n", "_long").withColumn("_d", F.lit(0).cast("long")).where("false")
    held = near.join(numbered, "_d").where(F.contains(text, passage))
    return held.select(*items.columns, *docs.columns).withColumn("start", (F.expr(f"locate(`{passage}`, `{text}`)") - 1).cast("long"))
