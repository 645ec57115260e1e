"""Ranked search in remembered text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def bm25(rows: DataFrame, ident: list[str], text: str, terms: list[str]) -> DataFrame:
    """Rows that hold a term, with score: BM25 over tokens of three or more characters of a-z and 0-9.

    Only the terms' counts are shuffled: a row's length and term counts are
    taken where it is read.  Terms shorter than three characters don't count.
    """
    terms = sorted({t.lower() for t in terms if len(t) > 2})
    counted = rows.select(*ident, F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{3,}"), F.lit(0)).alias("_t"))

    def times(term: str):
        return F.size(F.filter("_t", lambda x: x == term))

    tf = [times(t).alias(f"_f{i}") for i, t in enumerate(terms)]
    counted = counted.select(*ident, F.size("_t").alias("_len"), *tf)
    corpus = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.ln(1 + (F.col("_n") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        score = score + idf * F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + K1 * (1 - B + B * F.col("_len") / F.col("_mean")))
    hit = F.greatest(*[F.col(f"_f{i}") for i in range(len(terms))], F.lit(0)) > 0
    one_row = F.broadcast(corpus)  # a single row
    return counted.where(hit).join(one_row, F.lit(True)).select(*ident, score.alias("score"))
