"""Selection of work: fairness between keys, aging priorities, gates, pages, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared_path


def round_robin(rows: DataFrame, key: str, order: list[Column | str], cursor: str | None, limit: int) -> DataFrame:
    """limit rows, first of every key, then second, ...; keys after the cursor come first within a round.  Adds turn.

    Ranks beyond the limit can't be chosen, so each key sorts its first rows only.
    """
    turn = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    ranked = rows.withColumn("turn", turn).where(F.col("turn") <= limit)
    later = F.lit(True) if cursor is None else F.col(key) > cursor
    return ranked.orderBy("turn", later.desc(), key).limit(limit)


def aged(priority: Column, days: Column, rate: float = 0.03, most: float = 0.5) -> Column:
    """Priority that grows with age in days."""
    return priority + F.least(F.lit(most), F.greatest(F.lit(0.0), days * rate))


def page(rows: DataFrame, cursor: int, ident: str, size: int) -> DataFrame:
    """The next rows after a cursor, by id: a filter and a top-k."""
    return rows.where(F.col(ident) > cursor).orderBy(ident).limit(size)


def family_gate(rows: DataFrame, event: str, publisher: str, family: str, least: int = 2) -> DataFrame:
    """Events with publishers and families, and whether both reach least."""
    found = rows.groupBy(event).agg(F.count_distinct(publisher).alias("publishers"), F.count_distinct(family).alias("families"))
    return found.withColumn("ready", (F.col("publishers") >= least) & (F.col("families") >= least))


def merged_intervals(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals of each key with overlapping and touching ones merged: key, begins, ends, parts.

    Null or reversed intervals are left out.
    """
    w = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = rows.where(F.col(end) >= F.col(start)).withColumn("_new", F.when(reach >= F.col(start), 0).otherwise(1))
    islands = opened.withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return islands.groupBy(key, "_k").agg(F.min(start).alias("begins"), F.max(end).alias("ends"), F.count("*").alias("parts")).drop("_k")


def backoff_seconds(attempts: Column, base: float, most: float, doublings: int) -> Column:
    """base * 2 ** (attempts - 1), doublings at most, most at most."""
    return F.least(F.lit(most), base * F.pow(F.lit(2.0), F.least(F.lit(doublings), F.greatest(F.lit(0), attempts - 1))))


def roots(aliases: DataFrame, ident: str, target: str, depth: int | None = None) -> DataFrame:
    """ident with root, the record that its chain of aliases ends in; null where the chain doesn't end (a cycle).

    A null or own target ends a chain, as does one that has no row.  Pointers
    are doubled until no chain that ends is still open, so chains of n links
    take log2(n) joins, and cycles at most log2 of the number of rows.  depth
    is the length that is expected: so many links are followed before the first
    look; longer chains are followed to their ends all the same.
    """
    low = aliases.select(F.col(ident).alias("id"), F.coalesce(target, ident).alias("root"))
    going = low.where("id <> root").select(F.col("id").alias("root"), F.lit(True).alias("open")).dropDuplicates(["root"])  # a chain that rests on one of these hasn't ended
    spark, path = aliases.sparkSession, shared_path(aliases.sparkSession, "roots")
    rounds, done, most = (depth or 64).bit_length(), 0, None
    while True:
        for _ in range(rounds):
            up = low.select(F.col("id").alias("root"), F.col("root").alias("above"))
            low = low.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"))
        done += rounds
        low.write.parquet(f"{path}/{done}")  # ends the lineage, which doubles with each round
        low, rounds = spark.read.schema(low.schema).parquet(f"{path}/{done}"), 1
        if not low.join(going, "root", "left_semi").limit(1).count():
            break
        most = aliases.count().bit_length() if most is None else most
        if done >= most:  # what is open now is a cycle
            break
    return low.join(going, "root", "left").select(F.col("id").alias(ident), F.when(F.col("open").isNull(), F.col("root")).alias("root"))
