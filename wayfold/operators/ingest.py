"""Versioned ingest: logs of revisions, current records, idempotent appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def version_log(records: DataFrame, key: list[str], order: list[str], content: Column) -> DataFrame:
    """Records whose content differs from the one before under the same key, with version (1, 2, ...) and content_hash.

    The first record of a key counts as different.  Ties of order are broken by content.
    """
    hashed = records.withColumn("content_hash", F.sha2(content, 256))
    w = Window.partitionBy(*key).orderBy(*order, "content_hash")
    changed = hashed.withColumn("_before", F.lag("content_hash").over(w)).where("_before is null or _before <> content_hash").drop("_before")
    return changed.withColumn("version", F.row_number().over(w).cast("long"))


def latest(records: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last record of each key in the given total order: an aggregate with map-side combining, not a sort of each key's rows."""
    rest = [c for c in records.columns if c not in key]
    top = records.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return top.select(*key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def predecessor(log: DataFrame, key: list[str], version: str = "version") -> DataFrame:
    """The log with previous_hash, the content hash of the version before; null for the first."""
    return log.withColumn("previous_hash", F.lag("content_hash").over(Window.partitionBy(*key).orderBy(version)))


def upsert(current: DataFrame, new: DataFrame, key: list[str], at: str) -> DataFrame:
    """Current records after new ones: of each key the row with the latest time, the new one where times are equal; late rows lose."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, key, [at, "_new"]).drop("_new")


def append_missing(history: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new whose key isn't in history, one for each key."""
    return new.dropDuplicates(key).join(history.select(*key).distinct(), key, "left_anti")


def deleted(known: DataFrame, present: DataFrame, key: list[str]) -> DataFrame:
    """Keys that were known and aren't present any more."""
    return known.select(*key).distinct().join(present.select(*key), key, "left_anti")


#: Parts of a group of copies: each is joined by itself.
SALTS = 64


def with_copies(rows: DataFrame, key: str, ident: str, carried: list[str] | None = None) -> DataFrame:
    """Rows with copies, how many rows share their key, and first, the row (ident and carried columns) with the smallest ident among them; null for single rows.

    A null key has no copies.  Keys are written once; a key's rows are dealt to
    SALTS parts, counted by part, then by key, and joined part by part, and
    nulls pass by, so no key is one task's.
    """
    kept = written(rows, "keys")
    dealt = kept.where(F.col(key).isNotNull()).withColumn("_s", F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy(key, "_s").agg(F.count("*").alias("_c"), F.min(F.struct(ident, *(carried or []))).alias("_m"))
    whole = Window.partitionBy(key)
    groups = parts.select(key, "_s", F.sum("_c").over(whole).alias("copies"), F.min("_m").over(whole).alias("first")).where("copies > 1")
    joined = dealt.join(groups, [key, "_s"], "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    none = kept.where(F.col(key).isNull()).withColumns({"copies": F.lit(1).cast("long"), "first": F.lit(None).cast(groups.schema["first"].dataType)})
    return joined.select(*kept.columns, "copies", "first").union(none.select(*kept.columns, "copies", "first"))
