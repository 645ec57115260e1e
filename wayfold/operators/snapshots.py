"""What was known of a situation at each of many times, from one pass over its rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def at_cutoffs(rows: DataFrame, group: str, at: str, cutoffs: DataFrame, distinct: dict[str, str], counted: dict[str, Column]) -> DataFrame:
    """Counts of every group at every cutoff: group, cutoff, a column for each entry of distinct and counted, and snapshot_hash.

    distinct: name -> column whose different values count from their first
    appearance; counted: name -> condition whose rows count.  Rows at a cutoff
    belong to it.  A value's first row is found once, falls into the interval
    that ends with the first cutoff after it, and running sums over the
    intervals give what a scan for each cutoff would.  snapshot_hash is the
    SHA-256 of name=value, sorted by name.

    cutoffs: one column cutoff; their number is the caller's and goes to every
    task.  Groups appear at cutoffs before their first row with zeros; rows
    after the last cutoff, and null times, count nowhere, but make their group
    appear.  Null values of a distinct column aren't counted; a null group is a
    group.  No cutoffs give no rows.
    """
    ends = sorted(r["cutoff"] for r in cutoffs.where("cutoff is not null").distinct().collect())
    kind = rows.schema[at].dataType
    times = F.array(*[F.lit(t).cast(kind) for t in ends]) if ends else F.array().cast(f"array<{kind.simpleString()}>")
    # The place of the first cutoff at or after a time; 0 after the last.
    found = F.array_position(F.transform(times, lambda t: t >= F.col(at)), F.lit(True))
    placed = rows.withColumn("_i", F.when(F.col(at).isNotNull() & (found > 0), (found - 1).cast("int")))
    parts = []
    for name, column in distinct.items():
        first = placed.where(F.col(column).isNotNull() & F.col("_i").isNotNull()).groupBy(group, column).agg(F.min("_i").alias("_i"))
        parts.append(first.groupBy(group, "_i").agg(F.count("*").alias("n")).select(group, "_i", F.lit(name).alias("name"), "n"))
    if counted:
        sums = placed.where(F.col("_i").isNotNull()).groupBy(group, "_i").agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
        parts += [sums.select(group, "_i", F.lit(n).alias("name"), F.col(n).alias("n")) for n in counted]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    names = [*distinct, *counted]
    new = every.groupBy(group, "_i").agg(*[F.sum(F.when(F.col("name") == n, F.col("n")).otherwise(0)).alias(n) for n in names])
    grid = placed.select(group).distinct().withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(ends) - 1)))) if ends else placed.select(group, "_i").where("false")
    zeros = [F.lit(0).cast("long").alias(n) for n in names]
    filled = new.union(grid.select(group, "_i", *zeros)).groupBy(group, "_i").agg(*[F.sum(n).alias(n) for n in names])
    upto = Window.partitionBy(group).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = filled.select(group, F.get(times, F.col("_i")).alias("cutoff"), *[F.sum(n).over(upto).alias(n) for n in names])
    text = F.concat_ws(",", *[F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in sorted(names)])
    return known.withColumn("snapshot_hash", F.sha2(text, 256))
