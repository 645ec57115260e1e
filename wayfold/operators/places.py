"""Rollups and anomalies over places and time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import EARTH_KM, haversine_km
from ..session import ship, written

#: Places of a chunk on average, and rows that are compared at once; kilometres that a distance by product may be off, doubled, and half the last digit of a summand.
TILE, STEP, SLACK, ROUNDED = 4000, 256, 0.002, 1e-4


def daily_cells(observations: DataFrame, cell: str, kind: str, at: str, severity: str) -> DataFrame:
    """Observations of each cell, kind and UTC day: n, max_severity, total_severity."""
    day = F.date_trunc("day", at).alias("day")
    return observations.groupBy(cell, kind, day).agg(F.count("*").alias("n"), F.max(severity).alias("max_severity"), F.sum(severity).alias("total_severity"))


def density_anomalies(cells: DataFrame, cell: str, kind: str, least: int = 3, times: float = 2.0) -> DataFrame:
    """Cell days with at least so many observations and so many times the mean of all earlier days of that cell and kind; score (n - base) / max(3, 3 base), 1 at most."""
    before = Window.partitionBy(cell, kind).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    based = cells.withColumn("baseline", F.avg("n").over(before)).where((F.col("n") >= least) & (F.col("n") >= times * F.col("baseline")))
    score = F.least(F.lit(1.0), (F.col("n") - F.col("baseline")) / F.greatest(F.lit(3.0), 3 * F.col("baseline")))
    return based.withColumn("score", score)


def changes(observations: DataFrame, feature: list[str], at: list[str], value: str, step: float) -> DataFrame:
    """Observations whose value rose by step or more since the one before of the same feature."""
    before = F.lag(value).over(Window.partitionBy(*feature).orderBy(*at))
    return observations.withColumn("previous", before).where(F.col(value) - F.col("previous") >= step)


def medoids(members: DataFrame, group: str, ident: str, lat: str, lon: str, weight: str) -> DataFrame:
    """The member of each group with the least weighted sum of distances to all members, with that sum and the group's size; ties to the smallest id.

    Members at one place are merged first, so a group costs the square of its
    distinct places, not of its members.  A group's places are dealt to chunks
    by id, and every two chunks are summed in one task by matrix product; only
    members whose sum may be the least, for all that this rounds, are summed
    exactly.  A member of unknown place is one only where all are.
    """
    ship(members.sparkSession)
    spots = members.groupBy(group, lat, lon).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"), F.min(ident).alias("_id"))
    spots = written(spots.select(F.col(group).alias("_g"), F.col(lat).cast("double").alias("_lat"), F.col(lon).cast("double").alias("_lon"), "_id", F.col("_w").cast("double").alias("_w"), "_n"), "spots")
    known = spots.where("_g is not null and _lat is not null and _lon is not null")
    sizes = known.groupBy("_g").agg(F.ceil(F.count("*") / TILE).cast("int").alias("_parts"), (F.sum(F.abs("_w")) * SLACK + F.sum("_n") * ROUNDED).alias("_slack"))
    dealt = known.join(sizes, "_g").withColumn("_part", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")).withColumn("_q", F.explode(F.expr("sequence(0, _parts - 1)")))
    side = lambda a, b, n: dealt.select("_g", F.col(a).alias("_from"), F.col(b).alias("_to"), F.lit(n).alias("side"), "_id", "_lat", "_lon", "_w")
    kind = spots.schema
    sums = side("_part", "_q", 0).union(side("_q", "_part", 1)).groupBy("_g", "_from", "_to").applyInArrow(_sums, f"_g {kind['_g'].dataType.simpleString()}, _id {kind['_id'].dataType.simpleString()}, _far double")
    far = written(sums.groupBy("_g", "_id").agg(F.sum("_far").alias("_far")), "sums")
    least = far.groupBy("_g").agg(F.min("_far").alias("_least")).join(sizes, "_g")
    near = far.join(least, "_g").where("_far <= _least + _slack").select("_g", "_id")
    unknown = spots.where("_lat is null or _lon is null").select("_g", "_id")
    a = spots.select("_g", "_id", "_lat", "_lon").join(near.union(unknown), ["_g", "_id"], "left_semi")
    b = spots.select("_g", F.col("_lat").alias("_lat2"), F.col("_lon").alias("_lon2"), "_w", "_n")
    km = haversine_km(F.col("_lat"), F.col("_lon"), F.col("_lat2"), F.col("_lon2"))
    exact = a.join(b, "_g").groupBy("_g", "_id").agg(F.sum((F.col("_w") * km).cast("decimal(28,4)")).alias("spread"), F.sum("_n").alias("members"))
    best = exact.groupBy("_g").agg(F.min(F.struct(F.isnull("spread").alias("none"), "spread", "_id", "members")).alias("_b"))
    return best.select(F.col("_g").alias(group), F.col("_b._id").alias("medoid"), F.col("_b.spread").alias("spread"), F.col("_b.members").alias("members"))


def _sums(table: pa.Table) -> pa.Table:
    """Weighted sums of the kilometres from the places of side 0 to those of side 1."""
    side = np.asarray(table.column("side"))
    lat, lon = (np.radians(np.asarray(table.column(c), np.float64)) for c in ("_lat", "_lon"))
    at = np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)
    weight = np.nan_to_num(np.asarray(table.column("_w").fill_null(0.0), np.float64))[side == 1]
    a, b = at[side == 0], at[side == 1]
    far = [np.arccos(np.clip(a[i : i + STEP] @ b.T, -1, 1)) @ weight for i in range(0, len(a), STEP)]
    mine = table.filter(pa.array(side == 0))
    return pa.table({"_g": mine.column("_g"), "_id": mine.column("_id"), "_far": EARTH_KM * np.concatenate([*far, np.zeros(0)])})
