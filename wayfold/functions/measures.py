"""Column expressions that compare and combine: sets, vectors, places, probabilities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def jaccard(a: Column, b: Column) -> Column:
    """Common elements over all; 0 when both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Common elements over those of the smaller set; 0 when one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 for unequal lengths, empty and zero vectors; clamped to [-1, 1]."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / norms))).otherwise(0.0)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM) -> Column:
    """Great-circle distance; null unless all four are known."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    chord = F.sqrt(half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2))
    return 2 * radius * F.asin(F.when(chord > 1, F.lit(1.0)).otherwise(chord))


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Whether a place lies in a box, which may cross the 180th meridian (west > east)."""
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & inside


def grid_key(lat: Column, lon: Column, per_degree: int = 2, zoom: int = 6) -> Column:
    """The cell of a place: z6:row:column."""
    return F.concat_ws(":", F.lit(f"z{zoom}"), F.floor((lat + 90) * per_degree), F.floor((lon + 180) * per_degree))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def logit(p: Column) -> Column:
    return F.ln(p / (1 - p))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def pooled(parts: list[tuple[Column, float]], low: float = 0.05, high: float = 0.95) -> Column:
    """Probabilities pooled by weighted log odds; absent (null) parts give their weight to the others."""
    total = sum((F.when(p.isNotNull(), w).otherwise(0.0) for p, w in parts), F.lit(0.0))
    odds = sum((F.coalesce(logit(clamp(p, low, high)) * w, F.lit(0.0)) for p, w in parts), F.lit(0.0))
    return F.when(total > 0, clamp(sigmoid(odds / total), low, high))
