"""Shapes of GeoJSON as points: center, box and the shape that is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Levels of arrays that are looked into, points that count, characters of a shape that is kept whole.
DEPTH, POINTS, LONGEST = 8, 5000, 250_000

_NUMBER = "^(BIGINT|DOUBLE|FLOAT|DECIMAL)"


def _items(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _number(v: Column) -> Column:
    """v where it is a number; neither text that reads like one nor a boolean."""
    return F.when(F.schema_of_variant(v).rlike(_NUMBER), F.try_variant_get(v, "$", "double"))


def _once(x: Column, use) -> Column:
    """use(x), with x computed once."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def _node(v: Column) -> Column:
    """x and y of a point; else the entries of an array, or none."""

    def told(items: Column) -> Column:
        def placed(p: Column) -> Column:
            whole = p["x"].isNotNull() & p["y"].isNotNull()
            return F.struct(F.when(~whole, items).alias("inside"), F.when(whole, p["x"]).alias("x"), F.when(whole, p["y"]).alias("y"))

        two = F.struct(_number(F.get(items, F.lit(0))).alias("x"), _number(F.get(items, F.lit(1))).alias("y"))
        return _once(F.when(F.size(items) >= 2, two).otherwise(F.struct(F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))), placed)

    return _once(_items(v), told)


def _level(found: Column, _: Column) -> Column:
    """Points as they are, other arrays' entries, and nothing for the rest; unchanged where only points are left."""
    nothing = F.array().cast("array<struct<inside:array<variant>,x:double,y:double>>")
    opened = F.flatten(F.transform(found, lambda n: F.when(n["x"].isNotNull(), F.array(n)).otherwise(F.coalesce(F.transform(n["inside"], _node), nothing))))
    return F.when(F.exists(found, lambda n: n["x"].isNull()), opened).otherwise(found)


def shape(text: Column, lat: Column, lon: Column) -> Column:
    """type, latitude, longitude, west, south, east, north, points and geometry of a GeoJSON geometry (text); null where there is no point at all.

    Arrays are opened level by level, eight levels below coordinates, in the
    JVM: points stay in place, so their order is that of the text.  A point is an
    array of two numbers or more; one outside the world counts for nothing and
    isn't opened.  The first 5000 points give the mean and the box.  lat and lon
    stand in where the text holds no point (null, broken, no object, no or empty
    coordinates, deeper than that); then type is Point, or the text's own type
    where it has coordinates that hold no point, but the geometry kept is the
    point.  A shape of more than 250000 characters is kept as its center.
    """
    def told(v: Column) -> Column:
        coordinates = F.try_variant_get(v, "$.coordinates", "variant")
        nodes = F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.array(_node(coordinates)), _level)
        seen = F.filter(nodes, lambda n: n["x"].between(-180, 180) & n["y"].between(-90, 90))
        points = F.slice(F.transform(seen, lambda n: F.struct(n["x"].alias("x"), n["y"].alias("y"))), 1, POINTS)
        return _once(F.struct(points.alias("own"), coordinates.alias("coordinates"), F.try_variant_get(v, "$.type", "string").alias("type")), lambda s: _summary(s, lat, lon))

    return _once(F.try_parse_json(text), told)


def _summary(s: Column, lat: Column, lon: Column) -> Column:
    stand_in = F.when(lat.isNotNull() & lon.isNotNull(), F.array(F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y"))))
    own = F.size(s["own"]) > 0
    kind = F.substring(F.coalesce(F.nullif(s["type"], F.lit("")), F.lit("Point")), 1, 30)

    def told(p: Column) -> Column:
        xs, ys = F.transform(p, lambda n: n["x"]), F.transform(p, lambda n: n["y"])
        mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
        whole = F.to_json(F.struct(kind.alias("type"), s["coordinates"].alias("coordinates")))
        center = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(mean(xs), mean(ys)).alias("coordinates")))
        kept = _once(whole, lambda w: F.when(own & (F.length(w) <= LONGEST), w).otherwise(center))
        return F.struct(
            F.when(own, kind).otherwise("Point").alias("type"), mean(ys).alias("latitude"), mean(xs).alias("longitude"),
            F.array_min(xs).alias("west"), F.array_min(ys).alias("south"), F.array_max(xs).alias("east"), F.array_max(ys).alias("north"),
            F.size(p).alias("points"), kept.alias("geometry"))

    return _once(F.when(own, s["own"]).otherwise(stand_in), lambda p: F.when(p.isNotNull(), told(p)))
