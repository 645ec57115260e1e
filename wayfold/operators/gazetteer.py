"""Where a report's event happened: names of places found in its text, and what they agree on.

Names are matched as whole words by an equi-join: a text sends only those runs
of words that may name a place, the ones a few words after a preposition of
place and those that end in a kind of facility, so most of a text never leaves
its row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import haversine_km
from ..session import written

# Prepositions of place, directions before "of", words between them and a name, kinds of facilities, names that are too common, lengths, distances, confidences.
PREPOSITIONS = "in near at inside outside across throughout around off over".split()
DIRECTIONS = "east west north south".split()
BETWEEN = 4
FACILITIES = "airport port harbour harbor terminal".split()
BASES = "air naval".split()
AMBIGUOUS = ["alert", "central", "reading", "mobile", "normal", "union", "victory", "advance", "airport", "international", "national", "new town"]
LEAST_PLACE, LEAST_COUNTRY, ONE_PLACE_KM, PRECISION_KM = 5, 4, 50.0, 35.0
STRUCTURED, PLACED, COUNTRY = 0.9, 0.78, 0.62


def words(text: Column) -> Column:
    """Lower-case runs of a-z and 0-9 in order; null text has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


def names(rows: DataFrame, name: str, least: int) -> DataFrame:
    """Rows with phrase, the words of a name joined by blanks, and size, their number; names that are too short or too common drop out."""
    found = rows.withColumn("phrase", F.array_join(words(F.col(name)), " ")).where((F.length("phrase") >= least) & ~F.col("phrase").isin(AMBIGUOUS))
    return found.withColumn("size", F.size(F.split("phrase", " ")))


def mentions(docs: DataFrame, ident: str, text: Column, phrases: DataFrame) -> DataFrame:
    """Names that stand in texts: ident, phrase and near (a preposition of place stands at most BETWEEN words before one of its places).

    phrases has phrase and size (its words).  A name counts where it is near, or
    where it ends in a kind of facility.  One row for each text and name.  Texts
    may be of any length; null has no names.
    """
    sizes = [r["size"] for r in phrases.select("size").distinct().orderBy("size").collect()]  # lengths of names in words: a few
    if not sizes:
        return docs.where("false").select(ident, F.lit("").alias("phrase"), F.lit(False).alias("near"))
    # What follows each preposition, as far as a name may reach; such stretches overlap.
    before = "|".join([*PREPOSITIONS, f"(?:{'|'.join(DIRECTIONS)}) of"])
    ahead = rf" (?:{before})(?= ([a-z0-9]+(?: [a-z0-9]+){{0,{BETWEEN + sizes[-1] - 1}}}))"
    w = docs.select(F.col(ident), F.concat(F.lit(" "), F.array_join(words(text), " ")).alias("_t"))
    w = w.select(ident, "_t", F.transform(F.array_distinct(F.regexp_extract_all("_t", F.lit(ahead), F.lit(1))), lambda v: F.split(v, " ")).alias("_u"))
    w = w.withColumn("_f", F.when(F.rlike("_t", F.lit(f" (?:{'|'.join([*FACILITIES, 'base'])})(?: |$)")), F.split(F.substr("_t", F.lit(2)), " ")))
    kind = f"x in ({_quoted(FACILITIES)}) or (x = 'base' and coalesce(get(_f, i - 1) in ({_quoted(BASES)}), false))"
    w = w.withColumn("_e", F.expr(f"array_compact(transform(_f, (x, i) -> if({kind}, i, null)))"))

    def run(source: str, start: str, n: int, near: bool) -> str:
        return f"struct(concat_ws(' ', {', '.join(f'get({source}, {start} + {k})' for k in range(n))}) as phrase, {str(near).lower()} as near)"

    after = ", ".join(f"if(size(u) >= {o + n}, {run('u', str(o), n, True)}, null)" for n in sizes for o in range(BETWEEN + 1))
    ending = ", ".join(f"if(e >= {n - 1}, {run('_f', f'e - {n - 1}', n, False)}, null)" for n in sizes)
    near = F.expr(f"flatten(transform(_u, u -> array_compact(array({after}))))")
    facility = F.expr(f"if(_e is null or size(_e) = 0, null, flatten(transform(_e, e -> array_compact(array({ending})))))")
    runs = [near, F.coalesce(facility, F.expr("cast(array() as array<struct<phrase: string, near: boolean>>)"))]
    each = w.select(ident, F.explode(F.array_distinct(F.concat(*runs))).alias("r")).select(ident, "r.*")
    return each.join(phrases.select("phrase").distinct(), "phrase", "left_semi").groupBy(ident, "phrase").agg(F.max("near").alias("near"))


def infer(docs: DataFrame, ident: str, text: Column, places: DataFrame, countries: DataFrame) -> DataFrame:
    """One row for each report: ident, status, origin, label, country, lat, lon, precision_km and confidence.

    docs: place, country and country_code (strings, what the source itself says)
    besides ident and the text.  places: place_id, alias (a row for each name of
    a place), code, lat and lon.  countries: code and name, one row each.  What
    the source says comes before places named in the text, those before
    countries, those before none.  Named places count if all of them lie within
    ONE_PLACE_KM of the one with the longest name (ties to the smallest
    place_id, then name); countries if there is one.  status: located,
    country-only or no-grounded-location.  A name that many reports hold is
    joined with the few rows of its places, which Spark broadcasts where they are
    small and else splits by size.  ident is unique; an empty table gives none.
    """
    known = countries.where("code is not null").groupBy("code").agg(F.min("name").alias("name"))
    found_places = names(places.where("lat is not null and lon is not null"), "alias", LEAST_PLACE)
    found_countries = names(countries.select("code", "name"), "name", LEAST_COUNTRY)
    both = found_places.select("phrase", "size").union(found_countries.select("phrase", "size")).distinct()
    hits = written(mentions(docs, ident, text, both), "mentions")
    spots = found_places.select("phrase", "place_id", "alias", "code", "lat", "lon").distinct()
    at = hits.join(spots, "phrase").select(ident, F.struct(F.length("alias").alias("n"), (-F.col("place_id")).alias("p"), F.col("alias").alias("label"), "code", "lat", "lon").alias("m"))
    at = at.withColumn("best", F.max("m").over(Window.partitionBy(ident)))
    km = haversine_km(F.col("m.lat"), F.col("m.lon"), F.col("best.lat"), F.col("best.lon"))
    placed = at.groupBy(ident).agg(F.first("best").alias("b"), F.max(km).alias("km")).where(F.col("km") <= ONE_PLACE_KM)
    placed = placed.join(known.select(F.col("code").alias("_c"), F.col("name").alias("placed_country")), F.col("b.code") == F.col("_c"), "left").drop("_c", "km")
    named = hits.where("near").join(found_countries.select("phrase", "name").distinct(), "phrase").groupBy(ident).agg(F.min("name").alias("named"), F.count_distinct("name").alias("_n")).where("_n = 1").drop("_n")
    said = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    own = docs.select(ident, said("place").alias("place"), said("country").alias("said"), F.upper(F.substring(said("country_code"), 1, 2)).alias("code"))
    own = own.join(known, "code", "left").select(ident, "place", F.coalesce("said", "name").alias("own"))
    rows = own.join(placed, ident, "left").join(named, ident, "left")
    structured, has_place, has_country = F.coalesce("place", "own").isNotNull(), F.col("b").isNotNull(), F.col("named").isNotNull()

    def chosen(first: Column, second: Column, third: Column) -> Column:
        return F.when(structured, first).when(has_place, second).when(has_country, third)

    none = F.lit(None)
    country = chosen(F.col("own"), F.col("placed_country"), F.col("named"))
    return rows.select(
        ident,
        F.when(~structured & has_place, "located").when(country.isNotNull(), "country-only").otherwise("no-grounded-location").alias("status"),
        chosen(F.lit("source"), F.lit("gazetteer"), F.lit("country")).alias("origin"),
        chosen(F.coalesce("place", "own"), F.col("b.label"), F.col("named")).alias("label"),
        country.alias("country"),
        chosen(none, F.col("b.lat"), none).cast("double").alias("lat"),
        chosen(none, F.col("b.lon"), none).cast("double").alias("lon"),
        chosen(none, F.lit(PRECISION_KM), none).cast("double").alias("precision_km"),
        F.coalesce(chosen(F.lit(STRUCTURED), F.lit(PLACED), F.lit(COUNTRY)), F.lit(0.0)).alias("confidence"),
    )
