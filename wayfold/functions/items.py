"""Column expressions over items and their metadata: names, places, severity, kinds, topics, identifiers, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import tokens

# Words that features leave out, names that say nothing, and metadata fields that hold names.
FEATURE_STOP = "a an and as at by for from in is of on or the to update updates with new live breaking report reports reported says said".split()
GENERIC = "breaking category depth earthquake green magnitude media media-post notification population special-weather special-weather-statement statement storm tropical-cyclone weather world".split()
NAME_FIELDS = "place places country countries region regions city cities organization organizations actor actors disasters event office".split()
# Words that the comparison of reports leaves out.
REPORT_STOP = "about after again against from have into more over said that their there they this with will would".split()
# Severity of alert labels; confidence of fire labels.
SEVERITY = {"extreme": 1.0, "red": 1.0, "severe": 0.85, "orange": 0.72, "moderate": 0.58, "green": 0.35, "minor": 0.3}
FIRE_CONFIDENCE = {"low": 0.35, "nominal": 0.65, "high": 0.9}
# Terms of category families, in the order in which they are tried.
FAMILIES = {"hazard": ["earthquake", "flood", "storm", "fire", "volcano", "hazard"], "conflict": ["conflict", "battle", "violence", "protest"], "health": ["outbreak", "health", "disease"], "emergency": ["emergency", "humanitarian", "disaster"], "news": ["news", "social", "report"]}
# Terms of feature types in an event's name, in the order in which they are tried.
FEATURES = {"earthquake": ["earthquake"], "wildfire": ["wildfire", "fire"], "flood": ["flood"], "storm": ["storm", "cyclone", "hurricane"], "volcano": ["volcano"], "drought": ["drought"]}
# Other names of topics.
TOPICS = {"eq": "earthquake", "seismic": "earthquake", "severe-storms": "weather", "weather-alert": "weather", "wildfires": "wildfire", "floods": "flood", "known-exploited-vulnerability": "cybersecurity", "software-vulnerability": "cybersecurity", "civil-unrest": "conflict", "disease-outbreak": "public-health", "traditional-news": "general-news", "economic-indicator": "economics", "finance": "economics"}


def lookup(values: dict, key: Column) -> Column:
    """The value of a key in a small fixed table; null if there is none."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def normal_title(text: Column) -> Column:
    """Feature tokens in order, joined by blanks."""
    return F.array_join(F.sort_array(feature_tokens(text)), " ")


def feature_tokens(text: Column) -> Column:
    """Distinct tokens of three characters or more without the words that features leave out; null text has none."""
    return tokens(F.coalesce(text, F.lit("")), 3, FEATURE_STOP)


def report_tokens(text: Column) -> Column:
    """Distinct tokens of four characters or more without the words that comparisons leave out."""
    return tokens(F.coalesce(text, F.lit("")), 4, REPORT_STOP)


def name_key(value: Column) -> Column:
    """A name for comparison: lower case, other characters as single dashes; empty under three characters."""
    found = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(F.length(found) > 2, found).otherwise("")


def named_phrases(title: Column) -> Column:
    """Keys of runs of one to four capitalised words, without those that say nothing; in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit(r"\b(?:[A-Z][A-Za-z0-9.'-]+(?:\s+|$)){1,4}"), F.lit(0))
    said = F.array(*[F.lit(w) for w in sorted({*GENERIC, *FEATURE_STOP})])
    keys = F.array_distinct(F.transform(found, name_key))
    return F.filter(keys, lambda k: (k != "") & ~F.array_contains(said, k) & (F.size(F.array_except(F.split(k, "-"), said)) > 0))


def metadata_names(metadata: Column) -> Column:
    """Keys of the names in the metadata's (JSON) fields for names, single or in lists."""
    parts = []
    for field in NAME_FIELDS:
        raw = F.get_json_object(metadata, f"$.{field}")
        several = F.from_json(raw, "array<string>")
        parts.append(F.when(F.startswith(raw, F.lit("[")), several).otherwise(F.array(raw)))
    every = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts]))
    return F.array_distinct(F.filter(F.transform(every, name_key), lambda k: k != ""))


def item_names(title: Column, metadata: Column, most: int = 40) -> Column:
    """Sorted keys of all names in title and metadata, so many at most."""
    return F.slice(F.sort_array(F.array_union(metadata_names(metadata), named_phrases(title))), 1, most)


def location_key(lat: Column, lon: Column) -> Column:
    """A place to a tenth of a degree, zero without a sign; empty where unknown."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.1f,%.1f", F.bround(lat, 1), F.bround(lon, 1))).otherwise("")


def item_fingerprint(title: Column, summary: Column, least: int = 6) -> Column:
    """SHA-256 of all tokens of title and summary; empty under so many tokens, and for a title that only announces a post without a summary."""
    summary = F.coalesce(summary, F.lit(""))
    every = F.regexp_extract_all(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), summary)), F.lit("[a-z0-9]+"), F.lit(0))
    announced = F.coalesce(F.rlike(F.trim(title), F.lit("^(?i)(media post from|update from|breaking)")), F.lit(False))
    return F.when((F.size(every) >= least) & ~(announced & (F.trim(summary) == "")), F.sha2(F.array_join(every, " "), 256)).otherwise("")


def max_overlap(a: Column, b: Column) -> Column:
    """Common elements over those of the larger set; 0 when one is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))).otherwise(0.0)


def category_family(category: Column) -> Column:
    """The family of a category by the first term that it contains; else its own name as a key, general if empty."""
    low = F.lower(F.coalesce(category, F.lit("")))
    own = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-|-$", "")
    out = F.when(own != "", own).otherwise("general")
    for name, terms in reversed(FAMILIES.items()):
        out = F.when(F.rlike(low, F.lit("|".join(terms))), name).otherwise(out)
    return out


def feature_type(event: Column) -> Column:
    """The type of a map feature by the first term in its event's name; empty if none."""
    low, out = F.lower(F.coalesce(event, F.lit(""))), F.lit("")
    for name, terms in reversed(FEATURES.items()):
        out = F.when(F.rlike(low, F.lit("|".join(terms))), name).otherwise(out)
    return out


def severity(kind: Column, label: Column, magnitude: Column, power: Column) -> Column:
    """Severity from 0 to 1: an earthquake's magnitude over 8; of a wildfire the larger of its confidence (a label, a share or a percentage) and its radiative power over 100; else the alert label's, 0.5 for others."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    number = F.expr("try_cast(null as double)") if label is None else F.try_to_number(low, F.lit("999.999")).cast("double")
    confidence = F.when(number > 1, number / 100).otherwise(F.coalesce(number, lookup(FIRE_CONFIDENCE, low), F.lit(0.55)))
    fire = F.least(F.lit(1.0), F.greatest(confidence, F.least(F.lit(1.0), F.coalesce(power, F.lit(0.0)) / 100)))
    quake = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(magnitude, F.lit(0.0)) / 8.0))
    return F.when(kind == "earthquake", quake).when(kind == "wildfire", fire).otherwise(F.coalesce(lookup(SEVERITY, low), F.lit(0.5)))


def topic(value: Column) -> Column:
    """A topic's stable name."""
    low = F.replace(F.lower(F.trim(F.coalesce(value, F.lit("general")))), F.lit("_"), F.lit("-"))
    low = F.when(low == "", "general").otherwise(low)
    return F.substring(F.coalesce(lookup(TOPICS, low), low), 1, 80)


def urls(text: Column) -> Column:
    """URLs in a text without what ends a sentence."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"""(?i)https?://[^\s<>\]\[()"']+"""), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, "[.,;:!?]+$", ""))


def vulnerability_ids(text: Column) -> Column:
    """CVE and GHSA numbers in upper case, distinct, sorted."""
    form = r"(?i)\b(?:CVE-\d{4}-\d{4,}|GHSA(?:-[23456789cfghjmpqrvwx]{4}){3})\b"
    return F.sort_array(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(form), F.lit(0)), F.upper)))


def identifiers(metadata: Column, source: Column, fields: list[str]) -> Column:
    """Map source:field -> value of the metadata's (JSON) identifier fields that are there."""
    pairs = F.array(*[F.struct(F.concat(source, F.lit(f":{k}")).alias("key"), F.substring(F.get_json_object(metadata, f"$.{k}"), 1, 200).alias("value")) for k in fields])
    return F.map_from_entries(F.filter(pairs, lambda p: p["key"].isNotNull() & p["value"].isNotNull() & (p["value"] != "")))


def content_key(*columns: Column) -> Column:
    """SHA-256 of columns as JSON, the same for equal values in equal order."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def without_keys(metadata: Column, volatile: list[str]) -> Column:
    """A JSON object's entries as a map without volatile fields, sorted by name: equal for metadata that differ in those alone."""
    entries = F.map_entries(F.from_json(metadata, "map<string,string>"))
    return F.map_from_entries(F.sort_array(F.filter(entries, lambda e: ~F.array_contains(F.array(*map(F.lit, volatile)), e["key"]))))


def when_said(*times: Column) -> Column:
    """The first time that can be read, as a UTC timestamp; null if none can.  Seconds or milliseconds since 1970 are taken as such."""
    out = []
    for t in times:
        number = F.expr("null") if t is None else F.when(F.rlike(t, F.lit("^[0-9]{10}$")), F.timestamp_seconds(t.cast("long"))).when(F.rlike(t, F.lit("^[0-9]{13}$")), F.timestamp_millis(t.cast("long")))
        out += [number, F.try_to_timestamp(t)]
    return F.coalesce(*out)


def horizon_bucket(start: Column, end: Column) -> Column:
    """Days between two times in four steps."""
    hours = F.greatest(F.lit(0.0), (F.unix_micros(end) - F.unix_micros(start)) / 3.6e9)
    return F.when(hours <= 24, "0-1d").when(hours <= 72, "1-3d").when(hours <= 168, "3-7d").otherwise("7-30d")


def context_score(text: Column, terms: list[str]) -> Column:
    """Share of terms that a text contains."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(t.lower())).cast("int") for t in terms), F.lit(0)) / max(1, len(terms))
