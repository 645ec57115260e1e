"""What a claim can be checked by: values that its evidence holds, and the lookup that they make possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.items import vulnerability_ids

# Sources that speak with authority, documents and characters that are looked at, values of a claim, how sure each sort of value is.
AUTHORITIES = ["usgs_earthquakes", "nws_alerts", "cisa_known_exploited_vulnerabilities", "github_security_advisories", "world_bank_indicators", "fred_economic_indicators", "nasa_eonet", "gdacs", "who_outbreaks", "reliefweb", "nasa_firms_wildfires", "noaa_space_weather_alerts"]
DOCUMENTS, CHARACTERS, VALUES = 8, 30_000, 24
SURE = {"authority_record": 0.99, "geo_time_window": 0.94, "metadata": 0.98, "security_identifier": 0.99, "named_entity": 0.85}
METADATA = {"country_code": "iso3166", "indicator_code": "world-bank", "series_id": "fred", "message_id": "noaa-swpc", "year": "gregorian"}
# Whose record answers which lookup, by adapter, and kilometres of a lookup by place.
RECORDS = {"eonet": ("nasa_eonet", "event_id"), "gdacs": ("gdacs", "event_id"), "who-outbreaks": ("who_outbreaks", "notice_id"), "reliefweb": ("reliefweb", "report_id"), "noaa-swpc": ("noaa_space_weather_alerts", "message_id")}
QUAKE_KM, FIRE_KM = 100, 25


def _text(*columns: str) -> Column:
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])


def _field(text: str, key: str) -> Column:
    """A field of a JSON text; texts that don't hold its name, and no escape that may stand for it, aren't parsed."""
    return F.when(F.contains(text, F.lit(key)) | F.contains(text, F.lit("\\")), F.get_json_object(text, f"$.{key}"))


def _coordinate(c: str) -> Column:
    return F.when(F.col(c).between(-180, 180), F.col(c))


def groundings(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Values that claims' evidence states: claim, type, namespace, value, confidence, document, method and place (from 0, surest first).

    claims: claim, object, speaker, verifiability, predicate.  evidence: claim,
    document (string), source, external_id, title, summary, lat, lon,
    published_at and retrieved_at (timestamp), metadata (JSON).  Of a claim's
    evidence the eight documents that were read last count (of one time, the
    greatest name).  Authorities' own identifiers, coordinates with a time, codes
    of the metadata, CVE and GHSA numbers in the texts (of the claim and those
    documents, 30000 characters) and a speaker that the texts name are values; of
    equal ones of one document one stays, and of all the 24 surest.

    Claims that can't be checked and bookkeeping have none, nor have claims with
    nothing of the kind; broken metadata hold nothing; an identifier with other
    characters than those of an address, or over 300 of them, is none.
    """
    open_ = claims.where("claim is not null and verifiability = 'checkable' and predicate not in ('event.reported', 'event.category')").groupBy("claim").agg(F.max(F.struct("object", "speaker")).alias("_c")).select("claim", "_c.*")
    # The rank is cut before a shuffle too, so a claim with very many documents sends eight from each task.
    order = Window.partitionBy("claim").orderBy(F.col("retrieved_at").desc_nulls_last(), F.col("document").desc())
    last = evidence.where("claim is not null and document is not null").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= DOCUMENTS)
    # What is named more than once below is a column first: worked out once, in compiled code.
    lat, lon, seen = _coordinate("lat"), _coordinate("lon"), F.coalesce("published_at", "retrieved_at")
    where = F.to_json(F.struct(lat.alias("latitude"), lon.alias("longitude"), F.date_format(seen, "yyyy-MM-dd'T'HH:mm:ss").alias("observed_at")))
    facts = open_.join(last.hint("merge"), "claim", "left").select(
        "claim", "object", "speaker", "_n", "document", F.col("source").alias("_source"), F.substring(_text("title", "summary"), 1, CHARACTERS).alias("_said"), F.trim("external_id").alias("_name"),
        F.when(lat.isNotNull() & lon.isNotNull() & seen.isNotNull(), where).alias("_where"), *[_field("metadata", k).alias(f"_{k}") for k in METADATA])
    entry = lambda kind, space, v, sure, method, rank, document: F.struct((-F.lit(SURE[sure])).alias("_minus"), rank.alias("_rank"), F.lit(kind).alias("type"), space.alias("namespace"), v.alias("value"), document.alias("document"), F.lit(method).alias("method"))
    value = lambda kind, space, v, sure, method, when, rank=F.col("_n") - 1, document=F.col("document"): F.when(when & (v != ""), entry(kind, space, v, sure, method, rank, document))
    told = [
        value("authority_record", F.col("_source"), F.col("_name"), "authority_record", "source_metadata", F.col("_source").isin(AUTHORITIES) & (F.length("_name") <= 300) & F.col("_name").rlike("^[A-Za-z0-9:/?&=._-]+$")),
        value("geo_time_window", F.lit("wgs84"), F.col("_where"), "geo_time_window", "document_coordinates", F.lit(True))]
    told += [value(k, F.lit(space), F.col(f"_{k}"), "metadata", "source_metadata", F.lit(True)) for k, space in METADATA.items()]
    each = facts.select("claim", "object", "speaker", F.when(F.col("document").isNotNull(), F.struct("_n", "document", "_said", F.array(*told).alias("told"))).alias("_d"))
    # Eight documents of a claim at most, so a claim is one row from here on.
    one = each.groupBy("claim").agg(F.first("object").alias("object"), F.trim(F.first("speaker")).alias("_speaker"), F.sort_array(F.collect_list("_d")).alias("_d"))
    one = one.withColumn("_t", F.substring(F.concat_ws(" ", F.coalesce("object", F.lit("")), F.array_join("_d._said", " ")), 1, CHARACTERS))
    one = one.select("claim", "_t", "_speaker", F.col("_d.document").alias("_names"), F.sort_array(F.filter(F.flatten("_d.told"), lambda v: v.isNotNull())).alias("_told"), vulnerability_ids(F.col("_t")).alias("_codes"))
    # Only a document that a claim names twice says a thing twice; its first place stays.
    same = lambda a, b: (a["type"] == b["type"]) & (a["namespace"] == b["namespace"]) & (a["value"] == b["value"]) & (a["document"] == b["document"])
    once = F.filter("_told", lambda v, i: ~F.exists(F.slice("_told", F.lit(1), i), lambda w: same(v, w)))
    stated = F.when(F.size(F.array_distinct("_names")) == F.size("_names"), F.col("_told")).otherwise(once)
    none = F.lit(None).cast("string")
    codes = F.transform("_codes", lambda v: entry("security_identifier", F.when(v.startswith("CVE"), "cve").otherwise("ghsa"), v, "security_identifier", "exact_pattern", F.lit(DOCUMENTS), none))
    named = value("named_entity", F.lit("speaker"), F.col("_speaker"), "named_entity", "claim_attribution", F.contains(F.lower("_t"), F.lower("_speaker")), F.lit(DOCUMENTS), none)
    named = F.filter(F.array(named), lambda v: v.isNotNull())
    best = one.select("claim", F.posexplode(F.slice(F.sort_array(F.concat(stated, codes, named)), 1, VALUES)).alias("place", "_v"))
    return best.select("claim", "_v.type", "_v.namespace", "_v.value", (-F.col("_v._minus")).alias("confidence"), "_v.document", "_v.method", "place")


def _whole(c: Column, form: str) -> Column:
    return F.when(c.rlike(f"^(?:{form})$"), c)


def targets(tasks: DataFrame, claims: DataFrame, evidence: DataFrame, grounded: DataFrame) -> DataFrame:
    """The lookup of each task: task, claim, adapter, identifier_type, identifier, query (JSON) and ready.

    tasks: task, claim, adapter.  claims and evidence as in groundings (all
    evidence counts here, the last read first), grounded its rows.  An adapter's
    own identifier comes before groundings, and these before a place and time.
    What has none is not ready and has empty text for all three; tasks of
    unknown claims drop out.  Everything that a claim's evidence offers comes
    from aggregates, so no claim's documents are collected.
    """
    # What is named more than once below is a column first: worked out once, in compiled code.
    text = _text("title", "summary")
    told = evidence.where("claim is not null and document is not null").select(
        "claim", "document", "source", "lat", "lon", F.coalesce("external_id", F.lit("")).alias("_id"), F.coalesce(F.unix_micros(F.col("retrieved_at").cast("timestamp")), F.lit(-(2**62))).alias("_at"), F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss").alias("_published"),
        F.regexp_extract(text, r"(?i)\bCVE-\d{4}-\d{4,}\b", 0).alias("_cve"), F.regexp_extract(text, r"(?i)\bGHSA(?:-[23456789cfghjmpqrvwx]{4}){3}\b", 0).alias("_ghsa"),
        *[F.coalesce(F.upper(_field("metadata", k)), F.lit("")).alias(f"_{k}") for k in ("country_code", "indicator_code", "series_id")], *[F.coalesce(_field("metadata", k), F.lit("")).alias(f"_{k}") for k in ("year", "observation_date")])
    first = lambda v, when, name: F.max(F.when(when, F.struct("_at", "document", v.alias("v")))).alias(name)
    bank = (F.col("_country_code") != "") & (F.col("_indicator_code") != "") & F.col("_year").rlike(r"^\d{4}$")
    offers = told.groupBy("claim").agg(
        first(F.trim("_id"), F.col("source") == "usgs_earthquakes", "quake"), first(F.col("_id"), F.col("source") == "nws_alerts", "alert"),
        first(F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.col("_published").alias("published_at"), F.lit(QUAKE_KM).alias("radius_km")), F.col("lat").isNotNull() & F.col("lon").isNotNull(), "located"),
        first(F.col("_cve"), F.col("_cve") != "", "cve"), first(F.col("_ghsa"), F.col("_ghsa") != "", "ghsa"),
        first(F.struct(F.col("_country_code").alias("country"), F.col("_indicator_code").alias("indicator"), F.col("_year").alias("year")), bank, "bank"),
        first(F.struct(F.col("_series_id").alias("series_id"), F.col("_observation_date").alias("date")), F.col("_series_id").rlike("^[A-Z0-9._-]{1,80}$"), "series"))
    offers = offers.select("claim", *[(F.upper(F.col(f"{c}.v")) if c in ("cve", "ghsa") else F.col(f"{c}.v")).alias(c) for c in offers.columns[1:]])
    record = lambda when, name: F.min(F.when(when, F.struct("place", "value"))).alias(name)
    spaces = ["usgs_earthquakes", *[space for space, _ in RECORDS.values()]]
    held = grounded.where(F.col("type").isin("authority_record", "geo_time_window")).groupBy("claim").agg(
        *[record((F.col("type") == "authority_record") & (F.col("namespace") == space), f"_{space}") for space in spaces], record(F.col("type") == "geo_time_window", "_window"))
    held = held.select("claim", F.col("_usgs_earthquakes.value").alias("_usgs"), *[F.col(f"{c}.value").alias(c) for c in held.columns[2:]])
    own = claims.where("claim is not null").groupBy("claim").agg(F.max("object").alias("object"))
    rows = tasks.join(own, "claim").join(offers, "claim", "left").join(held, "claim", "left")
    mine = lambda form, other: F.coalesce(F.nullif(F.upper(F.regexp_extract(F.coalesce("object", F.lit("")), form, 0)), F.lit("")), F.col(other))
    cve, ghsa = mine(r"(?i)\bCVE-\d{4}-\d{4,}\b", "cve"), mine(r"(?i)\bGHSA(?:-[23456789cfghjmpqrvwx]{4}){3}\b", "ghsa")
    alert = _whole(F.when(F.col("alert").startswith("http"), F.regexp_extract("alert", r"([^/]*)/*(?:[?#].*)?$", 1)).otherwise(F.col("alert")), "[A-Za-z0-9._-]{3,200}")
    is_ = lambda *a: F.col("adapter").isin(*a)

    def found(when: Column, kind: str, ident: Column, query: Column, there: Column | None = None) -> Column:
        return F.when(when & (ident if there is None else there).isNotNull(), F.struct(F.lit(kind).alias("t"), ident.alias("i"), query.alias("q")))

    keyed = lambda k, v: F.to_json(F.struct(v.alias(k)))
    quake = F.coalesce(_whole(F.col("quake"), "[A-Za-z0-9._-]{3,80}"), F.col("_usgs"))
    fire = F.from_json("_window", "latitude double, longitude double, observed_at string").withField("radius_km", F.lit(FIRE_KM))
    choice = F.coalesce(
        found(is_("usgs"), "usgs_event_id", quake, keyed("event_id", quake)), found(is_("usgs"), "geo_time_window", F.lit(""), F.to_json("located"), F.col("located")),
        found(is_("nws-alerts"), "nws_alert_id", alert, keyed("alert_id", alert)), found(is_("cisa-kev", "github-advisories"), "cve", cve, keyed("cve", cve)), found(is_("github-advisories"), "ghsa", ghsa, keyed("ghsa", ghsa)),
        found(is_("world-bank"), "world_bank_observation", F.concat_ws(":", "bank.country", "bank.indicator", "bank.year"), F.to_json("bank"), F.col("bank")),
        found(is_("fred"), "fred_observation", F.concat_ws(":", "series.series_id", "series.date"), F.to_json("series"), F.col("series")),
        *[found(is_(a), key, F.col(f"_{space}"), keyed(key, F.col(f"_{space}"))) for a, (space, key) in RECORDS.items()],
        found(is_("firms"), "geo_time_window", F.lit(""), F.to_json(fire), F.col("_window")))
    empty = lambda c: F.coalesce(c, F.lit(""))
    return rows.withColumn("_c", choice).select("task", "claim", "adapter", empty(F.col("_c.t")).alias("identifier_type"), empty(F.col("_c.i")).alias("identifier"), empty(F.col("_c.q")).alias("query"), F.col("_c").isNotNull().alias("ready"))
