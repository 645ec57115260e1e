"""Landed feed payloads as item rows.

Every function takes a DataFrame with a string column payload (one response a
row) and returns ITEM columns.  Rows without the identity that a feed demands
are left out; nothing is capped.  metadata is JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ITEM = ["source", "external_id", "title", "url", "summary", "published_at", "category", "latitude", "longitude", "metadata", "status"]

# Categories of alerts and of mapping activations by their terms, and of disaster alerts by their codes.
ALERT_TERMS = [(["tornado", "hurricane", "storm", "cyclone"], "severe-storms"), (["flood"], "floods"), (["fire", "red flag"], "wildfires")]
MAPPING_TERMS = [(["wildfire", "fire"], "wildfire"), (["earthquake"], "earthquake"), (["flood"], "flood"), (["storm", "cyclone"], "storm"), (["volcano"], "volcano"), (["drought"], "drought")]
DISASTERS = {"EQ": "earthquake", "TC": "severe-storms", "FL": "floods", "WF": "wildfires", "VO": "volcanoes", "DR": "drought"}


def parsed(landed: DataFrame, schema: str, rows: str) -> DataFrame:
    """One row r for each element of an array of the payload."""
    return landed.select(F.from_json("payload", schema).alias("p")).select("p", F.explode(f"p.{rows}").alias("r"))


def listed(landed: DataFrame, element: str, rows: str) -> DataFrame:
    """The same for payloads that are an array themselves or hold one under a name."""
    plain = F.when(F.rlike(F.ltrim("payload"), F.lit(r"^\[")), F.from_json("payload", f"array<{element}>"))
    under = F.from_json("payload", f"struct<{rows}: array<{element}>>")[rows]
    return landed.select(F.explode(F.coalesce(plain, under)).alias("r"))


def text(c: str | Column) -> Column:
    """A trimmed string; null when empty."""
    return F.nullif(F.trim(F.col(c).cast("string") if isinstance(c, str) else c.cast("string")), F.lit(""))


def first(*cs: str | Column) -> Column:
    return F.coalesce(*[text(c) for c in cs])


def item(df: DataFrame, source: str, **columns: Column) -> DataFrame:
    """ITEM columns; absent ones take their defaults.  Rows need external_id and url."""
    kinds = {"latitude": "double", "longitude": "double"}
    given = {"source": F.lit(source), "summary": F.lit(""), "status": F.lit("active"), "metadata": F.lit("{}")} | columns
    out = df.select(*[F.coalesce(given[c], F.lit("")).alias(c) if c in ("summary", "title") and c in given else given.get(c, F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in ITEM])
    return out.where("external_id is not null and url is not null")


def meta(**columns: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()]))


def bounded(c: Column, most: int) -> Column:
    x = c.cast("double")
    return F.when(x.between(-most, most), x)


def by_term(value: Column, terms: list[tuple[list[str], str]], other: str) -> Column:
    """The category of the first list of which the lower-case value contains a term."""
    out, low = F.lit(other), F.lower(F.coalesce(value, F.lit("")))
    for words, name in reversed(terms):
        out = F.when(F.rlike(low, F.lit("|".join(words))), name).otherwise(out)
    return out


def earthquakes(landed: DataFrame) -> DataFrame:
    """A GeoJSON collection of quakes."""
    p = "r.properties"
    rows = parsed(landed, "features array<struct<id string, properties struct<mag double, place string, time string, title string, url string, detail string, code string, alert string, tsunami int, status string, sig int>, geometry struct<type string, coordinates array<double>>>>", "features")
    place = F.coalesce(text(f"{p}.place"), F.lit("unknown location"))
    at = lambda i: F.get("r.geometry.coordinates", F.lit(i))
    return item(
        rows, "usgs", external_id=first("r.id", f"{p}.code"), title=F.coalesce(text(f"{p}.title"), F.concat(F.lit("Earthquake near "), place)), url=first(f"{p}.url", f"{p}.detail"), summary=F.concat(F.lit("Magnitude "), F.coalesce(F.col(f"{p}.mag").cast("string"), F.lit("unknown")), F.lit(" earthquake near "), place, F.lit(".")),
        published_at=F.col(f"{p}.time"), category=F.lit("earthquake"), latitude=at(1), longitude=at(0), metadata=meta(magnitude=F.col(f"{p}.mag"), place=place, tsunami=F.coalesce(F.col(f"{p}.tsunami") != 0, F.lit(False)), alert=F.col(f"{p}.alert"), status=F.col(f"{p}.status"), depth_km=at(2), geometry=F.col("r.geometry")),
    )


def natural_events(landed: DataFrame) -> DataFrame:
    """Open natural events; the last of an event's places counts."""
    rows = parsed(landed, "events array<struct<id string, title string, description string, link string, closed string, categories array<struct<id string, title string>>, geometry array<struct<date string, type string, coordinates array<double>>>>>", "events")
    rows = rows.withColumn("g", F.try_element_at("r.geometry", F.lit(-1)))
    names = F.array_compact(F.transform("r.categories", lambda c: F.coalesce(c["title"], c["id"])))
    terms = [(["wildfire"], "wildfire"), (["flood"], "flood"), (["storm"], "storm"), (["volcano"], "volcano"), (["earthquake"], "earthquake"), (["drought"], "drought")]
    title = F.coalesce(text("r.title"), F.lit("Natural event"))
    return item(rows, "eonet", external_id=text("r.id"), title=title, url=F.coalesce(text("r.link"), F.concat(F.lit("event:"), "r.id")), summary=F.coalesce(text("r.description"), title), published_at=first("g.date", "r.closed"), category=by_term(F.array_join(names, " "), terms, "natural-event"), latitude=F.get("g.coordinates", F.lit(1)), longitude=F.get("g.coordinates", F.lit(0)), metadata=meta(categories=names, closed_at=F.col("r.closed"), geometry_count=F.size("r.geometry"), geometry=F.col("g")))


def fires(rows: DataFrame, satellite: str) -> DataFrame:
    """Fire detections from CSV rows (strings)."""
    lat, lon, day, clock = F.expr("try_cast(latitude as double)"), F.expr("try_cast(longitude as double)"), text("acq_date"), F.lpad(F.trim(F.coalesce("acq_time", F.lit(""))), 4, "0")
    sure = F.coalesce(text("confidence"), F.lit("unknown"))
    kept = rows.where(lat.isNotNull() & lon.isNotNull() & day.isNotNull())
    return item(kept, "firms", external_id=F.concat_ws(":", F.lit("firms"), F.lit(satellite), day, clock, "latitude", "longitude"), title=F.concat(F.lit("Fire seen by satellite, confidence "), sure), url=F.lit("feed:firms"), published_at=F.concat(day, F.lit("T"), F.substring(clock, 1, 2), F.lit(":"), F.substring(clock, 3, 2), F.lit(":00Z")), category=F.lit("wildfire"), latitude=lat, longitude=lon, metadata=meta(confidence=F.col("confidence"), frp=F.expr("try_cast(frp as double)"), brightness=F.expr("try_cast(brightness as double)") if "brightness" in rows.columns else F.lit(None).cast("double"), daynight=F.col("daynight")))


def weather_alerts(landed: DataFrame) -> DataFrame:
    """Official weather alerts."""
    p = "r.properties"
    rows = parsed(landed, "features array<struct<id string, properties struct<id string, event string, headline string, description string, instruction string, sent string, effective string, severity string, certainty string, urgency string, areaDesc string, onset string, expires string, senderName string>>>", "features")
    summary = F.concat_ws("\n\nInstructions: ", text(f"{p}.description"), text(f"{p}.instruction"))
    terms = ALERT_TERMS
    ident = first("r.id", f"{p}.id")
    return item(rows, "nws", external_id=ident, title=F.coalesce(first(f"{p}.headline", f"{p}.event"), F.lit("Alert on weather")), url=ident, summary=summary, published_at=first(f"{p}.sent", f"{p}.effective"), category=by_term(F.col(f"{p}.event"), terms, "weather-alert"), metadata=meta(**{k: F.col(f"{p}.{k}") for k in ("event", "severity", "certainty", "urgency", "areaDesc", "onset", "expires", "senderName")}))


def exploited_vulnerabilities(landed: DataFrame) -> DataFrame:
    """A catalogue of exploited vulnerabilities, one row for each."""
    rows = parsed(landed, "vulnerabilities array<struct<cveID string, vendorProject string, product string, shortDescription string, requiredAction string, dateAdded string, dueDate string>>", "vulnerabilities")
    vendor, product = F.coalesce("r.vendorProject", F.lit("Unknown vendor")), F.coalesce("r.product", F.lit("unknown product"))
    return item(rows, "cisa", external_id=text("r.cveID"), title=F.concat(text("r.cveID"), F.lit(": "), vendor, F.lit(" "), product), url=F.concat(F.lit("cve:"), text("r.cveID")), summary=F.concat_ws("\n\nRequired action: ", text("r.shortDescription"), text("r.requiredAction")), published_at=F.col("r.dateAdded"), category=F.lit("known-exploited-vulnerability"), metadata=meta(cve=text("r.cveID"), vendor=vendor, product=product, due_date=F.col("r.dueDate")))


def advisories(landed: DataFrame) -> DataFrame:
    """Software advisories; those without a URL are left out."""
    rows = listed(landed, "struct<ghsa_id: string, cve_id: string, html_url: string, summary: string, description: string, published_at: string, severity: string, withdrawn_at: string>", "advisories")
    ident = first("r.ghsa_id", "r.cve_id")
    return item(rows, "advisories", external_id=ident, title=F.coalesce(text("r.summary"), ident), url=text("r.html_url"), summary=F.col("r.description"), published_at=F.col("r.published_at"), category=F.lit("software-vulnerability"), metadata=meta(ghsa_id=F.col("r.ghsa_id"), cve_id=F.col("r.cve_id"), severity=F.col("r.severity"), withdrawn_at=F.col("r.withdrawn_at")))


def space_weather(landed: DataFrame) -> DataFrame:
    """Space weather alerts, as an array or under alerts."""
    rows = listed(landed, "struct<product_id: string, id: string, product_name: string, message: string, text: string, issue_datetime: string, issueDate: string>", "alerts")
    ident = first("r.product_id", "r.id")
    return item(rows, "swpc", external_id=ident, title=F.coalesce("r.product_name", F.lit("Alert on solar activity")), url=F.lit("feed:swpc"), summary=F.coalesce("r.message", "r.text"), published_at=F.coalesce("r.issue_datetime", "r.issueDate"), category=F.lit("space-weather"), metadata=meta(message_id=ident))


def mapping_activations(landed: DataFrame) -> DataFrame:
    """Satellite mapping activations; the centroid is GeoJSON or WKT."""
    rows = parsed(landed, "results array<struct<code string, activationCode string, name string, title string, category string, eventType string, centroid string, countries array<string>, eventTime string, activationTime string, lastUpdate string, closed boolean>>", "results")
    wkt = lambda i: F.regexp_extract("r.centroid", r"(?i)POINT\s*\(\s*([-+\d.]+)\s+([-+\d.]+)\s*\)", i)
    at = lambda i, k: F.coalesce(F.get_json_object("r.centroid", f"$.coordinates[{i}]"), F.nullif(wkt(k), F.lit("")))
    terms = MAPPING_TERMS
    code = first("r.code", "r.activationCode")
    return item(rows, "copernicus", external_id=code, title=F.coalesce(first("r.name", "r.title"), F.concat(F.lit("Activation "), code)), url=F.concat(F.lit("activation:"), code), published_at=first("r.eventTime", "r.activationTime"), category=by_term(F.coalesce("r.category", "r.eventType"), terms, "emergency-mapping"), latitude=bounded(at(1, 2), 90), longitude=bounded(at(0, 1), 180), status=F.when(F.col("r.closed"), "closed").otherwise("active"), metadata=meta(countries=F.col("r.countries"), last_update=F.col("r.lastUpdate"), closed=F.coalesce("r.closed", F.lit(False))))


def market_prices(landed: DataFrame) -> DataFrame:
    """Prediction markets: outcomes with their prices as percent.  Never facts."""
    rows = listed(landed, "struct<id: string, conditionId: string, question: string, slug: string, outcomes: string, outcomePrices: string, createdAt: string, volume: string>", "markets")
    pairs = F.arrays_zip(F.from_json("r.outcomes", "array<string>").alias("o"), F.from_json("r.outcomePrices", "array<string>").alias("p"))
    odds = F.filter(F.transform(pairs, lambda x: F.struct(x["o"].alias("outcome"), F.round(F.expr("0") + F.try_to_number(x["p"], F.lit("9.999999")).cast("double") * 100, 1).alias("percent"))), lambda x: x["outcome"].isNotNull() & x["percent"].isNotNull())
    return item(rows, "markets", external_id=first("r.id", "r.conditionId"), title=text("r.question"), url=F.concat(F.lit("market:"), F.coalesce("r.slug", F.lit(""))), summary=F.array_join(F.transform(odds, lambda x: F.concat(x["outcome"], F.lit(" "), x["percent"].cast("string"), F.lit("%"))), ", "), published_at=F.col("r.createdAt"), category=F.lit("prediction-market"), metadata=meta(factual_evidence=F.lit(False), outcomes=odds)).where("title <> ''")


def news_search(landed: DataFrame) -> DataFrame:
    """Articles found by several queries (column query): one for each URL, by the first query in order."""
    rows = landed.select("query", F.explode(F.from_json("payload", "articles array<struct<url string, title string, seendate string, domain string, language string>>")["articles"]).alias("r")).where(text("r.url").isNotNull())
    one = rows.groupBy(text("r.url").alias("u")).agg(F.min_by(F.struct("r", "query"), F.struct("query", "r.title")).alias("x")).select("u", "x.*")
    at = F.regexp_replace("r.seendate", r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z?$", "$1-$2-$3T$4:$5:$6Z")
    title = F.coalesce(text("r.title"), F.lit("Report found by search"))
    return item(one, "gdelt", external_id=F.sha2("u", 256), title=title, url=F.col("u"), summary=title, published_at=at, category=F.lit("world-news"), metadata=meta(domain=F.col("r.domain"), language=F.col("r.language"), query=F.col("query")))


def series_latest(observations: DataFrame) -> DataFrame:
    """Economic series (series, date, value as strings): the newest usable observation with its change from the one before."""
    usable = observations.withColumn("v", F.expr("try_cast(value as double)")).where("v is not null")
    w = Window.partitionBy("series").orderBy("date")
    ranked = usable.withColumn("previous", F.lag("v").over(w))
    last = ranked.groupBy("series").agg(F.max_by(F.struct("date", "v", "previous"), "date").alias("l")).select("series", "l.*")
    return item(last, "fred", external_id=F.concat_ws(":", "series", "date"), title=F.concat(F.col("series"), F.lit(" ("), F.col("date"), F.lit(")")), url=F.concat(F.lit("series:"), "series"), published_at=F.concat(F.col("date"), F.lit("T00:00:00Z")), category=F.lit("economic-indicator"), metadata=meta(value=F.col("v"), previous_value=F.col("previous"), change=F.col("v") - F.col("previous")))


def indicator_latest(rows: DataFrame) -> DataFrame:
    """Country indicators (country, indicator, year, value): the newest value that isn't null."""
    usable = rows.where("value is not null and year is not null")
    last = usable.groupBy("country", "indicator").agg(F.max_by(F.struct("year", "value"), "year").alias("l")).select("country", "indicator", "l.*")
    return item(last, "world_bank", external_id=F.concat_ws(":", "country", "indicator", "year"), title=F.concat_ws(" ", "country", "indicator", "year"), url=F.concat_ws(":", F.lit("indicator"), "indicator", "country"), published_at=F.concat(F.col("year"), F.lit("-12-31T00:00:00Z")), category=F.lit("economic-indicator"), metadata=meta(value=F.col("value"), year=F.col("year")))


def nodes(landed: DataFrame, fields: list[str], path: str) -> DataFrame:
    """XML elements at a path, one row each: their children by local name as strings (the text of the first of each name)."""
    plain = F.regexp_replace(F.regexp_replace("payload", "^\\uFEFF", ""), r"<(/?)[A-Za-z0-9_]+:", "<$1")
    tag = path.rsplit(".", 1)[-1]
    whole = F.regexp_extract_all(plain, F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>.*?</{tag}>"), F.lit(0))
    each = landed.withColumn("_x", F.explode(whole)).drop("payload")
    inner = [F.regexp_extract("_x", rf"(?s)<{f}(?:\s[^>]*)?>(.*?)</{f}>", 1).alias(f) for f in fields]
    return each.select(*[c for c in each.columns if c != "_x"], "_x", *inner)


def decoded(c: Column) -> Column:
    """Common character references decoded once."""
    for name, value in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("nbsp", " "), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(value))
    return c


def unmarked(c: Column) -> Column:
    """Text of an XML field that holds HTML: sections are taken as they are, else references decoded; then tags go, references are decoded, white space becomes single blanks."""
    section = r"(?s)<!\[CDATA\[(.*?)\]\]>"
    inner = F.when(F.rlike(c, F.lit(section)), F.regexp_replace(c, section, "$1")).otherwise(decoded(c))
    return F.trim(F.regexp_replace(decoded(F.regexp_replace(inner, "<[^>]+>", " ")), r"\s+", " "))


def mail_time(c: Column) -> Column:
    """A feed's time as ISO 8601 in UTC: dates of mail headers, or what Spark reads as a timestamp; null if neither."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", ""), r"\s(?:GMT|UTC?|Z)$", " +0000")
    at = F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c))
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def disaster_alerts(landed: DataFrame) -> DataFrame:
    """Disaster alerts from RSS; the point is latitude and longitude in one field."""
    rows = nodes(landed, ["title", "link", "guid", "description", "pubDate", "point", "alertlevel", "eventtype", "country", "severity"], "channel.item")
    at = lambda i: F.get(F.split(F.trim("point"), r"\s+"), F.lit(i)).try_cast("double")
    both = at(0).isNotNull() & at(1).isNotNull()
    title = F.coalesce(text(unmarked(F.col("title"))), F.lit("Disaster alert"))
    ident = F.coalesce(text("guid"), F.sha2(F.concat_ws("\n", F.trim("link"), title), 256))
    category = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in DISASTERS.items() for x in p]), F.upper(F.trim("eventtype"))), F.lit("disaster-alert"))
    return item(rows, "gdacs", external_id=ident, title=title, url=text("link"), summary=unmarked(F.col("description")), published_at=mail_time(F.col("pubDate")), category=category, latitude=F.when(both, at(0)), longitude=F.when(both, at(1)), metadata=meta(alert_level=text("alertlevel"), event_type=text("eventtype"), country=text("country"), severity=text("severity")))


def syndicated(landed: DataFrame, whole: int = 500) -> DataFrame:
    """News items of RSS and Atom feeds (column publisher); content that comes along counts as the article from so many characters on."""
    fields = ["title", "link", "guid", "id", "description", "summary", "content", "encoded", "pubDate", "published", "updated", "creator", "author"]
    rows = nodes(landed, fields, "channel.item").union(nodes(landed, fields, "feed.entry"))
    href = F.coalesce(F.nullif(F.regexp_extract("_x", r"""<link\s[^>]*rel=["']alternate["'][^>]*href=["']([^"']*)""", 1), F.lit("")), F.nullif(F.regexp_extract("_x", r"""<link\s[^>]*href=["']([^"']*)""", 1), F.lit("")))
    url, title = F.coalesce(text(unmarked(F.col("link"))), href), F.coalesce(text(unmarked(F.col("title"))), F.concat(F.col("publisher"), F.lit(": untitled")))
    content = unmarked(F.coalesce(text("encoded"), text("content"), F.lit("")))
    summary = F.coalesce(text(unmarked(F.coalesce(text("description"), text("summary"), F.lit("")))), content)
    ident = F.coalesce(text("guid"), text("id"), F.sha2(F.concat_ws("\n", url, title), 256))
    scope = F.when(F.length(content) >= whole, "full").otherwise("metadata")
    kinds = F.transform(F.regexp_extract_all("_x", F.lit(r"(?s)<category(?:\s[^>]*)?>(.*?)</category>"), F.lit(1)), unmarked)
    return item(rows, "news", external_id=ident, title=title, url=url, summary=summary, published_at=mail_time(F.coalesce(text("pubDate"), text("published"), text("updated"))), category=F.lit("traditional-news"), metadata=meta(publisher=F.col("publisher"), domain=F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#:]+)", 1)), author=F.coalesce(text("creator"), text("author")), categories=kinds, content_scope=scope))


def outbreak_news(landed: DataFrame, site: str) -> DataFrame:
    """Outbreak reports, under value or items; relative addresses belong to site."""
    element = "struct<Id: string, Title: string, UrlName: string, ItemDefaultUrl: string, Url: string, Summary: string, Overview: string, PublicationDateAndTime: string, PublicationType: string>"
    plain = F.from_json("payload", f"struct<value: array<{element}>, items: array<{element}>>", {"caseSensitive": "true"})
    rows = landed.select(F.explode(F.coalesce(plain["value"], plain["items"])).alias("r"))
    at = first("r.ItemDefaultUrl", "r.Url")
    url = F.when(F.rlike(at, F.lit("^https?://")), at).otherwise(F.concat(F.lit(site.rstrip("/")), F.when(F.startswith(at, F.lit("/")), at).otherwise(F.concat(F.lit("/"), at))))
    return item(rows, "who", external_id=first("r.Id", "r.UrlName", at, "r.Title"), title=F.coalesce(text("r.Title"), F.lit("Report of an outbreak")), url=F.coalesce(url, F.lit(site)), summary=unmarked(F.coalesce("r.Summary", "r.Overview", F.lit(""))), published_at=F.col("r.PublicationDateAndTime"), category=F.lit("disease-outbreak"), metadata=meta(publication_type=F.col("r.PublicationType")))


def relief_reports(landed: DataFrame, site: str) -> DataFrame:
    """Humanitarian reports: names of countries, disasters and sources as lists."""
    named = "array<struct<name string>>"
    rows = parsed(landed, f"data array<struct<id string, fields struct<title string, url string, url_alias string, body string, description string, date struct<original string, created string>, country {named}, disaster {named}, source {named}>>>", "data")
    f = "r.fields"
    at = first(f"{f}.url", f"{f}.url_alias")
    url = F.when(F.startswith(at, F.lit("/")), F.concat(F.lit(site.rstrip("/")), at)).otherwise(at)
    names = lambda c: F.array_compact(F.transform(F.coalesce(F.col(f"{f}.{c}.name"), F.array().cast("array<string>")), lambda x: x))
    return item(rows, "reliefweb", external_id=text("r.id"), title=F.coalesce(text(f"{f}.title"), F.lit("Humanitarian report")), url=url, summary=unmarked(F.coalesce(f"{f}.body", f"{f}.description", F.lit(""))), published_at=first(f"{f}.date.original", f"{f}.date.created"), category=F.lit("humanitarian"), metadata=meta(countries=names("country"), disasters=names("disaster"), reporting_sources=names("source")))


def conflict_events(landed: DataFrame) -> DataFrame:
    """Curated conflict events; the place is the first of location, region and country."""
    fields = "event_id_cnty event_date event_type sub_event_type location admin1 country latitude longitude notes fatalities source actor1 actor2".split()
    rows = parsed(landed, f"data array<struct<{', '.join(f'{c} string' for c in fields)}>>", "data")
    at = lambda c, most: bounded(F.col(f"r.{c}").try_cast("double"), most)
    where = F.coalesce(first("r.location", "r.admin1", "r.country"), F.lit("an unnamed place"))
    title = F.concat(F.coalesce(first("r.sub_event_type", "r.event_type"), F.lit("Conflict")), F.lit(" in "), where)
    sources = F.filter(F.transform(F.split(F.coalesce("r.source", F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")
    return item(rows, "acled", external_id=text("r.event_id_cnty"), title=title, url=F.concat(F.lit("conflict:"), text("r.event_id_cnty")), summary=F.coalesce(text("r.notes"), F.lit("")), published_at=F.concat(text("r.event_date"), F.lit("T00:00:00Z")), category=F.lit("conflict"), latitude=at("latitude", 90), longitude=at("longitude", 180), metadata=meta(event_type=F.col("r.event_type"), sub_event_type=F.col("r.sub_event_type"), actors=F.array_compact(F.array(text("r.actor1"), text("r.actor2"))), fatalities=F.col("r.fatalities").try_cast("int"), country=F.col("r.country"), reporting_sources=sources))


def humanitarian_records(landed: DataFrame, identity: list[str]) -> DataFrame:
    """Records of humanitarian themes (column theme): the id is a hash of the identity fields in the order of their names."""
    rows = landed.select("theme", F.explode(F.from_json("payload", "data array<map<string,string>>")["data"]).alias("r"))
    parts = F.array(*[F.concat(F.lit(f"{k}="), F.coalesce(F.try_element_at("r", F.lit(k)), F.lit(""))) for k in sorted(identity)])
    place = F.coalesce(F.try_element_at("r", F.lit("location_name")), F.try_element_at("r", F.lit("location_code")), F.lit("an unnamed place"))
    return item(rows, "hdx", external_id=F.sha2(F.concat_ws("|", F.col("theme"), parts), 256), title=F.concat_ws(" in ", "theme", place), url=F.concat(F.lit("hapi:"), F.col("theme")), published_at=F.try_element_at("r", F.lit("reference_period_start")), category=F.lit("humanitarian"), metadata=F.to_json("r"))


def channel_posts(landed: DataFrame, categories: list[tuple[list[str], str]]) -> DataFrame:
    """Posts of public channels, with a tombstone (status deleted) for every id that the channel names as deleted; a post's category is the first whose term it contains."""
    p = F.from_json("payload", "id string, username string, messages array<struct<id long, text string, date string, edit_date string>>, deleted_ids array<long>")
    rows = landed.select(p.alias("p"))
    said = rows.select("p.id", "p.username", F.explode("p.messages").alias("m"))
    ident = lambda c: F.concat_ws(":", F.col("id"), c.cast("string"))
    url = lambda c: F.concat_ws("/", F.lit("channel:"), F.col("username"), c.cast("string"))
    posts = item(said, "channels", external_id=ident(F.col("m.id")), title=F.coalesce(F.nullif(F.trim(F.substring_index(F.trim("m.text"), "\n", 1)), F.lit("")), F.concat(F.lit("Post of "), F.col("username"))), url=url(F.col("m.id")), summary=F.coalesce("m.text", F.lit("")), published_at=F.col("m.date"), category=by_term(F.col("m.text"), categories, "social-signal"), metadata=meta(channel=F.col("username"), edited_at=F.col("m.edit_date")))
    gone = rows.select("p.id", "p.username", F.explode("p.deleted_ids").alias("d"))
    return posts.union(item(gone, "channels", external_id=ident(F.col("d")), title=F.concat(F.lit("Deleted post of "), F.col("username")), url=url(F.col("d")), category=F.lit("social-signal"), status=F.lit("deleted"), metadata=meta(channel=F.col("username"))))


def found_posts(landed: DataFrame) -> DataFrame:
    """Posts found by several searches (column context): one for each id, with the set of searches that found it."""
    rows = landed.select("context", F.from_json("payload", "data array<struct<id string, text string, author_id string, created_at string>>, includes struct<users array<struct<id string, username string>>>").alias("p"))
    users = F.map_from_entries(F.coalesce(F.transform("p.includes.users", lambda u: F.struct(u["id"], u["username"])), F.array().cast("array<struct<id:string,username:string>>")))
    # Names go to the posts inside a payload: nothing of it but the array is beside the rows that the array gives.
    named = rows.select("context", "p.data", users.alias("u")).select("context", F.transform("data", lambda r: F.struct(r.alias("r"), F.try_element_at("u", r["author_id"]).alias("name"))).alias("_posts"))
    each = named.select("context", F.explode("_posts").alias("x")).where(text("x.r.id").isNotNull())
    one = each.groupBy(F.col("x.r.id").alias("i")).agg(F.min_by("x", "context").alias("x"), F.sort_array(F.collect_set("context")).alias("contexts")).select("x.*", "contexts")
    return item(one, "posts", external_id=F.col("r.id"), title=F.concat(F.lit("Post by "), F.coalesce("name", F.lit("an unknown author"))), url=F.concat(F.lit("post:"), F.col("r.id")), summary=F.coalesce("r.text", F.lit("")), published_at=F.col("r.created_at"), category=F.lit("social-signal"), metadata=meta(contexts=F.col("contexts"), author=F.col("name")))


def airports(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Airports of some types from CSV rows (strings), as reference places."""
    lat, lon = bounded(F.col("latitude_deg").try_cast("double"), 90), bounded(F.col("longitude_deg").try_cast("double"), 180)
    kept = rows.where(F.col("type").isin(*kinds) & lat.isNotNull() & lon.isNotNull())
    ident = first("ident", "id")
    return item(kept, "airports", external_id=first("id", "ident"), title=F.coalesce(text("name"), ident), url=F.concat(F.lit("airport:"), ident), category=F.lit("infrastructure-airport"), latitude=lat, longitude=lon, metadata=meta(country_code=F.substring(F.upper(F.coalesce("iso_country", F.lit(""))), 1, 3), municipality=F.coalesce("municipality", F.lit("")), infrastructure_type=F.col("type"), scheduled=F.coalesce(F.col("scheduled_service") == "yes", F.lit(False))))


def aircraft_states(landed: DataFrame) -> DataFrame:
    """The newest state of every aircraft in metric units: icao24, callsign, latitude, longitude, altitude_m, on_ground, velocity_mps, vertical_mps, heading, observed_at."""
    p = F.from_json("payload", "now double, ac array<struct<hex string, flight string, lat double, lon double, alt_baro string, gs double, track double, baro_rate double>>")
    rows = landed.select(p.alias("p")).select("p.now", F.explode("p.ac").alias("r"))
    rows = rows.where(F.col("r.lat").between(-90, 90) & F.col("r.lon").between(-180, 180) & text("r.hex").isNotNull())
    found = rows.select(F.lower(F.trim("r.hex")).alias("icao24"), F.coalesce(F.trim("r.flight"), F.lit("")).alias("callsign"), F.col("r.lat").alias("latitude"), F.col("r.lon").alias("longitude"), (F.col("r.alt_baro").try_cast("double") * 0.3048).alias("altitude_m"), F.coalesce(F.col("r.alt_baro") == "ground", F.lit(False)).alias("on_ground"), (F.col("r.gs") * 0.514444).alias("velocity_mps"), (F.col("r.baro_rate") * 0.00508).alias("vertical_mps"), F.col("r.track").alias("heading"), F.timestamp_seconds(F.floor("now")).alias("observed_at"))
    rest = [c for c in found.columns if c != "icao24"]
    return found.groupBy("icao24").agg(F.max_by(F.struct(*rest), F.struct("observed_at", "callsign", "latitude", "longitude")).alias("s")).select("icao24", "s.*")


def forecast_cells(landed: DataFrame, hours: tuple[int, ...] = (0, 6, 12, 24)) -> DataFrame:
    """Column-oriented hourly forecasts as rows: latitude, longitude, valid_at, temperature, wind, for the hours asked for that there are."""
    p = F.from_json("payload", "latitude double, longitude double, hourly struct<time array<string>, temperature_2m array<double>, wind_speed_10m array<double>>")
    cells = landed.select(p.alias("p")).select("p.latitude", "p.longitude", F.posexplode(F.arrays_zip("p.hourly.time", *[F.coalesce(f"p.hourly.{c}", F.array().cast("array<double>")).alias(c) for c in ("temperature_2m", "wind_speed_10m")])).alias("hour", "h"))
    return cells.where(F.col("hour").isin(*hours)).select("latitude", "longitude", "hour", F.col("h.time").alias("valid_at"), F.col("h.temperature_2m").alias("temperature"), F.col("h.wind_speed_10m").alias("wind"))


def world_grid(spark, degrees: int, most: int) -> DataFrame:
    """Grid cells from 75 south to 75 north, thinned by an even stride to most cells."""
    n_lat, n_lon = 150 // degrees + 1, -(-360 // degrees)
    stride = max(1, -(-n_lat * n_lon // most))
    cells = spark.range(n_lat * n_lon).where(F.col("id") % stride == 0)
    return cells.select((F.floor(F.col("id") / n_lon) * degrees - 75).cast("double").alias("latitude"), (F.col("id") % n_lon * degrees - 180).cast("double").alias("longitude"))


def contract_violations(sources: DataFrame, kinds: list[str]) -> DataFrame:
    """Sources (id, kind, base_url, allowed_hosts, credibility) that break their contract, with the reasons."""
    host = F.lower(F.regexp_extract("base_url", r"^https://([^/?#:]+)", 1))
    rules = {"kind": ~F.col("kind").isin(*kinds), "https": ~F.startswith("base_url", F.lit("https://")), "credentials": F.rlike("base_url", F.lit("^[a-z]+://[^/?#]*@")), "host": ~F.array_contains("allowed_hosts", host), "credibility": ~F.col("credibility").between(0, 1)}
    reasons = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(True)), name) for name, broken in rules.items()]))
    return sources.select("id", reasons.alias("reasons")).where(F.size("reasons") > 0)


def due(sources: DataFrame, now: Column) -> DataFrame:
    """Sources (id, enabled, poll_seconds, last_polled_at, failures) that are due: their interval, doubled with each failure up to 32 times and a day, has passed; never polled ones are."""
    wait = F.least(F.lit(86_400.0), F.col("poll_seconds") * F.pow(F.lit(2.0), F.least(F.lit(5), F.coalesce("failures", F.lit(0)))))
    since = (F.unix_micros(now) - F.unix_micros("last_polled_at")) / 1e6
    return sources.where(F.col("enabled") & (F.col("last_polled_at").isNull() | (since >= wait))).select("id", wait.alias("wait_seconds"))


def replay_bundle(items_: DataFrame, cutoff: Column, most: int) -> DataFrame:
    """Items captured until a cutoff in their total order, so many at most: captured_at, source, external_id, version, fingerprint."""
    return items_.where(F.col("captured_at") <= cutoff).orderBy("captured_at", "source", "external_id", "version", "fingerprint").limit(most)


def bundle_faults(bundle: DataFrame) -> DataFrame:
    """Rows of a replay bundle that break its contract: a missing identity, a version under 1, a repeated key, a fingerprint that isn't its content's."""
    key = Window.partitionBy("source", "external_id", "version")
    faults = {"identity": F.coalesce(text("source"), F.lit("")).eqNullSafe("") | F.coalesce(text("external_id"), F.lit("")).eqNullSafe(""), "version": F.coalesce(F.col("version") < 1, F.lit(True)), "repeated": F.count("*").over(key) > 1, "fingerprint": ~F.col("fingerprint").eqNullSafe(F.sha2("content", 256))}
    return bundle.withColumn("faults", F.array_compact(F.array(*[F.when(c, n) for n, c in faults.items()]))).where(F.size("faults") > 0)
