"""Landed payloads as items, on own payloads."""

import json

from pyspark.sql import functions as F
from wayfold.plans import feed_queries
from wayfold.sources import feeds


def landed(spark, *payloads, **extra):
    rows = [(json.dumps(p), *extra.values()) for p in payloads]
    return spark.createDataFrame(rows, ", ".join(["payload string", *(f"{k} string" for k in extra)]))


def by_id(df):
    return {r.external_id: r for r in df.collect()}


def test_earthquakes(spark):
    quake = {"id": "q1", "properties": {"mag": 5.1, "place": "12 km off Here", "time": "1700000000000", "url": "http://x/q1", "tsunami": 1}, "geometry": {"type": "Point", "coordinates": [10.5, -3.25, 8.0]}}
    rows = by_id(feeds.earthquakes(landed(spark, {"features": [quake, {"id": "q2", "properties": {}}, {"properties": {"url": "http://x"}}]}, {"features": []})))
    assert list(rows) == ["q1"]
    r = rows["q1"]
    assert (r.latitude, r.longitude, r.category, r.title) == (-3.25, 10.5, "earthquake", "Earthquake near 12 km off Here")
    assert json.loads(r.metadata)["magnitude"] == 5.1 and json.loads(r.metadata)["tsunami"] is True


def test_natural_events_take_the_last_place(spark):
    event = {"id": "e1", "title": "Fire", "link": "", "categories": [{"id": "wildfires", "title": "Wildfires"}], "geometry": [{"date": "a", "type": "Point", "coordinates": [1.0, 2.0]}, {"date": "b", "type": "Point", "coordinates": [3.0, 4.0]}]}
    rows = by_id(feeds.natural_events(landed(spark, {"events": [event, {"id": "e2", "title": "Odd", "link": "u", "geometry": []}]})))
    assert (rows["e1"].latitude, rows["e1"].longitude, rows["e1"].published_at, rows["e1"].category) == (4.0, 3.0, "b", "wildfire")
    assert rows["e2"].latitude is None and rows["e2"].category == "natural-event"


def test_fires(spark):
    rows = spark.createDataFrame([("1.5", "2.5", "2024-01-02", "45", "high", "3.5", "D"), ("", "2.5", "2024-01-02", "45", None, None, None), ("1.0", "2.0", None, "1", None, None, None)], "latitude string, longitude string, acq_date string, acq_time string, confidence string, frp string, daynight string")
    found = feeds.fires(rows, "S").collect()
    assert [(r.external_id, r.published_at) for r in found] == [("firms:S:2024-01-02:0045:1.5:2.5", "2024-01-02T00:45:00Z")]


def test_alerts_and_vulnerabilities(spark):
    alert = {"id": "a1", "properties": {"event": "Flood Watch", "description": "d", "instruction": "i", "sent": "t"}}
    r = by_id(feeds.weather_alerts(landed(spark, {"features": [alert, {"properties": {"event": "x"}}]})))["a1"]
    assert (r.category, r.summary, r.title) == ("floods", "d\n\nInstructions: i", "Flood Watch")
    rows = by_id(feeds.exploited_vulnerabilities(landed(spark, {"vulnerabilities": [{"cveID": "CVE-1-2", "product": "p", "requiredAction": "patch"}, {"cveID": " "}]})))
    assert list(rows) == ["CVE-1-2"] and rows["CVE-1-2"].title == "CVE-1-2: Unknown vendor p" and rows["CVE-1-2"].summary == "patch"


def test_lists_with_and_without_a_name(spark):
    one = {"ghsa_id": "G1", "html_url": "u", "summary": "s"}
    assert set(by_id(feeds.advisories(landed(spark, [one, {"ghsa_id": "G2"}], {"advisories": [{"cve_id": "C1", "html_url": "v"}]})))) == {"G1", "C1"}
    assert by_id(feeds.space_weather(landed(spark, [{"product_id": "p", "message": "m"}, {"message": "n"}])))["p"].summary == "m"


def test_mapping_activations(spark):
    rows = by_id(feeds.mapping_activations(landed(spark, {"results": [{"code": "E1", "centroid": "POINT (10.5 -3)", "category": "Wildfire", "closed": True}, {"activationCode": "E2", "centroid": '{"coordinates": [200, 3]}', "eventType": "Floods"}, {"name": "none"}]})))
    assert (rows["E1"].latitude, rows["E1"].longitude, rows["E1"].status, rows["E1"].category) == (-3.0, 10.5, "closed", "wildfire")
    assert (rows["E2"].latitude, rows["E2"].longitude, rows["E2"].category) == (3.0, None, "flood")


def test_markets(spark):
    r = by_id(feeds.market_prices(landed(spark, [{"id": "m", "question": "Will it?", "slug": "s", "outcomes": '["Yes", "No", "x"]', "outcomePrices": '["0.255", "0.745"]'}])))["m"]
    assert r.summary == "Yes 25.5%, No 74.5%" and json.loads(r.metadata)["factual_evidence"] is False


def test_news_search_keeps_one_for_each_url(spark):
    a = {"url": "http://n/1", "title": "One", "seendate": "20240102T030405Z"}
    rows = feeds.news_search(spark.createDataFrame([(json.dumps({"articles": [a]}), "q2"), (json.dumps({"articles": [a, {"url": ""}]}), "q1")], "payload string, query string")).collect()
    assert len(rows) == 1 and rows[0].published_at == "2024-01-02T03:04:05Z" and json.loads(rows[0].metadata)["query"] == "q1"


def test_series(spark):
    rows = spark.createDataFrame([("A", "2024-01-01", "1.0"), ("A", "2024-02-01", "."), ("A", "2024-03-01", "4.0"), ("B", "2024-01-01", "x")], "series string, date string, value string")
    found = by_id(feeds.series_latest(rows))
    assert list(found) == ["A:2024-03-01"] and json.loads(found["A:2024-03-01"].metadata) == {"value": 4.0, "previous_value": 1.0, "change": 3.0}
    years = spark.createDataFrame([("de", "gdp", "2022", 1.0), ("de", "gdp", "2023", None)], "country string, indicator string, year string, value double")
    assert set(by_id(feeds.indicator_latest(years))) == {"de:gdp:2022"}


def test_forecast_cells_and_grid(spark):
    cells = feeds.forecast_cells(landed(spark, {"latitude": 1.0, "longitude": 2.0, "hourly": {"time": [f"t{i}" for i in range(13)], "temperature_2m": [float(i) for i in range(13)], "wind_speed_10m": [1.0]}})).collect()
    assert [(r.hour, r.temperature) for r in cells] == [(0, 0.0), (6, 6.0), (12, 12.0)]
    grid = feeds.world_grid(spark, 15, 60)
    assert 0 < grid.count() <= 60 and grid.where("latitude between -75 and 75 and longitude between -180 and 179").count() == grid.count()


def test_contract_violations(spark):
    rows = spark.createDataFrame([("ok", "news", "https://a.org/x", ["a.org"], 0.5), ("bad", "odd", "http://u:p@b.org", ["a.org"], 1.5), ("none", None, None, None, None)], "id string, kind string, base_url string, allowed_hosts array<string>, credibility double")
    found = {r.id: set(r.reasons) for r in feeds.contract_violations(rows, ["news"]).collect()}
    assert set(found) == {"bad", "none"} and found["bad"] == {"kind", "https", "credentials", "host", "credibility"}


def test_an_hours_last_half_second_is_the_next_hours(spark, tmp_path):
    at = [(1, "2024-01-01 05:59:59.7"), (2, "2024-01-01 05:59:59.4"), (3, "2024-01-01 05:59:59.5"), (3, "2024-01-01 02:00:00")]
    spark.createDataFrame(at, "user_id long, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    found = {r.icao24: r.observed_at.hour for r in feed_queries.feed_aircraft(spark, str(tmp_path)).collect()}
    assert found == {"h1": 6, "h2": 5, "h3": 6}


def test_payloads_of_searches_do_not_grow_with_the_table(spark, tmp_path, monkeypatch):
    spark.range(9000).select(F.col("id").alias("p_partkey"), F.lit("n").alias("p_name"), F.lit("B").alias("p_brand")).write.parquet(f"{tmp_path}/part.parquet")
    seen = {}
    for name, array in (("found_posts", "data"), ("news_search", "articles")):
        whole = getattr(feeds, name)
        monkeypatch.setattr(feeds, name, lambda landed, whole=whole, array=array: (seen.update({array: [len(json.loads(r.payload)[array]) for r in landed.select("payload").collect()]}), whole(landed))[1])
    assert feed_queries.feed_found_posts(spark, str(tmp_path)).count() == 700
    assert feed_queries.feed_news_search(spark, str(tmp_path)).count() == 500
    assert all(sum(n) == 9000 and max(n) <= 2000 for n in seen.values()) and len(seen) == 2


def test_found_posts_have_the_names_of_their_payload(spark):
    post = {"id": "1", "text": "t", "author_id": "7"}
    rows = feeds.found_posts(landed(spark, {"data": [post, {"id": "2", "author_id": "8"}], "includes": {"users": [{"id": "7", "username": "Ann"}]}}, {"data": [post]}, context="c")).collect()
    assert {r.external_id: r.title for r in rows}["2"] == "Post by an unknown author" and len(rows) == 2
