"""Replay: a bundle of captured reports through every stage to a manifest, and values that spread until nothing changes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import items as it
from ..session import written
from . import assignment, evidence, families, fusion, ingest

#: Fields of a report whose change makes a new version.
CONTENT = ["title", "summary", "url", "category", "status", "lat", "lon", "metadata"]
#: Fields of metadata that hold claims, and those that identify an event.
CLAIMS = {"magnitude": "magnitude", "alert": "alert_level", "place": "location", "status": "status"}
IDENTIFIERS = ["event_id", "glide"]
BUNDLE = "source string, external_id string, captured_at timestamp, title string, summary string, url string, category string, status string, lat double, lon double, metadata string, publisher string, credibility double"


def drained(changed: DataFrame, step: Callable[[DataFrame], DataFrame], most: int) -> int:
    """Call step with what changed, then with what that changed, until nothing does; the number of rounds.

    step gives a written table.  More than most rounds are an error, as a stage
    that never rests has no result.
    """
    for rounds in range(most + 1):
        if not changed.limit(1).count():
            return rounds
        changed = step(changed)
    raise ValueError(f"not at rest after {most} rounds")


def least_reaching(values: DataFrame, links: DataFrame, most: int = 10_000) -> tuple[DataFrame, int]:
    """The least value that reaches each id along links a -> b, and the number of rounds until nothing changes.

    values: id (long), value (any type with an order); links: a, b.  Semi-naive:
    only ids whose value fell in the last round send it on, so a round costs
    what changed, not the graph; best values of a round are taken before they
    are shuffled to what is known.  Ids that values don't name have none of
    their own.  A null value says nothing; links from or to null are left out.
    """
    ends = written(links.where("a is not null and b is not null and a <> b").select("a", "b").distinct(), "ends")
    known = [written(values.where("id is not null and value is not null").groupBy("id").agg(F.min("value").alias("value")), "values")]

    def step(changed: DataFrame) -> DataFrame:
        offers = families.met(ends, "a", changed.select(F.col("id").alias("a"), "value"), "b").where("value is not null")
        best = offers.groupBy(F.col("b").alias("id")).agg(F.min("value").alias("value"))
        fell = best.join(known[0].select("id", F.col("value").alias("had")), "id", "left").where("had is null or value < had").select("id", "value")
        fell = written(fell, "fell")
        known[0] = written(known[0].join(fell.select("id", F.col("value").alias("new")), "id", "full_outer").select("id", F.coalesce("new", "value").alias("value")), "values")
        return fell

    rounds = drained(known[0], step, most)
    return known[0], rounds


def fingerprint(table: DataFrame) -> DataFrame:
    """One row: rows and fingerprint of a table as a bag of rows; neither order, partitions nor the order of columns bear on it.

    Each row's SHA-256 over its columns as JSON, by name; the sums of two
    60-bit pieces of these, in hexadecimal.
    """
    row = F.sha2(F.to_json(F.struct(*sorted(table.columns)), {"ignoreNullFields": "false"}), 256)
    piece = lambda at: F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)")
    sums = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(piece(1)), F.lit(0)).alias("_a"), F.coalesce(F.sum(piece(16)), F.lit(0)).alias("_b"))
    return sums.select("rows", F.sha2(F.concat_ws(":", "rows", F.col("_a").cast("string"), F.col("_b").cast("string")), 256).alias("fingerprint"))


def key_of(*columns: str) -> Column:
    """A long that names a row for good: the same for equal columns on any machine and day."""
    return F.xxhash64(*columns)


def stages(bundle: DataFrame, cutoff: Column) -> dict[str, DataFrame]:
    """The tables of a replay, each written: versions, families, decisions, events, claims.

    bundle has the columns of BUNDLE, in any order and any number of times; a
    report captured after the cutoff isn't there yet.  A version is a report of
    an event and revises the one before it.  Reports may meet in an event if
    they share a name, an identifier or a place's cell within the days that
    fusion looks back.  Deleted reports belong to no event and make no claims.
    """
    kept = bundle.where((F.col("captured_at") <= cutoff) & F.col("source").isNotNull() & F.col("external_id").isNotNull()).select(*[c.split()[0] for c in BUNDLE.split(", ")]).distinct()
    log = ingest.version_log(kept, ["source", "external_id"], ["captured_at"], it.content_key(*[F.col(c) for c in CONTENT]))
    log = ingest.predecessor(log, ["source", "external_id"]).withColumns({"document": key_of("source", "external_id"), "id": key_of("source", "external_id", "version")})
    log = log.withColumn("revises", F.lag("id").over(Window.partitionBy("source", "external_id").orderBy("version")))
    versions = written(log, "versions")
    current = ingest.latest(versions, ["document"], ["version"])
    docs = written(current.where("status = 'active'").select(
        F.col("document").alias("id"), "publisher", it.item_fingerprint(F.col("title"), F.col("summary")).alias("fingerprint"), F.get_json_object("metadata", "$.forward_origin").alias("forward_key"),
        "url", it.urls(F.concat_ws(" ", "title", "summary")).alias("links")), "reports")
    grouped = written(families.families(docs, families.relationships(docs)), "families")
    seen = versions.where("status = 'active'").select(
        "id", F.col("captured_at").alias("at"), "title", it.feature_tokens(F.concat_ws(" ", "title", "summary")).alias("tokens"), it.item_names(F.col("title"), F.col("metadata")).alias("entities"), "lat", "lon",
        it.category_family(F.col("category")).alias("family"), "category", it.identifiers(F.col("metadata"), F.col("source"), IDENTIFIERS).alias("identifiers"), "revises",
        F.lit(None).cast("long").alias("current"), F.array().cast("array<long>").alias("barred"))
    seen = written(seen, "observations")
    cell = F.when(it.location_key(F.col("lat"), F.col("lon")) != "", F.concat(F.lit("at:"), F.floor("lat"), F.lit(":"), F.floor("lon")))
    keys = F.array_compact(F.concat("entities", F.transform(F.map_entries("identifiers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), F.array(cell)))
    blocks = seen.select("id", "at", F.explode(F.array_distinct(keys)).alias("block"))
    near = fusion.candidates(blocks, blocks, "block", "at").where("a.id <> b.id").select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    decisions = written(assignment.assign(seen, near), "decisions")
    # A report's membership is its last version's; versions that a later one took the place of are no members.
    ended = decisions.select(F.col("supersedes").alias("id")).where("id is not null").union(versions.where("revises is not null").select(F.col("revises").alias("id"))).distinct()
    members = decisions.where("outcome <> 'review'").join(ended, "id", "left_anti").join(versions.drop("at"), "id").join(grouped.select(F.col("id").alias("document"), F.col("family").alias("reporting")), "document")
    members = written(members.select("event", F.col("document").alias("observation"), F.col("reporting").alias("family"), "source", "category", "title", "credibility", "captured_at", F.col("captured_at").alias("at"), "external_id", "metadata"), "members")
    events = written(fusion.event_summary(members.drop("external_id", "metadata")), "events")
    said = fusion.structured_claims(members.select("source", "external_id", "title", "category", "metadata"), CLAIMS, {})
    backed = said.join(members.select("source", "external_id", "event", "family", "credibility"), ["source", "external_id"])
    weighed = evidence.noisy_or(backed, ["event", "predicate", "value"], "family", "credibility")
    claims = written(weighed.select("event", "predicate", "value", "n_families", F.round("confidence", 6).alias("confidence")), "claims")
    return {"versions": versions.drop("at"), "families": grouped, "decisions": decisions, "events": events, "claims": claims}


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """rows and fingerprint of each table (column stage), and of all together (stage all)."""
    each = None
    for name, table in sorted(tables.items()):
        one = fingerprint(table).select(F.lit(name).alias("stage"), "rows", "fingerprint")
        each = one if each is None else each.union(one)
    whole = each.agg(F.sum("rows").alias("rows"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("stage", F.lit("="), "fingerprint"))), ","), 256).alias("fingerprint"))
    return each.union(whole.select(F.lit("all"), "rows", "fingerprint"))


def replay(bundle: DataFrame, cutoff: Column) -> DataFrame:
    """The manifest of a bundle's replay: equal for equal rows, however they are ordered, repeated or partitioned."""
    return manifest(stages(bundle, cutoff))
