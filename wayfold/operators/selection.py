"""What is fetched next: turns of publishers, and ceilings for each of them and for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .ingest import SALTS


def numbered(rows: DataFrame, order: list[Column], name: str = "n", parts: int | None = None) -> DataFrame:
    """rows with their place from 0 in the order, without one sorted partition for all.

    Rows are dealt to ranges of the order and written with their range's number;
    the ranges' sizes, summed up (a row for each range), are added to the places
    inside each.  Rows that the order can't tell apart get different places in
    any order; no rows give none.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(rows.repartitionByRange(parts, *order).withColumn("_r", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_r").agg(F.count("*").alias("_k"))
    # A row for each range: parts rows at most.
    before = sizes.select("_r", (F.sum("_k").over(Window.orderBy("_r")) - F.col("_k")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_r").orderBy(*order)).cast("long") - 1
    return dealt.withColumn("_i", inside).join(F.broadcast(before), "_r").withColumn(name, F.col("_i") + F.col("_before")).drop("_r", "_i", "_before")


def first_of(rows: DataFrame, key: str, order: list[Column], k: int, spread: str, name: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank from 0: first k of each of SALTS parts, then of those, so no task gets all rows of a key; a null key is a key."""
    part = F.pmod(F.xxhash64(spread), F.lit(SALTS))
    best = rows.withColumn("_s", part).withColumn("_i", F.row_number().over(Window.partitionBy(key, "_s").orderBy(*order))).where(F.col("_i") <= k).drop("_s", "_i")
    return best.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).where(F.col(name) < k)


def turns(rows: DataFrame, publisher: str, order: list[Column], spread: str, most: int, cursor: str | None) -> DataFrame:
    """The first `most` rows with their place in turn (`turn`, from 0): the first of each publisher, then the second of each and so on.

    Publishers take their turns by name, those after the cursor first.
    """
    ranked = first_of(rows.where(F.col(publisher).isNotNull()), publisher, order, most, spread, "_rank")
    after = (F.col(publisher) <= F.lit(cursor)) if cursor is not None else F.lit(False)
    first = numbered(ranked, [F.col("_rank"), after, F.col(publisher)], "turn")
    return first.where(F.col("turn") < most).drop("_rank")


def within_ceilings(rows: DataFrame, publisher: str, kind: str, turn: str, active: DataFrame, per_publisher: dict[str, int], overall: dict[str, int], most: int) -> DataFrame:
    """The rows that a queue takes, in order of turn: publisher, kind and turn as given, and `place` from 0.

    A row is taken while its publisher has fewer than per_publisher[kind] open
    ones of its kind, all publishers together fewer than overall[kind], and
    fewer than `most` rows are taken.  A kind that per_publisher doesn't name
    (what needs no fetching) has neither ceiling.  active: publisher, kind, n
    that are open already; a publisher that isn't there has none.

    Taking rows one after another gives the same: a publisher's rows pass while
    its own count lasts, whatever the others do, until the kind is full for all.
    So the publisher's ceiling is a rank, that for all a running place among the
    rows within it, and `most` a place among those.  Rows without a publisher or
    a kind, or of one turn with an earlier row, drop out or follow in any order.
    """
    open_ = active.groupBy(publisher, kind).agg(F.sum("n").alias("_open"))
    full = open_.groupBy(kind).agg(F.sum("_open").alias("_all"))  # a row for each kind
    room = lambda limits: F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in limits.items()], F.lit(None).cast("int")) if limits else F.lit(None).cast("int")
    highest = max([*per_publisher.values(), 0])
    ranked = rows.where(F.col(publisher).isNotNull() & F.col(kind).isNotNull()).withColumn("_limited", room(per_publisher).isNotNull())
    limited = first_of(ranked.where("_limited").withColumn("_key", F.struct(publisher, kind)), "_key", [F.col(turn)], highest, turn, "_rank").drop("_key")
    limited = limited.join(open_, [publisher, kind], "left").where(F.col("_rank") + F.coalesce("_open", F.lit(0)) < room(per_publisher)).drop("_open", "_rank")
    placed = numbered(limited, [F.col(kind), F.col(turn)], "_place")
    starts = placed.groupBy(kind).agg(F.min("_place").alias("_start")).join(full, kind, "left")  # a row for each kind
    taken = placed.join(F.broadcast(starts), kind).where(room(overall).isNull() | (F.col("_place") - F.col("_start") + F.coalesce("_all", F.lit(0)) < room(overall))).drop("_place", "_start", "_all")
    every = numbered(taken.union(ranked.where("not _limited").select(*taken.columns)), [F.col(turn)], "place")
    return every.where(F.col("place") < most).drop("_limited")


def select(rows: DataFrame, active: DataFrame, per_source: int, most: int, ready_most: int, per_publisher: dict[str, int], overall: dict[str, int], cursor: str | None = None, ready_cursor: str | None = None) -> DataFrame:
    """The rows of one cycle in their order: version, publisher, source, kind, ready, place (from 0) and priority.

    rows: version (unique), source, publisher, fresh (boolean), full (its text is
    there already, so no ceiling holds), event (of those that wait for more
    publishers; else null).  Of each source the first per_source rows, fresh ones
    first, come up; publishers take turns.  Before them go up to ready_most rows
    of waiting events, one for each event and publisher, in turns of their own;
    a version that comes up twice counts at its first turn.  Ceilings are those
    of within_ceilings for the kinds fresh and backfill.

    Priority: 2 for waiting events, 1 for fresh rows, 0.5 else.  Rows without a
    version or a source don't come up; a null publisher is the source; no rows
    give none.
    """
    clean = rows.where("version is not null and source is not null").select("version", "source", F.coalesce("publisher", "source").alias("publisher"), F.coalesce("fresh", F.lit(False)).alias("fresh"), F.coalesce("full", F.lit(False)).alias("full"), "event")
    order = [F.col("fresh").desc(), F.col("version")]
    ready = clean.where("event is not null").groupBy("event", "publisher").agg(F.min(F.struct((~F.col("fresh")).alias("old"), "version", "source", "full")).alias("_f")).select("_f.version", "_f.source", "publisher", (~F.col("_f.old")).alias("fresh"), "_f.full")
    first = turns(ready, "publisher", order, "version", ready_most, ready_cursor).withColumn("ready", F.lit(True))
    listed = first_of(clean.drop("event"), "source", order, per_source, "version", "_in").drop("_in")
    then = turns(listed, "publisher", [F.col("source"), *order], "version", most, cursor).withColumn("ready", F.lit(False))
    both = first.union(then.select(*first.columns).withColumn("turn", F.col("turn") + ready_most))
    once = both.groupBy("version").agg(F.min_by(F.struct("publisher", "source", "fresh", "full", "ready", "turn"), "turn").alias("_r")).select("version", "_r.*")
    kinds = once.withColumn("kind", F.when(F.col("full"), "full").when(F.col("fresh"), "fresh").otherwise("backfill"))
    taken = within_ceilings(kinds, "publisher", "kind", "turn", active, per_publisher, overall, most)
    priority = F.when(F.col("ready"), 2.0).when(F.col("fresh"), 1.0).otherwise(0.5)
    return taken.select("version", "publisher", "source", "kind", "ready", "place", priority.alias("priority"))


def leased(tasks: DataFrame, publisher: str, order: list[Column], k: int, ident: str) -> DataFrame:
    """The first k tasks of each publisher by the order, then by ident, with publisher_rank from 1."""
    found = first_of(tasks, publisher, [*order, F.col(ident)], k, ident, "_rank")
    return found.withColumn("publisher_rank", F.col("_rank") + 1).drop("_rank")


def article_order(kind: str, priority: str, status: str, at: str) -> list[Column]:
    """Fresh articles first, then those of waiting events (priority 2 or more), then retries, then the rest; each by time."""
    level = F.when(F.col(kind) == "fresh", 0).when(F.col(priority) >= 2, 1).when(F.col(status) == "retry", 2).otherwise(3)
    return [level, F.col(at)]


def fair_order(fresh: str, ready: str, priority: str, at: str) -> list[Column]:
    """Fresh work first, then what makes an event ready, then by priority (small first) and time."""
    return [F.col(fresh).desc(), F.col(ready).desc(), F.col(priority), F.col(at)]


def lane_rotation(jobs: DataFrame, lane: str, order: list[Column], sequence: list[str], start: int, most: int, ident: str) -> DataFrame:
    """The first `most` jobs that a weighted rotation of lanes leases, with `place` from 0.

    sequence names lanes in turn, as often as their weights (verification three
    times, then gaps); the rotation starts at its entry `start`.  An entry whose
    lane has no job left is passed over.  The job of rank r in a lane of weight w
    comes in round r div w at the lane's entry r mod w, so rounds and entries
    sort the jobs and nothing is leased one by one.  Jobs of other lanes are left
    out; an empty sequence gives none.
    """
    turned = sequence[start % len(sequence) :] + sequence[: start % len(sequence)] if sequence else []
    slots = {x: [i for i, y in enumerate(turned) if y == x] for x in turned}
    ranked = first_of(jobs.where(F.col(lane).isin(*slots) if slots else F.lit(False)), lane, [*order, F.col(ident)], most, ident, "_rank")
    pick = lambda f: F.coalesce(*[F.when(F.col(lane) == x, f(s)) for x, s in slots.items()], F.lit(None).cast("int"))
    entry = pick(lambda s: F.get(F.array(*map(F.lit, s)), (F.col("_rank") % len(s)).cast("int")))
    round_ = pick(lambda s: F.floor(F.col("_rank") / len(s)).cast("int"))
    placed = numbered(ranked.withColumn("_round", round_).withColumn("_entry", entry), [F.col("_round"), F.col("_entry")], "place")
    return placed.where(F.col("place") < most).drop("_rank", "_round", "_entry")
