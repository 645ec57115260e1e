"""Merges, splits, moves and their undoing: a log of operations and the memberships that follow from it.

The log is replayed on tokens, not on observations: what an event held at first
and nobody names singly moves as one token, and each observation that a split or
a move names is a token of its own.  So a replay takes memory by the log alone,
and observations meet the intervals of their tokens in an equi-join.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .families import components, met

LOG = "seq long, kind string, left string, right string, observations array<string>, target_seq long"
REPLAYED = "what string, token string, value string, from_seq long, to_seq long, seq long, status string, moved long"

# Fixed value: rows of a batch of results, at least.
OUT_ROWS = 4000


def _resolved(aliases: dict, event: str) -> str:
    while event in aliases:
        event = aliases[event]
    return event


class _Replay:
    """One component's state: where each token is, aliases, what must stay apart, and what an undoing needs."""

    def __init__(self, born: dict, wanted: set):
        self.born, self.wanted = born, wanted
        self.place: dict[str, str] = {}
        self.inside: dict[str, set] = {}
        self.since: dict[str, int] = {}
        self.aliases: dict[str, str] = {}
        self.marks: dict[int, list] = {}
        self.undo: dict[int, dict] = {}
        self.status: dict[int, str] = {}
        self.moved: dict[int, int] = {}
        self.undone: dict[int, int] = {}
        self.rows: list[tuple] = []

    def start(self, token: str, event: str) -> None:
        self.place[token], self.since[token] = event, 0
        self.inside.setdefault(event, set()).add(token)

    def put(self, token: str, event: str, seq: int) -> int:
        old = self.place[token]
        if old == event:
            return 0
        if self.since[token] < seq:
            self.rows.append(("member", token, old, self.since[token], seq, None, None, None))
        self.inside[old].discard(token)
        self.inside.setdefault(event, set()).add(token)
        self.place[token], self.since[token] = event, seq
        return 1

    def mark(self, seq: int, what: str, a: str, b: str, live: bool, now: int) -> None:
        """An alias or a separation of operation seq begins or ends."""
        for m in self.marks.setdefault(seq, []):
            if m[:3] == [what, a, b]:
                break
        else:
            m = [what, a, b, None]
            self.marks[seq].append(m)
        if live:
            m[3] = now
        elif m[3] is not None:
            self.rows.append((what, a, b, m[3], now, seq, None, None))
            m[3] = None
        if what == "alias":
            if live:
                self.aliases[a] = b
            elif self.aliases.get(a) == b:
                del self.aliases[a]

    def apply(self, seq: int, kind: str, left, right, named, target) -> None:
        done = getattr(self, f"_{kind}", lambda *_: None)(seq, left, right, named, target) if kind in ("merge", "split", "reattribute", "rollback") else None
        self.status[seq], self.moved[seq] = ("refused", 0) if done is None else ("applied", done)

    def keep(self, seq: int, tokens) -> None:
        if seq in self.wanted:
            self.undo[seq] = {t: self.place[t] for t in tokens}

    def _merge(self, seq, left, right, named, target):
        left, right = _resolved(self.aliases, left), _resolved(self.aliases, right)
        if left == right or left not in self.born or right not in self.born:
            return None
        winner, loser = sorted((left, right), key=lambda e: (self.born[e], e))
        self.keep(seq, self.inside.get(left, set()) | self.inside.get(right, set()))
        moved = sum(self.put(t, winner, seq) for t in sorted(self.inside.get(loser, ())))
        self.mark(seq, "alias", loser, winner, True, seq)
        return moved

    def _split(self, seq, left, right, named, target):
        source = _resolved(self.aliases, left)
        tokens = [f"o:{o}" for o in named or ()]
        if not tokens or any(self.place.get(t) != source for t in tokens) or right is None or right == source or right in self.aliases:
            return None
        self.born.setdefault(right, (1, seq))
        self.keep(seq, self.inside[source])
        moved = sum(self.put(t, right, seq) for t in tokens)
        self.mark(seq, "separate", source, right, True, seq)
        return moved

    def _reattribute(self, seq, left, right, named, target):
        event = _resolved(self.aliases, right)
        tokens = [f"o:{o}" for o in named or ()]
        if len(tokens) != 1 or tokens[0] not in self.place or event not in self.born or self.place[tokens[0]] == event:
            return None
        source = self.place[tokens[0]]
        self.keep(seq, tokens)
        moved = self.put(tokens[0], event, seq)
        self.mark(seq, "separate", source, event, True, seq)
        return moved

    def _rollback(self, seq, left, right, named, target):
        if self.status.get(target) != "applied":
            return None
        before = self.undo[target]
        self.keep(seq, before)
        moved = sum(self.put(t, e, seq) for t, e in sorted(before.items()))
        self._lit(target, False, seq)
        self.status[target] = "reversed"
        return moved

    def _lit(self, target: int, live: bool, now: int) -> None:
        """Marks of an operation end with its undoing; the undoing of that brings them back."""
        if target in self.undone:
            self._lit(self.undone[target], not live, now)
            self.status[self.undone[target]] = "applied" if not live else "reversed"
        for what, a, b, _ in list(self.marks.get(target, ())):
            self.mark(target, what, a, b, live, now)

    def results(self):
        yield from self.rows
        for t, e in self.place.items():
            yield ("member", t, e, self.since[t], None, None, None, None)
        for seq, marks in self.marks.items():
            yield from ((what, a, b, since, None, seq, None, None) for what, a, b, since in marks if since is not None)
        for seq, status in self.status.items():
            yield ("operation", None, None, seq, None, seq, status, self.moved[seq])


def replayed_log(records: list[dict]):
    """Rows of REPLAYED for one component: its events, its named observations and its operations, in any order."""
    events = {r["event"]: (0, r["born"] or 0) for r in records if r["part"] == "event"}
    log = sorted((r for r in records if r["part"] == "log"), key=lambda r: r["seq"])
    state = _Replay(events, {r["target_seq"] for r in log if r["target_seq"] is not None})
    for event in events:
        state.start(f"e:{event}", event)
    for r in records:
        if r["part"] == "observation":
            state.start(f"o:{r['observation']}", r["event"])
    for r in log:
        # The undoing of an undoing must know which operation it brings back.
        if r["kind"] == "rollback" and state.status.get(r["target_seq"]) == "applied":
            state.undone[r["seq"]] = r["target_seq"]
        state.apply(r["seq"], r["kind"], r["left"], r["right"], r["observations"], r["target_seq"])
    return list(state.results())


def replay(events: DataFrame, members: DataFrame, log: DataFrame) -> DataFrame:
    """What a log of operations does (REPLAYED): intervals of tokens, aliases and separations, and each operation's outcome.

    events: event (string), born (long; the older one wins a merge, then the
    smaller name; null counts as 0).  members: observation, event.  log (LOG): merge of left and right; split of
    observations of left into the new event right; reattribute of one
    observation to right; rollback of the operation target_seq, which puts back
    whatever that operation's events held before it, even where later operations
    moved it since.  A rollback is an operation too: its own undoing brings back
    the aliases and separations that it ended.

    Names of merged events lead to the event that took them in.  Refused, and
    without effect: a merge of an event with itself, of events that aren't in
    events; a split that names what isn't in the event, or nothing, or that
    splits into a merged name; a move to where the
    observation is; the undoing of what isn't applied; kinds unknown.  Two
    operations of one seq are one (the first by kind, left, right); a null seq is
    left out; an observation in two events is in the smaller.

    Operations are replayed by components of the graph of events that they
    touch, which run in parallel; a component costs memory by its operations and
    the observations that they name, not by the observations of its events.
    """
    spark = log.sparkSession
    ship(spark)
    parted = log.where("seq is not null").groupBy("seq").agg(F.min(F.struct("kind", "left", "right", F.array_sort(F.array_distinct("observations")).alias("observations"), "target_seq")).alias("_o")).select("seq", "_o.*")
    parted = written(parted, "operations")
    named = parted.select(F.explode("observations").alias("observation")).where("observation is not null").distinct()
    at_first = members.where("observation is not null and event is not null").join(named, "observation", "left_semi").groupBy("observation").agg(F.min("event").alias("event"))
    at_first = written(at_first, "named")
    # Nodes are numbers: operations by seq, events by hash; a collision joins two components, which changes nothing but their size.
    node = lambda c: F.xxhash64(F.lit("event"), c)
    op = F.xxhash64(F.lit("op"), "seq")
    links = (
        parted.where("left is not null").select(op.alias("a"), node("left").alias("b"))
        .union(parted.where("right is not null").select(op, node("right")))
        .union(parted.where("target_seq is not null").select(op, F.xxhash64(F.lit("op"), "target_seq")))
        .union(parted.select("seq", F.explode("observations").alias("observation")).join(at_first, "observation").select(op, node("event")))
    )
    roots = components(links)
    rooted = lambda rows, key: rows.withColumn("id", key).join(roots, "id", "left").withColumn("component", F.coalesce("component", "id"))
    void = lambda kind: F.lit(None).cast(kind)
    logged = rooted(parted, op).select("component", F.lit("log").alias("part"), void("string").alias("event"), void("string").alias("observation"), void("long").alias("born"), *[F.col(c) for c in ("seq", "kind", "left", "right", "observations", "target_seq")])
    blank = [void(t).alias(c) for c, t in (("seq", "long"), ("kind", "string"), ("left", "string"), ("right", "string"), ("observations", "array<string>"), ("target_seq", "long"))]
    # Only events that some operation touches are replayed; the others keep what they have.
    touched = events.where("event is not null").groupBy("event").agg(F.min("born").cast("long").alias("born")).withColumn("id", node("event")).join(roots, "id").select("component", F.lit("event").alias("part"), "event", void("string").alias("observation"), "born", *blank)
    singles = at_first.withColumn("id", node("event")).join(roots, "id").select("component", F.lit("observation").alias("part"), "event", "observation", void("long").alias("born"), *blank)

    names = [c.split()[0] for c in REPLAYED.split(", ")]

    def run(batches):
        import pyarrow as pa

        kinds = {"from_seq": pa.int64(), "to_seq": pa.int64(), "seq": pa.int64(), "moved": pa.int64()}
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(names)], names=names)
        out = []
        for _, records in groupby((r for b in batches for r in b.to_pylist()), key=lambda r: r["component"]):
            out += replayed_log(list(records))
            if len(out) >= OUT_ROWS:
                yield batch(out)
                out = []
        yield batch(out)

    # A component's rows lie together, so a task holds one component; a call of Python for each would take longer than its replay.
    return logged.union(touched).union(singles).repartition("component").sortWithinPartitions("component").mapInArrow(run, REPLAYED)


def histories(members: DataFrame, done: DataFrame) -> DataFrame:
    """observation, event, from_seq, to_seq (null: still): every observation's way through the events, from replay's rows.

    members are dealt to parts by observation, each of which meets its event's
    intervals by itself, so an event with a third of all observations is no one
    task's.  What no operation touched stays where it is from 0 on.
    """
    # Both joins below read them; a token's intervals are as many as the operations that moved it.
    ways = written(done.where("what = 'member'").groupBy("token").agg(F.collect_list(F.struct(F.col("value").alias("event"), "from_seq", "to_seq")).alias("_way")), "ways")
    first = members.where("observation is not null and event is not null").groupBy("observation").agg(F.min("event").alias("event"))
    single = first.withColumn("token", F.concat(F.lit("o:"), "observation")).join(ways, "token", "left")
    base = met(single.select("observation", "event", F.col("_way").alias("_own"), F.concat(F.lit("e:"), "event").alias("token")), "token", ways, "observation")
    stays = F.array(F.struct(F.col("event"), F.lit(0).cast("long").alias("from_seq"), F.lit(None).cast("long").alias("to_seq")))
    return base.select("observation", F.explode(F.coalesce("_own", "_way", stays)).alias("_w")).select("observation", "_w.*")


def as_of(intervals: DataFrame, seq: Column | int) -> DataFrame:
    """Rows that hold after the operation seq."""
    at = seq if isinstance(seq, Column) else F.lit(seq)
    return intervals.where((F.col("from_seq") <= at) & (F.col("to_seq").isNull() | (F.col("to_seq") > at)))
