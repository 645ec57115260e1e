"""All pairs within groups of rows, tile by tile: similar token sets, and each vector's nearest other."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .families import met

#: Rows of a tile's side at most, on average; tokens of a tile that are counted by matrix product; steps of a tile: rows, shared tokens, and pairs.
TILE, COMMON, ROWS, STEP, CELLS = 4000, 512, 512, 8_000_000, 4_000_000
#: Chunks of a class of token sets that TILE alone makes; rows and tokens of a chunk at most, on average; tokens that get a short code.
SIDES, MOST, WHOLE, USUAL = 8, 16_000, 4_000_000, 65_536


def token_sets(docs: DataFrame, ident: str, text: str, on: list[str], least: int = 3) -> DataFrame:
    """ident, on, same and tokens of one row for each different text of a group (equal on-columns): that with the smallest ident.

    Texts are the same if all their lower-case runs of a-z and 0-9 are; same is
    a hash of these, tokens are 64-bit hashes of the distinct runs of at least
    so many characters.  Rows with a null on-column, and those without such a
    token, are left out.  ident is a unique long.
    """

    def run(batches):
        import re

        import xxhash

        find, digest, known = re.compile("[a-z0-9]+").findall, xxhash.xxh3_64_intdigest, {}
        for batch in batches:
            same, tokens = [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                every = find(t or "")
                same.append(xxhash.xxh3_128_digest(" ".join(every)))
                for w in (mine := {w for w in every if len(w) >= least}):
                    if w not in known:
                        known[w] = digest(w)
                tokens.append(np.array([known[w] for w in mine], np.uint64).view(np.int64))
                if len(known) > 1_000_000:
                    known.clear()
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32()), pa.array(np.concatenate([*tokens, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(same, pa.binary()), flat], names=[*batch.schema.names[:-1], "same", "tokens"])

    whole = " and ".join(f"{c} is not null" for c in on)
    rows = docs.where(whole).select(F.col(ident).cast("long").alias(ident), *on, F.lower(text).alias("_t"))
    fields = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in (ident, *on))
    # Read several times, here and for tiles: texts are cut into tokens once.
    found = written(rows.mapInArrow(run, f"{fields}, same binary, tokens array<long>").where("size(tokens) > 0"), "tokens")
    first = found.groupBy("same", *on).agg(F.min(ident).alias(ident))
    return found.join(first.select(ident), ident, "left_semi")


def usual(rows: DataFrame, tokens: str) -> np.ndarray:
    """The USUAL tokens that most rows have, ascending; what is chosen bears on bytes alone, not on results."""
    counted = rows.select(F.explode(tokens).alias("t")).groupBy("t").count()
    return np.sort(np.array([r.t for r in counted.orderBy(F.desc("count"), "t").limit(USUAL).collect()], np.int64))


def similar_sets(rows: DataFrame, ident: str, on: list[str], percent: int) -> DataFrame:
    """left_id < right_id, common and every (sizes of intersection and union) of all pairs of rows with equal on-columns and a Jaccard similarity of tokens of percent / 100 or more.

    rows are those of token_sets().  Sets of a group are dealt by size, then by
    ident, into chunks; every two chunks whose sizes allow the similarity make a
    tile, in which all pairs are counted.  Nothing else is left out, so the work
    grows with the square of a group, though not that of a task.  What is sent is
    a set for each tile that it is in: a class of sizes has SIDES chunks at most
    until these hold MOST rows or WHOLE tokens, and usual tokens take two bytes.
    """
    shipped = written(rows.select(ident, *on, "tokens", F.size("tokens").alias("_n")), "sets")
    sized = shipped.withColumn("_class", F.floor(F.log(F.col("_n")) / float(np.log(100 / percent))))
    known = usual(shipped, "tokens")

    def shortened(batches):
        for batch in batches:
            lists = batch.column("tokens")
            ends = np.asarray(lists.offsets, np.int64)
            flat, row = np.asarray(lists.values)[ends[0] : ends[-1]], np.repeat(np.arange(len(lists)), np.diff(ends))
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            hit = known[at] == flat
            columns = []
            for mine, values in ((hit, at[hit].astype(np.uint16).view(np.int16)), (~hit, flat[~hit])):
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[mine], minlength=len(lists)))]), pa.int32()), pa.array(values)))
            rest = [c for c in batch.schema.names if c != "tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], names=[*rest, "often", "seldom"])

    kinds = ", ".join(f"{c} {sized.schema[c].dataType.simpleString()}" for c in sized.columns if c != "tokens")
    coded = sized.mapInArrow(shortened, f"{kinds}, often array<smallint>, seldom array<bigint>")
    parts = F.greatest(F.ceil(F.count("*") / MOST), F.ceil(F.sum("_n") / WHOLE), F.least(F.ceil(F.count("*") / TILE), F.lit(SIDES))).cast("int")
    counts = sized.groupBy(*on, "_class").agg(F.count("*").alias("n"), parts.alias("_parts"), F.min("_n").alias("_low"), F.max("_n").alias("_high"))
    counts = written(counts, "classes")
    other = counts.select(*on, *[F.col(c).alias(f"_o{c}") for c in ("n", "_class", "_parts", "_low", "_high")])
    near = counts.join(other, on).where(f"if(_class = _o_class, n > 1, if(_class < _o_class, 100 * _high >= {percent} * _o_low, 100 * _o_high >= {percent} * _low))")
    # Of two classes the first is side 0 of a tile, of one class the first part.
    near = near.groupBy(*on, "_class", "_parts").agg(F.collect_list(F.struct(F.col("_o_class").alias("c"), F.col("_o_parts").alias("m"))).alias("_near"))
    tile = """if(c.c = _class, struct(_class as c, least(_part, q) as p, _class as d, greatest(_part, q) as q, int(_part > q) as side),
      if(c.c > _class, struct(_class as c, _part as p, c.c as d, q as q, 0 as side), struct(c.c as c, q as p, _class as d, _part as q, 1 as side)))"""
    dealt = met(coded, [*on, "_class"], near, ident, counts.select(*on, "_class", "n")).where("_near is not null").withColumn("_part", F.expr(f"int(pmod(xxhash64({ident}), _parts))"))
    placed = dealt.select(*on, F.col(ident).alias("id"), "often", "seldom", F.explode(F.expr(f"flatten(transform(_near, c -> transform(sequence(0, c.m - 1), q -> {tile})))")).alias("t"))
    placed = placed.select(*on, F.struct("t.c", "t.p", "t.d", "t.q").alias("tile"), F.col("t.side").alias("side"), "id", "often", "seldom")
    # Few bytes are much work here: partitions aren't joined by their bytes.
    placed = placed.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on, "tile")
    common, rows_, step, cells, share, codes = COMMON, ROWS, STEP, CELLS, percent, USUAL

    def count(table: pa.Table) -> pa.Table:
        """Pairs of one tile: frequent tokens by matrix product, the others through lists of the rows that have them."""
        side, ids = np.asarray(table.column("side")), np.asarray(table.column("id"))
        token, row = [], []
        for name in ("often", "seldom"):
            lists = table.column(name).combine_chunks()
            ends = np.asarray(lists.offsets, np.int64)
            token.append(np.asarray(lists.values)[ends[0] : ends[-1]])
            row.append(np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(ends)))
        sizes = np.bincount(np.concatenate(row), minlength=len(ids))
        seldom, which, times = np.unique(token[1], return_inverse=True, return_counts=True)
        some = times[which] > 1  # a token of one row is in no pair
        token, row = np.concatenate([token[0].view(np.uint16).astype(np.int32), which[some].astype(np.int32) + codes]), np.concatenate([row[0], row[1][some]])
        order = np.argsort(row, kind="stable")
        token, row = token[order], row[order]
        at = [np.flatnonzero(side == 0), np.flatnonzero(side == (1 if side.any() else 0))]
        sparse, n = [], codes + len(seldom)
        for a in at:
            place = np.full(len(ids), -1, np.int32)
            place[a] = np.arange(len(a))
            mine = place[row] >= 0
            sparse.append((place[row[mine]], token[mine]))
        (r, t), (c, u) = sparse
        in_a, in_b = np.bincount(t, minlength=n), np.bincount(u, minlength=n)
        column = np.full(n, -1, np.int32)
        often = np.argsort(-in_a * in_b, kind="stable")[:common]
        column[often] = np.arange(len(often))
        dense = []
        for x, y, k in ((r, t, len(at[0])), (c, u, len(at[1]))):
            m = np.zeros((k, len(often)), np.float32)
            m[x[column[y] >= 0], column[y][column[y] >= 0]] = 1
            dense.append(m)
        r, t = r[column[t] < 0], t[column[t] < 0]
        c, u = c[column[u] < 0], u[column[u] < 0]
        order = np.argsort(u, kind="stable")
        c, lengths = c[order], np.bincount(u, minlength=n)
        starts = np.cumsum(lengths) - lengths
        cost = np.bincount(r, weights=lengths[t], minlength=len(at[0]))
        begins = np.searchsorted(r, np.arange(len(at[0]) + 1))  # r is sorted, as rows are
        na, nb = sizes[at[0]], sizes[at[1]]
        most = max(1, min(rows_, cells // max(1, len(nb))))
        out, i = [(np.zeros(0, np.int64),) * 4], 0
        while i < len(at[0]) and len(nb):
            to = i + max(1, min(most, int(np.searchsorted(np.cumsum(cost[i : i + most]), step, "right"))))
            to = min(to, len(at[0]))
            both = (dense[0][i:to] @ dense[1].T).astype(np.int64)
            rr, tt = r[begins[i] : begins[to]] - i, t[begins[i] : begins[to]]
            times = lengths[tt]
            total = int(times.sum())
            if total:
                hit = np.repeat(starts[tt] - (np.cumsum(times) - times), times) + np.arange(total)
                both += np.bincount(np.repeat(rr.astype(np.int64) * len(nb), times) + c[hit], minlength=both.size).reshape(both.shape)
            x, y = np.nonzero((both > 0) & ((100 + share) * both >= share * (na[i:to, None] + nb[None, :])))
            a, b = ids[at[0][x + i]], ids[at[1][y]]
            take = a < b if not side.any() else a != b
            k, a, b, every = both[x, y][take], a[take], b[take], (na[x + i] + nb[y])[take]
            out.append((np.minimum(a, b), np.maximum(a, b), k, every - k))
            i = to
        return pa.table([pa.array(np.concatenate([o[k] for o in out]), pa.int64()) for k in range(4)], names=["left_id", "right_id", "common", "every"])

    return placed.groupBy(*on, "tile").applyInArrow(count, "left_id long, right_id long, common long, every long")


def nearest_cosines(asked: DataFrame, rows: DataFrame, ident: str, group: str, vector: str, k: int, digits: int) -> DataFrame:
    """query_id, ident, similarity (rounded to digits) and rank (from 1) of the k rows of its group most similar to each asked row, itself left out; ties to the smaller ident.

    Rows of a group are dealt to chunks, and each chunk is compared with all
    asked rows of its group, of which there are at most TILE in a task; a chunk
    gives each its first k, also where copies are ties.  Rows with a null group
    are left out; a null vector, or one that holds null, has a null similarity
    with every other, which comes last.  Else as best_cosine().  The work is the
    product of a group's sides, a task's is TILE of each.
    """
    sound = lambda df: df.where(F.col(group).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    b, a = sound(rows), sound(asked)
    parts = lambda df, n: df.groupBy("g").agg(F.ceil(F.count("*") / TILE).cast("int").alias(n))
    counts = parts(b, "parts").join(parts(a, "sides"), "g")
    deal = lambda df, mine, other, side: df.join(counts, "g").select("id", "g", "v", F.pmod(F.xxhash64("id"), F.col(mine)).cast("int").alias("m"), F.explode(F.expr(f"sequence(0, {other} - 1)")).alias("q"), F.lit(side).alias("side"))
    one = deal(b, "parts", "sides", 1).select("id", "g", "v", F.col("m").alias("part"), F.col("q").alias("ask"), "side")
    two = deal(a, "sides", "parts", 0).select("id", "g", "v", F.col("q").alias("part"), F.col("m").alias("ask"), "side")

    rows_, cells = ROWS, CELLS

    def compare(table: pa.Table) -> pa.Table:
        """Each asked row's first k of one chunk, by matrix product, a block of asked rows at a time."""
        table = table.take(pa.array(np.argsort(np.asarray(table.column("id")), kind="stable")))  # ties go to the smaller id
        ids, side, lists = np.asarray(table.column("id")), np.asarray(table.column("side")), table.column("v").combine_chunks()
        ends, nulls = np.asarray(lists.offsets, np.int64), np.concatenate([[0], np.cumsum(np.asarray(lists.values.is_null()))])
        flat, sizes = lists.values.to_numpy(zero_copy_only=False).astype(np.float64), np.diff(ends)
        void = np.asarray(lists.is_null()) | (nulls[ends[1:]] > nulls[ends[:-1]])
        units, at = {}, np.zeros(len(ids), np.int64)
        for d in np.unique(sizes):
            mine = np.flatnonzero(sizes == d)
            m = flat[ends[mine][:, None] + np.arange(d)[None, :]]
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            units[d], at[mine] = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0), np.arange(len(mine))
        ask, to = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        step, out = max(1, min(rows_, cells // max(1, len(to)))), []
        for i in range(0, len(ask) if len(to) else 0, step):
            mine = ask[i : i + step]
            score = np.zeros((len(mine), len(to)))
            for d in np.unique(sizes[mine]):
                x, y = np.flatnonzero(sizes[mine] == d), np.flatnonzero(sizes[to] == d)
                score[np.ix_(x, y)] = np.clip(units[d][at[mine[x]]] @ units[d][at[to[y]]].T, -1, 1)
            score[void[mine]], score[:, void[to]] = np.nan, np.nan
            score = np.nan_to_num(score, nan=-2.0)
            score[ids[mine][:, None] == ids[to][None, :]] = -np.inf
            # Rounded values decide, and rounding may make ties: all within a last digit of the k-th are kept, but of equal values the first k.
            low = np.partition(score, len(to) - k, axis=1)[:, len(to) - k] - 2 * 10.0**-digits if len(to) > k else np.full(len(mine), -np.inf)
            x, y = np.nonzero((score >= low[:, None]) & (score > -np.inf))
            order = np.lexsort((y, score[x, y], x))
            x, y = x[order], y[order]
            first = np.concatenate([[True], (np.diff(x) != 0) | (np.diff(score[x, y]) != 0)])[: len(x)]
            place = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
            x, y = x[place < k], y[place < k]
            out.append((ids[mine[x]], ids[to[y]], score[x, y]))
        query, found, value = (np.concatenate([o[c] for o in out] or [np.zeros(0)]) for c in range(3))
        return pa.table({"query_id": pa.array(query, pa.int64()), "id": pa.array(found, pa.int64()), "similarity": pa.array(value, pa.float64(), mask=value < -1)})

    # Few bytes are much work here: partitions aren't joined by their bytes.
    placed = one.union(two).repartition(int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "part", "ask")
    found = placed.groupBy("g", "part", "ask").applyInArrow(compare, "query_id long, id long, similarity double").withColumn("similarity", F.round("similarity", digits))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("id").alias(ident), "similarity", "rank")


def best_cosine(rows: DataFrame, ident: str, group: str, vector: str) -> DataFrame:
    """ident, group and best, each vector's highest cosine with another of its group; none for a vector that is alone.

    Vectors of a group are dealt by ident into chunks, and every two chunks are
    compared in one task.  0 for unequal lengths, empty and zero vectors.  Rows
    with a null group or vector are left out; ident is a unique long.
    """
    sound = rows.where(F.col(group).isNotNull() & F.col(vector).isNotNull()).select(F.col(ident).cast("long").alias("id"), F.col(group).alias("g"), F.col(vector).cast("array<double>").alias("v"))
    counts = sound.groupBy("g").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    dealt = sound.join(counts, "g").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("q", F.explode(F.expr("sequence(0, parts - 1)")))
    placed = dealt.select("id", "g", "v", "part", F.least("part", "q").alias("low"), F.greatest("part", "q").alias("high"))
    step = ROWS

    def compare(table: pa.Table) -> pa.Table:
        ids, part = np.asarray(table.column("id")), np.asarray(table.column("part"))
        lists = table.column("v").combine_chunks()
        ends, flat = np.asarray(lists.offsets, np.int64), np.asarray(lists.values, np.float64)
        sizes, best = np.diff(ends), np.full(len(ids), -np.inf)
        units = {}
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            m = flat[ends[at][:, None] + np.arange(d)[None, :]]
            norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
            units[d] = (at, np.divide(m, norm, out=np.zeros_like(m), where=norm > 0))
        for d, (at, x) in units.items():
            one = part[at] == table.column("low")[0].as_py()
            for e, (to, y) in units.items():
                two = part[to] == table.column("high")[0].as_py()
                b, yb = to[two], y[two]
                for k in range(0, int(one.sum()) if len(b) else 0, step):
                    a, xa = at[one][k : k + step], x[one][k : k + step]
                    m = xa @ yb.T if d == e else np.zeros((len(a), len(b)))
                    m[ids[a][:, None] == ids[b][None, :]] = -np.inf
                    best[a] = np.maximum(best[a], m.max(axis=1))
                    best[b] = np.maximum(best[b], m.max(axis=0))
        found = np.isfinite(best)
        return pa.table({"id": ids[found], "g": table.column("g").filter(pa.array(found)), "best": np.clip(best[found], -1, 1)})

    found = placed.groupBy("g", "low", "high").applyInArrow(compare, f"id long, g {sound.schema['g'].dataType.simpleString()}, best double")
    return found.groupBy("id", "g").agg(F.max("best").alias("best")).select(F.col("id").alias(ident), F.col("g").alias(group), "best")
