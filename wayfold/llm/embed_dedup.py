"""Near duplicates among embeddings by tiled comparison in the order of principal components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import again, connected_components, written

#: Tiles of a block's side: a task compares so many with so many.
BLOCK = 8
#: Vectors of a tile; leading components that place vectors in cells; components after which a pair's bound is looked at.
TILE, CELL_DIMS, STEPS = 512, 2, (8, 16, 32, 64, 128, 256, 512, 1024)
#: Lengths of vectors for which components are fitted; others are compared in the order of their own components.
FITTED = 8


def is_sound(vector: str, label: str, ident: str) -> str:
    """SQL: whether a row can be linked at all."""
    return f"`{ident}` is not null and `{label}` is not null and `{vector}` is not null and size(`{vector}`) > 0 and not exists(`{vector}`, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(`{vector}`, x -> x <> 0)"


def moments(sound: DataFrame) -> DataFrame:
    """Sums of products of components of unit vectors: dim, i, and row i of the matrix as bytes.  A task gives one row for each component, which Spark adds up."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, unit in by_length(batch.column(0)):
                sums[d] = sums.get(d, 0) + unit[1].T @ unit[1]
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array([x.tobytes() for x in m], pa.binary())], names=["dim", "i", "row"])

    def add(table: pa.Table) -> pa.Table:
        total = np.frombuffer(b"".join(table.column("row").to_pylist()), np.float64).reshape(table.num_rows, -1)
        return pa.table({"dim": table.column("dim")[:1], "i": table.column("i")[:1], "row": pa.array([total.sum(axis=0).tobytes()], pa.binary())})

    schema = "dim long, i long, row binary"
    return sound.mapInArrow(run, schema).groupBy("dim", "i").applyInArrow(add, schema)


def by_length(vectors: pa.Array):
    """Yield (length, (positions, unit vectors)) for each length among vectors."""
    lengths = np.asarray(vectors.value_lengths())
    starts = np.asarray(vectors.offsets, np.int64)[:-1]
    flat = np.asarray(vectors.values, np.float64)
    for d in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == d)
        m = flat[starts[at][:, None] + np.arange(d)]
        m = m / np.abs(m).max(axis=1, keepdims=True)
        yield d, (at, m / np.sqrt((m * m).sum(axis=1, keepdims=True)))


def bases(sound: DataFrame) -> dict[int, np.ndarray]:
    """The principal components of unit vectors, largest first, for the FITTED most frequent lengths."""
    frequent = [r["d"] for r in sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(FITTED).collect()]
    if not frequent:
        return {}
    sums: dict[int, np.ndarray] = {d: np.zeros((d, d)) for d in frequent}
    for r in moments(sound.where(F.size("v").isin(frequent)).select("v")).collect():
        sums[r["dim"]][r["i"]] = np.frombuffer(r["row"], np.float64)
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in sums.items()}


def compare(a: np.ndarray, b: np.ndarray, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two tiles whose cosine reaches the threshold.

    Leading components are summed first.  What the rest can add is at most the
    product of the norms of both suffixes; a pair stops when even that falls
    short.  While many pairs stand, whole tiles are multiplied; then pairs alone.
    """
    gap = 2 - 2 * threshold + 1e-9
    lead = min(8, a.shape[1])
    apart = np.maximum(0, np.maximum(a[:, :lead].min(0) - b[:, :lead].max(0), b[:, :lead].min(0) - a[:, :lead].max(0)))
    none = np.zeros(0, np.int64)
    if (apart**2).sum() > gap:
        return none, none
    d, done, total = a.shape[1], 0, np.zeros((len(a), len(b)))
    rest = lambda m, k: np.sqrt(np.maximum(0, (m[:, k:] ** 2).sum(axis=1)))
    i = j = s = None
    for k in [x for x in STEPS if x < d] + [d]:
        ra, rb = rest(a, k), rest(b, k)
        if i is None:
            total += a[:, done:k] @ b[:, done:k].T
            stands = total + ra[:, None] * rb[None, :] >= threshold - 1e-12 * (k < d)
            if same:
                stands &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
            n = int(stands.sum())
            if n < 0.02 * stands.size or k == d:
                i, j = np.nonzero(stands)
                s = total[i, j]
        else:
            s = s + np.einsum("ij,ij->i", a[i, done:k], b[j, done:k])
            stands = s + ra[i] * rb[j] >= threshold - 1e-12 * (k < d)
            i, j, s = i[stands], j[stands], s[stands]
        if i is not None and not len(i):
            return none, none
        done = k
    return i, j


LINKS = pa.schema([("id", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])


def linked_tiles(ours: tuple, theirs: tuple, same: bool, threshold: float):
    """Yield the links of two tiles (number, ids, copies, vectors), if any: counts of links by id, and a spanning forest."""
    (_, ids_a, copies_a, a), (_, ids_b, copies_b, b) = ours, theirs
    i, j = compare(a, b, same, threshold)
    if not len(i):
        return
    n = len(a)
    links = np.concatenate([np.bincount(i, copies_b[j], n), np.bincount(j, copies_a[i], len(b))]).astype(np.int64)
    root, names = list(range(n + len(b))), [*ids_a.tolist(), *ids_b.tolist()]

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(i.tolist(), (j + n).tolist(), strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y, key=names.__getitem__)] = min(x, y, key=names.__getitem__)
    linked = np.flatnonzero(links).tolist()
    yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in linked], pa.int64()), pa.array(links[linked]), pa.array([names[find(x)] for x in linked], pa.int64())], schema=LINKS)


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Vectors with their links: vec_id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and their cosine, in double
    precision, is threshold or more.  n_links counts the vectors linked with a
    row, component_id is the smallest id reachable by links (its own included),
    and kept holds for that row.

    Equal vectors of a label form a class, and one stands for all.  Vectors are
    turned into principal components; the first two place them in cells so wide
    that linked vectors are in the same or in touching cells.  A cell's vectors
    are dealt to tiles of some 512, and tiles of touching cells are compared, a
    block of BLOCK by BLOCK tiles at a time, so that a crowded cell is many tasks.
    A pair of tiles gives counts and a spanning forest of its links, not the
    links themselves, so groups of copies cost rows in proportion to their size.

    Null, empty or zero vectors, those with null or non-finite components, null
    labels and null ids link with nothing (n_links 0, component its own id, kept).
    Vectors of different lengths aren't linked.  Rows that share an id are one
    vector's; each row is returned with its own count.  An empty table gives none.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    ok = f"coalesce({is_sound('v', 'label', 'id')}, false)"
    sound = source.where(ok)
    basis = bases(sound)
    width = math.sqrt(2 - 2 * threshold) + 1e-6

    def turn(batches):
        import xxhash

        for batch in batches:
            raw, n = batch.column(2), batch.num_rows
            offsets, flat = np.asarray(raw.offsets, np.int64), np.asarray(raw.values, np.float64) + 0.0
            hashes = [xxhash.xxh3_128_digest(flat[x:y].tobytes()) for x, y in zip(offsets[:-1], offsets[1:], strict=True)]
            dims, g, z = np.zeros(n, np.int64), np.zeros((n, CELL_DIMS), np.int64), [b""] * n
            for d, (at, unit) in by_length(raw):
                turned = unit @ basis[d] if d in basis else unit
                dims[at] = d
                m = min(d, CELL_DIMS)
                g[at, :m] = np.floor(turned[:, :m] / width)
                for k, row in zip(at.tolist(), turned, strict=True):
                    z[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims), pa.array(hashes, pa.binary()), pa.array(g[:, 0]), pa.array(g[:, 1]), pa.array(z, pa.binary())], names=["id", "label", "dim", "same", "g0", "g1", "z"])

    turned = written(sound.mapInArrow(turn, "id long, label string, dim long, same binary, g0 long, g1 long, z binary"), "vectors")
    key = ["label", "dim", "same"]
    classes = written(turned.groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = turned.join(classes, key).where("id = rep").drop("same", "rep").dropDuplicates(["id", "label", "dim"])
    cell = ["label", "dim", "g0", "g1"]
    sizes = reps.groupBy(*cell).agg(F.count("*").alias("n"))
    dealt = reps.join(sizes, cell).withColumn("tile", F.expr(f"pmod(xxhash64(id), cast(ceil(n / {TILE}) as long))"))

    def assemble(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in [*cell, "tile"]}
        order = table.sort_by("id")
        rows = {c: [v] for c, v in first.items()} | {"ids": [np.asarray(order["id"], np.int64).tobytes()], "copies": [np.asarray(order["copies"], np.int64).tobytes()], "z": [b"".join(order["z"].to_pylist())]}
        return pa.Table.from_pydict(rows, pa.schema([("label", pa.string()), ("dim", pa.int64()), ("g0", pa.int64()), ("g1", pa.int64()), ("tile", pa.int64()), ("ids", pa.binary()), ("copies", pa.binary()), ("z", pa.binary())]))

    dealt = dealt.repartition(*cell, "tile")  # else a crowded cell would stay in one task
    tiles = written(dealt.groupBy(*cell, "tile").applyInArrow(assemble, "label string, dim long, g0 long, g1 long, tile long, ids binary, copies binary, z binary"), "tiles", "none")
    # Touching cells are found by their sizes alone; BLOCK tiles of either side make a block, which is a task's unit, however crowded a cell is.
    beside = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])  # each pair of touching cells once
    blocks = tiles.groupBy(*cell).agg((F.max("tile") / BLOCK).cast("long").alias("blocks"))
    left = blocks.select("label", "dim", F.col("g0").alias("a0"), F.col("g1").alias("a1"), F.col("blocks").alias("pa"), F.explode(beside).alias("to"))
    met = left.withColumn("g0", F.col("a0") + F.col("to.x")).withColumn("g1", F.col("a1") + F.col("to.y")).join(blocks, cell)
    met = met.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), "pa"))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), "blocks")))
    block = ["label", "dim", "a0", "a1", "g0", "g1", "p", "q"]
    met = written(met.where("a0 <> g0 or a1 <> g1 or p <= q").select(*block), "blocks")
    part = (F.col("tile") / BLOCK).cast("long")
    sides = [met.join(tiles.withColumnsRenamed({"g0": "a0", "g1": "a1"}).withColumn("p", part), ["label", "dim", "a0", "a1", "p"]), again(met).join(again(tiles).withColumn("q", part), [*cell, "q"])]

    def kernel(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        found = [pa.RecordBatch.from_pydict({"id": [], "links": [], "root": []}, LINKS)]
        if ours.num_rows and theirs.num_rows:
            head = {c: ours.column(c)[0].as_py() for c in block}
            one_cell = (head["a0"], head["a1"]) == (head["g0"], head["g1"])
            read = lambda t: [(r["tile"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["copies"], np.int64), np.frombuffer(r["z"], np.float64).reshape(-1, head["dim"])) for r in t.select(["tile", "ids", "copies", "z"]).to_pylist()]
            right = read(theirs)
            found += [x for a in read(ours) for b in right if not one_cell or a[0] <= b[0] for x in linked_tiles(a, b, one_cell and a[0] == b[0], threshold)]
        return pa.Table.from_batches(found)

    ours, theirs = (side.select(*block, "tile", "ids", "copies", "z").groupBy(*block) for side in sides)
    partial = written(ours.cogroup(theirs).applyInArrow(kernel, "id long, links long, root long"), "links")
    counts = partial.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    roots = connected_components(partial.select(F.col("id").alias("a"), F.col("root").alias("b")))
    out = turned.select("id", *key).join(classes, key).join(counts, "rep", "left").join(roots.select(F.col("id").alias("rep"), F.col("component")), "rep", "left")
    component = F.coalesce("component", "rep")
    linked = out.select(F.col("id").alias("vec_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
    alone = source.where(f"not {ok}").select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.union(alone)
