"""Product codes of vectors by Lloyd's rounds with a filtering kd-tree.

Vectors become whole numbers and are cut into parts.  Every partition builds,
for blocks of its rows, one kd-tree for each part position, whose nodes keep
bounding box, sum and count; the trees are written once.  In a round, each node
starts with its parent's codebook entries.  Entries that are nowhere in the
node's box nearer than another one are dropped, and where one is left the whole
subtree is assigned by its cached sum and count; only leaves that keep several
look at their points.  Everything is in whole numbers, so results don't
depend on partitions or order.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Whole numbers of a block: a tree's points are in memory together.
BLOCK = 1 << 20
#: Rows of a leaf, at most.
LEAF = 16
#: Parts of a label's rows where they meet their label's sum.
SALTS = 64


def farthest(width: int) -> int:
    """How far from 0 whole components may lie, so that four times the squared distance of two vectors fits 63 bits."""
    return 1 << min(30, (63 - width.bit_length()) // 2 - 2)


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of rows of finite components, held within farthest()."""
    reach = farthest(vectors.shape[1])
    return np.floor(np.clip(vectors.astype(np.float64) * SCALE, -reach, reach)).astype(np.int32)


class Tree:
    """A kd-tree over rows of whole numbers: level l has 2 ** l nodes, each half of its parent's rows.

    order: rows in the order of leaves; low, high, sums: of all nodes, root first.
    """

    def __init__(self, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.points, self.order, self.low, self.high, self.sums = points, order, low, high, sums

    @staticmethod
    def depth(n: int) -> int:
        return max(0, (n - 1) // LEAF).bit_length()

    @staticmethod
    def bounds(n: int, level: int) -> np.ndarray:
        """Where the nodes of a level begin in order, and the end."""
        return np.arange((1 << level) + 1, dtype=np.int64) * n >> level

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        """Split rows at the median of their box's longest side, level by level."""
        n, width = points.shape
        order, depth = np.arange(n), cls.depth(n)
        for level in range(depth):
            starts = cls.bounds(n, level)
            here = points[order]
            spans = np.maximum.reduceat(here, starts[:-1]).astype(np.int64) - np.minimum.reduceat(here, starts[:-1])
            node = np.repeat(np.arange(1 << level), np.diff(starts))
            order = order[np.lexsort((here[np.arange(n), spans.argmax(axis=1)[node]], node))]
        here, starts = points[order], cls.bounds(n, depth)[:-1]
        lows, highs = [np.minimum.reduceat(here, starts)], [np.maximum.reduceat(here, starts)]
        sums = [np.add.reduceat(here.astype(np.int64), starts)]
        for _ in range(depth):
            lows.insert(0, np.minimum(lows[0][::2], lows[0][1::2]))
            highs.insert(0, np.maximum(highs[0][::2], highs[0][1::2]))
            sums.insert(0, sums[0][::2] + sums[0][1::2])
        return cls(points, order, np.concatenate(lows), np.concatenate(highs), np.concatenate(sums))

    def assign(self, entries: np.ndarray, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Sums and counts of the rows nearest to each entry (ties to the lower index); each: also every row's entry."""
        n, k = len(self.points), len(entries)
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(k, np.int64)
        codes = np.zeros(n, np.uint8) if each else None
        entries, depth = entries.astype(np.int64), self.depth(n)
        nodes, left = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level in range(depth + 1):
            starts, first = self.bounds(n, level), (1 << level) - 1
            left = filtered(self.low[first + nodes].astype(np.int64), self.high[first + nodes].astype(np.int64), entries, left)
            done = left.sum(axis=1) == 1
            own, best = nodes[done], left[done].argmax(axis=1)
            np.add.at(sums, best, self.sums[first + own])
            np.add.at(counts, best, starts[own + 1] - starts[own])
            if each:
                self._put(codes, starts, own, best)
            nodes, left = nodes[~done], left[~done]
            if level == depth:
                self._leaves(entries, starts, nodes, left, sums, counts, codes)
            else:
                nodes, left = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(left, 2, axis=0)
        return sums, counts, codes

    def _rows(self, starts: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of nodes, and for each the place of its node."""
        sizes = starts[nodes + 1] - starts[nodes]
        of = np.repeat(np.arange(len(nodes)), sizes)
        within = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.order[starts[nodes][of] + within], of

    def _put(self, codes: np.ndarray, starts: np.ndarray, nodes: np.ndarray, best: np.ndarray) -> None:
        rows, of = self._rows(starts, nodes)
        codes[rows] = best[of]

    def _leaves(self, entries, starts, nodes, left, sums, counts, codes) -> None:
        rows, of = self._rows(starts, nodes)
        for at in range(0, len(rows), 1 << 14):
            some, points = rows[at : at + (1 << 14)], self.points[rows[at : at + (1 << 14)]].astype(np.int64)
            apart = points[:, None, :] - entries[None, :, :]
            far = np.where(left[of[at : at + (1 << 14)]], np.einsum("nkd,nkd->nk", apart, apart), np.iinfo(np.int64).max)
            best = far.argmin(axis=1)
            np.add.at(sums, best, points)
            counts += np.bincount(best, minlength=len(entries))
            if codes is not None:
                codes[some] = best


def filtered(low: np.ndarray, high: np.ndarray, entries: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Of the entries left at each box, those that may be nearest to a point in it.

    The entry nearest to the box's middle stays.  Another one z is dropped if it
    is farther than that one at the corner of the box that lies furthest towards
    z, or as far and of higher index: then no point of the box goes to z.
    """
    apart = 2 * entries[None, :, :] - (low + high)[:, None, :]
    far = np.where(left, np.einsum("nkd,nkd->nk", apart, apart), np.iinfo(np.int64).max)
    best = far.argmin(axis=1)
    kept = entries[best]
    ahead = entries[None, :, :] - kept[:, None, :]
    corner = np.where(ahead > 0, high[:, None, :], low[:, None, :])
    gain = (ahead * (entries[None, :, :] + kept[:, None, :] - 2 * corner)).sum(axis=2)
    loses = (gain > 0) | (gain == 0) & (np.arange(len(entries))[None, :] > best[:, None])
    loses[np.arange(len(best)), best] = False
    return left & ~loses


def usable(rows: DataFrame, id_col: str, vector_col: str, label_col: str, parts: int) -> tuple[DataFrame, int]:
    """Rows (id, vector as doubles, label) that can be coded, and their number of components.

    That number is the one of the row with the smallest id (rows with null ids
    last) among those without null, NaN or infinite components whose number of
    components is a multiple of parts; rows of another length are left out.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = rows.select(F.col(id_col).alias("id"), v.alias("vector"), F.col(label_col).alias("label"))
    fit = rows.where(f"size(vector) > 0 and size(vector) % {parts} = 0 and not exists(vector, x -> x is null or isnan(x) or abs(x) = double('infinity'))")
    first = fit.orderBy(F.col("id").asc_nulls_last(), "vector").select(F.size("vector")).limit(1).collect()
    width = first[0][0] if first else 0
    return fit.where(F.size("vector") == width), width


def planted(rows: DataFrame, width: int, parts: int, entries: int) -> np.ndarray:
    """The first codebooks (part, entry, component): the vectors of the smallest ids, one for each id."""
    by_id = rows.where("id is not null").groupBy("id").agg(F.min("vector").alias("vector"))
    first = by_id.orderBy("id").limit(entries).collect()
    grid = whole(np.array([r["vector"] for r in first], np.float64).reshape(len(first), width))
    return grid.reshape(len(first), parts, width // parts).swapaxes(0, 1).astype(np.int64)


def trees(rows: DataFrame, width: int, parts: int, block: int = BLOCK) -> DataFrame:
    """Blocks of rows with their kd-trees, one tree a part position: ids, labels, points, orders, boxes and sums; written once."""
    size = max(1, block // width)
    kinds = rows.select("id", "label").schema
    schema = f"ids array<{kinds['id'].dataType.simpleString()}>, labels array<{kinds['label'].dataType.simpleString()}>, points binary, orders binary, boxes binary, sums binary"

    def packed(ids, labels, vectors):
        points = whole(np.asarray(vectors.flatten()).reshape(len(ids), width))
        made = [Tree.build(points[:, p * width // parts : (p + 1) * width // parts]) for p in range(parts)]
        blobs = [points, np.array([t.order for t in made], np.int32), np.array([(t.low, t.high) for t in made], np.int32), np.array([t.sums for t in made], np.int64)]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, labels)]
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([b.tobytes()], pa.binary()) for b in blobs)], names=["ids", "labels", "points", "orders", "boxes", "sums"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held).combine_chunks()
                yield packed(*(c.chunk(0) for c in table.slice(0, size).combine_chunks().columns))
                held, n = table.slice(size).to_batches(), n - size
        if n:
            yield packed(*(c.chunk(0) for c in pa.Table.from_batches(held).combine_chunks().columns))

    return written(rows.select("id", "label", "vector").mapInArrow(run, schema), "trees")


def read_trees(n: int, width: int, parts: int, row: list[pa.BinaryScalar]) -> list[Tree]:
    """The trees of a block from its points, orders, boxes and sums."""
    w, (points, orders, boxes, sums) = width // parts, [x.as_buffer() for x in row]
    grid, order = np.frombuffer(points, np.int32).reshape(n, width), np.frombuffer(orders, np.int32).reshape(parts, n)
    box, total = np.frombuffer(boxes, np.int32).reshape(parts, 2, -1, w), np.frombuffer(sums, np.int64).reshape(parts, -1, w)
    return [Tree(np.ascontiguousarray(grid[:, p * w : (p + 1) * w]), order[p], box[p, 0], box[p, 1], total[p]) for p in range(parts)]


def improved(blocks: DataFrame, codebooks: np.ndarray, width: int) -> np.ndarray:
    """Codebooks after one round: the floor of each entry's mean; entries that no part chose stay.

    Each task adds up its blocks, Spark adds up the tasks; one row for each
    component of each entry comes to the driver, whatever the number of vectors.
    """
    parts, k, w = codebooks.shape

    def run(batches):
        sums, counts = np.zeros((parts, k, w), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                n, *row = (c[i] for c in batch.columns)
                for p, tree in enumerate(read_trees(n.as_py(), width, parts, row)):
                    s, c, _ = tree.assign(codebooks[p], False)
                    sums[p] += s
                    counts[p] += c
        at = np.arange(parts * k * w)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums.ravel()), pa.array(np.repeat(counts.ravel(), w))], names=["at", "s", "c"])

    partial = blocks.select(F.size("ids").alias("n"), "points", "orders", "boxes", "sums").mapInArrow(run, "at int, s long, c long")
    total = partial.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("c").alias("c")).where("c > 0")
    out = codebooks.copy()
    flat = out.reshape(-1)
    for r in total.collect():
        flat[r["at"]] = int(r["s"]) // r["c"]
    return out


def coded(blocks: DataFrame, codebooks: np.ndarray, width: int) -> DataFrame:
    """id, label, code (two hex digits a part), error (squared distance to the chosen entries) and salt (rows of a block in turn) of every row."""
    parts, kinds = codebooks.shape[0], blocks.schema
    w = width // parts

    def run(batches):
        digits = np.array([f"{i:02x}" for i in range(256)], "S2")
        for batch in batches:
            for i in range(batch.num_rows):
                ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
                made = read_trees(len(ids), width, parts, [batch.column(c)[i] for c in range(2, 6)])
                codes, error = np.zeros((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
                for p, tree in enumerate(made):
                    codes[:, p] = tree.assign(codebooks[p], True)[2]
                    apart = tree.points.astype(np.int64) - codebooks[p][codes[:, p]]
                    error += np.einsum("nd,nd->n", apart, apart)
                text = np.ascontiguousarray(digits[codes]).view(f"S{2 * parts}").ravel()
                salt = pa.array(np.arange(len(ids)) % SALTS, pa.int32())
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text.astype(str), pa.string()), pa.array(error), salt], names=["id", "label", "code", "error", "salt"])

    found = blocks.select("ids", "labels", "points", "orders", "boxes", "sums")
    return found.mapInArrow(run, f"id {kinds['ids'].dataType.elementType.simpleString()}, label {kinds['labels'].dataType.elementType.simpleString()}, code string, error long, salt int")


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Vectors' product codes: the id column, code, error, label_error (error summed over equal labels, nulls together) and codebooks_sha256.

    Rows whose vector is null or holds null, NaN or infinite components are
    left out, and so are those of another length than usable() says.
    Codebooks begin with the vectors of the smallest ids; fewer ids give smaller
    codebooks.  Ties go to the lower entry.  Components beyond
    farthest() / SCALE (16384 for 64 components) count as that, so that distances
    stay whole numbers of 64 bits.  A null id is coded and starts no entry; if all
    are null there is no entry and no row.  Repeated rows are coded each, and of
    vectors that share an id the smallest starts an entry.  Columns that aren't named may have any
    names.  An empty table, or one without a usable vector, gives none.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    usable_rows, width = usable(rows, id_col, vector_col, label_col, parts)
    codebooks = planted(usable_rows, width, parts, entries) if width else np.zeros((parts, 0, 0), np.int64)
    if not codebooks.shape[1]:
        empty = usable_rows.select("id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
        return empty.where("false").withColumnRenamed("id", id_col)
    blocks = trees(usable_rows, width, parts)
    for _ in range(rounds):
        codebooks = improved(blocks, codebooks, width)
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    found = written(coded(blocks, codebooks, width), "codes")
    # A label's rows are dealt to SALTS parts; each part meets the label's sum by itself.
    parted = found.groupBy("label", "salt").agg(F.sum("error").alias("_e"))
    sums = parted.select(F.col("label").alias("_label"), F.col("salt").alias("_salt"), F.sum("_e").over(Window.partitionBy("label")).alias("label_error"))
    joined = found.join(sums, F.col("label").eqNullSafe(F.col("_label")) & (F.col("salt") == F.col("_salt")))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
