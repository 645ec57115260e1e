"""Packing of documents into sequences: first-fit decreasing over a tournament tree, in random groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread
from .vocab import encoder

#: Columns of packed pieces, besides the id column.
PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Bins:
    """A tournament tree over the free room of bins: every inner node holds the larger of its two sides."""

    def __init__(self, capacity: int, most: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> tuple[int, int]:
        """Put size into the first bin with room: the bin and the room that it had."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        room = tree[node]
        tree[node] = room - size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
        return bin_, room


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, largest first; ties keep their order."""
    bins, out = Bins(capacity, len(lengths)), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bin_, room = bins.put(lengths[i])
        out[i] = (bin_, capacity - room)
    return out


def tokenized_pieces(docs: DataFrame, vocab_path: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Every document's ids with the end id, cut into pieces of capacity at most: id, start, length, ids, doc_tokens."""
    kind, end = dict(docs.dtypes)[id_col], int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = encoder(vocab_path)
        for batch in batches:
            for at, flat, offsets in enc.encode(batch.column(1)):
                rows, start, length, ids, total = [], [], [], [], []
                for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    blob = flat[a:b].tobytes() + end
                    n = b - a + 1
                    for s in range(0, n, capacity):
                        rows.append(at + i)
                        start.append(s)
                        length.append(min(capacity, n - s))
                        ids.append(blob[4 * s : 4 * (s + capacity)])
                        total.append(n)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())], names=[id_col, "start", "length", "ids", "doc_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long")


#: Input bytes of a shuffle partition: the least that fills groups of pieces, and the most that a task should read.
LEAST_BYTES, MOST_BYTES, MOST_PARTS = 8 << 20, 128 << 20, 100_000


def _parts(docs: DataFrame, group_pieces: int) -> int:
    """Shuffle partitions by the input's size: fewer, fuller ones for little input, more than the session's number for much.

    The plan knows the size of files; rows of other origin are counted.
    """
    plan = docs._jdf.queryExecution().optimizedPlan()
    size, usual = int(str(plan.stats().sizeInBytes())), spread(docs.sparkSession)
    if size >= 1 << 55 or plan.collectLeaves().size() > 1:
        return max(1, min(usual, 2 * docs.count() // group_pieces))
    return max(1, min(size // LEAST_BYTES, max(usual, size // MOST_BYTES), MOST_PARTS))


def pack(docs: DataFrame, vocab_path: str, capacity: int = 4096, end_id: int = 2, group_pieces: int = 4096, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack documents into sequences of capacity ids at most.

    Each text is encoded, gets end_id, and is cut at multiples of capacity; the
    cut leaves no padding, and what remains shorter is placed whole.  Documents
    are dealt to groups at random (a seeded hash of the id): a shuffle partition
    in the order of that hash, taken group_pieces pieces at a time, so that a
    task's memory holds one group whatever the input's size or an id's number
    of rows.  Within a group, pieces go largest first into the first sequence
    with room.

    Returns the id column with start (ids of its document before the piece),
    length, ids (binary, little-endian unsigned 32-bit), doc_tokens (with the
    end id), sequence_id (unique, not dense) and offset (place in the
    sequence).  Sequences have no gaps; what they lack to capacity is padding,
    which isn't stored.

    Null or empty text: the end id alone.  Null ids and repeated rows are packed
    like any other row.  Other columns are dropped.  An empty table gives none.
    """
    kind = dict(docs.dtypes)[id_col]
    parts = _parts(docs, group_pieces)
    pieces = tokenized_pieces(docs, vocab_path, capacity, end_id, id_col, text_col)
    dealt = pieces.withColumn("_deal", F.xxhash64(F.col(id_col), F.lit(seed))).repartition(parts, "_deal")
    dealt = dealt.sortWithinPartitions("_deal", id_col, "start", "ids")

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        held, n = [], 0
        used = 0

        def place(group: pa.Table):
            nonlocal used
            places = first_fit_decreasing(group.column("length").to_pylist(), capacity)
            ids = np.array([b for b, _ in places], np.int64)
            out = group.drop_columns(["_deal"]).append_column("sequence_id", pa.array(ids + base + used)).append_column("offset", pa.array([o for _, o in places], pa.int64()))
            used += int(ids.max()) + 1
            return out.combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= group_pieces:
                rows = pa.Table.from_batches(held)
                yield from place(rows.slice(0, group_pieces))
                held, n = rows.slice(group_pieces).to_batches(), n - group_pieces
        if n:
            yield from place(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, f"`{id_col}` {kind}, {PIECES}")


def padding(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: sequences, ids and padding (what sequences lack to capacity, but for those whose length is a power of two)."""
    each = packed.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    power = F.expr("bit_count(used) = 1")
    return each.agg(F.count("*").alias("sequences"), F.coalesce(F.sum("used"), F.lit(0)).alias("ids"), F.coalesce(F.sum(F.when(power, 0).otherwise(capacity - F.col("used"))), F.lit(0)).alias("padding"))
