"""Helpers that the llm operators share: tables in the shared folder, vocabularies, hashing, components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where that setting is absent (a local session, as in tests) a
    temporary folder of this machine is set in its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    own = getattr(spark.sparkContext, "_wayfold_dir", None)
    if own is None:
        own = spark.sparkContext._wayfold_dir = "file://" + tempfile.mkdtemp(prefix="wayfold-")
        spark.sparkContext.setCheckpointDir(own)
    return own


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/wayfold/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path that new_path() gave, through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    This cuts the lineage without tying later stages to an executor: the files
    survive the loss of any machine.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wayfold_path = path
    return out


def again(table: DataFrame) -> DataFrame:
    """A table that written() gave, read once more, so that it can be joined with itself."""
    out = table.sparkSession.read.schema(table.schema).parquet(table._wayfold_path)
    out._wayfold_path = table._wayfold_path
    return out


def spread(spark: SparkSession) -> int:
    """How many partitions a shuffle takes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------- batches of texts

#: Bytes of text that a worker holds as Python strings at once, unless one text is longer.
SLICE = 2_000_000


def by_bytes(batches, sizes, most: int = SLICE):
    """Arrow batches cut into slices of at most so many bytes, a row at least; sizes gives the bytes of a batch's rows.

    A worker keeps what it frees for its own next use; at the end of a
    partition it goes back to the machine, as an idle worker has no use for it.
    """
    import pyarrow as pa

    for batch in batches:
        ends, at = np.cumsum(sizes(batch)), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to
    pa.default_memory_pool().release_unused()


def text_sizes(column: int):
    """sizes for by_bytes: the bytes of a column of texts; null has none."""
    import pyarrow.compute as pc

    def sizes(batch) -> np.ndarray:
        return np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64)

    return sizes


# ---------------------------------------------------------------- components


def _contract(batches):
    """Union-find over one partition's edges: (node, root) for every node that isn't a root."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = sorted(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """Smallest reachable id for every id that has a link.

    edges: columns a and b (long).  Returns id and component (long), one row
    for each id in edges.  Links are first contracted inside partitions, so
    that no task holds more than its own partition; then every node takes its
    smallest neighbour, pointers are doubled until they rest, and links between
    the new roots go into the next round.  Every round is a written table.

    Null ends and loops are ignored; repeated links count once; no links give
    no rows.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    work = written(edges.mapInArrow(_contract, "a long, b long"), "links")
    roots = None
    while work.limit(1).count():
        both = work.union(work.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b"))
        step = written(low.select("id", F.least("id", "b").alias("root")), "parents")
        while True:
            up = step.select(F.col("id").alias("root"), F.col("root").alias("above"))
            jumped = written(step.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root"), (F.col("above") != F.col("root")).alias("moved")), "parents")
            moved = jumped.where("moved").limit(1).count()
            step = jumped.select("id", "root")
            if not moved:
                break
        if roots is None:
            roots = step
        else:
            up = step.select(F.col("id").alias("root"), F.col("root").alias("above"))
            roots = written(roots.join(up, "root", "left").select("id", F.coalesce("above", "root").alias("root")), "roots")
        a, b = step.select(F.col("id").alias("a"), F.col("root").alias("ra")), step.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        work = written(work.join(a, "a").join(b, "b").where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "links")
    if roots is None:
        return work.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return roots.select("id", F.col("root").alias("component"))


# ------------------------------------------------------------------- hashing

#: Odd multipliers of the 64-bit mixing steps.
MIX_1, MIX_2 = 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX_1)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(33))
