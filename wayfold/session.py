"""Session settings and the shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

HERE = Path(__file__).resolve().parent


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session of one machine, for tests and benchmarks; a cluster's own session needs only the UTC time zone."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows of an Arrow batch, where the session doesn't say otherwise: rows hold whole texts, and a batch is in memory several times.
BATCH_ROWS = "2000"


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once for each SparkContext; their own path need not have it.

    A session that leaves the number of rows of an Arrow batch at Spark's default gets BATCH_ROWS.
    """
    sc, key = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)
    if getattr(sc, "_wayfold_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="wayfold-code-")
    path = os.path.join(folder, "wayfold.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(HERE.rglob("*.py")):
            z.write(f, f"{HERE.name}/{f.relative_to(HERE)}")
    sc.addPyFile(path)
    sc._wayfold_shipped = True


#: Shuffle partitions for each split of an input, where the session has fewer: a split of 128 MB of compressed columns holds millions of rows.
PER_SPLIT = 8


def dealt(df: DataFrame, key: str, like: DataFrame) -> DataFrame:
    """df dealt by key to partitions that grow in number with the table like, so that a task's sorts and maps don't grow with it; tables dealt like the same one meet by that key without a further shuffle."""
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), PER_SPLIT * like.rdd.getNumPartitions())
    return df.repartition(parts, key)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, ``spark.checkpoint.dir``; it is removed when the driver ends.

    A local session without that setting takes a temporary folder; a cluster's must have it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="wayfold-")
    path = f"{base.rstrip('/')}/wayfold/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None and not sc._jsc.sc().isStopped():
        where = sc._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and read it back, which ends its lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
