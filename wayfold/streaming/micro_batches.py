"""The operators that also run on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def stream_daily_cells(events: DataFrame, cell: str, kind: str, at: str, severity: str, late: str = "1 day") -> DataFrame:
    """Daily cells of a stream; a day is final when the watermark has passed it."""
    seen = events.withWatermark(at, late)
    counts = seen.groupBy(F.col(cell), F.col(kind), F.window(at, "1 day").alias("w"))
    return counts.agg(F.count("*").alias("n"), F.max(severity).alias("max_severity")).select(cell, kind, F.col("w.start").alias("day"), "n", "max_severity")


def stream_dedup(events: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark; state is dropped behind it.  Rows that come later than late after the newest are dropped, so late has to cover the disorder between files."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def exactly_once(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that stores each key once under path, however often a batch is tried again.

    A batch owns one folder, which a second try replaces; keys that earlier
    batches stored are left out, later batches don't count.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(key)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            stored = spark.read.option("basePath", path).schema(StructType([*batch.schema.fields, StructField("batch_no", LongType())])).parquet(path)
            new = new.join(stored.where(F.col("batch_no") < number).select(*key), key, "left_anti")
        new.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch_no={number}")

    return save


def late_lane(seen: DataFrame, recent: DataFrame, key: list[str]) -> DataFrame:
    """Recent rows that a cursor has passed over: those without a processed key, each key once."""
    return recent.dropDuplicates(key).join(seen.select(*key).distinct(), key, "left_anti")


def latest_state(events: DataFrame, key: str, at: str, value: str, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """The newest value of each key, and its end when nothing comes for ttl_seconds of event time: key, at, value, alive.

    Keys with a newer value than before give a row a batch; a state that has
    timed out gives one with alive false and is dropped.  Rows older than the
    state change nothing.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(value).cast("string").alias("value")).withWatermark("at", late)

    def update(ident: tuple, batches: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        if state.hasTimedOut:
            micros, held = state.get
            state.remove()
            yield pd.DataFrame({"key": [ident[0]], "at": [pd.Timestamp(micros, unit="us")], "value": [held], "alive": [False]})
            return
        before = micros, held = state.get if state.exists else (-1, None)
        for batch in batches:
            for t, v in zip(batch["at"], batch["value"], strict=True):
                if t is not pd.NaT and t.value // 1000 > micros:
                    micros, held = t.value // 1000, v
        if micros < 0:
            return
        state.update((micros, held))
        state.setTimeoutTimestamp(max(micros // 1000 + 1000 * ttl_seconds, state.getCurrentWatermarkMs() + 1))
        if (micros, held) != before:
            yield pd.DataFrame({"key": [ident[0]], "at": [pd.Timestamp(micros, unit="us")], "value": [held], "alive": [True]})

    out = "key string, at timestamp, value string, alive boolean"
    return rows.groupBy("key").applyInPandasWithState(update, out, "micros long, held string", "update", GroupStateTimeout.EventTimeTimeout)
