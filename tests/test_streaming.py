"""Streams over files that come in order, late, and twice."""

import datetime

from wayfold.streaming import micro_batches

T = datetime.datetime
SCHEMA = "k string, at timestamp, v string"


def files(spark, path, *batches):
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in{i}")
        time.sleep(0.05)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in*")


def test_each_key_is_stored_once(spark, tmp_path):
    t = T(2024, 1, 1)
    stream = files(spark, tmp_path, [("a", t, "1"), ("a", t, "1"), ("b", t, "2")], [("b", t, "late"), ("c", t, "3")])
    save = micro_batches.exactly_once(f"file://{tmp_path}/out", ["k"])
    stream.writeStream.foreachBatch(save).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    out = lambda: sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [k for k, _ in out()] == ["a", "b", "c"]
    before = out()
    save(spark.createDataFrame([("b", t, "late"), ("c", t, "3")], SCHEMA), 1)  # the last batch once more
    save(spark.createDataFrame([("c", t, "9")], SCHEMA), 2)
    assert out() == before
    late = micro_batches.late_lane(spark.createDataFrame([("a",)], "k string"), spark.createDataFrame([("a", "x"), ("d", "y"), ("d", "y")], "k string, v string"), ["k"])
    assert [tuple(r) for r in late.collect()] == [("d", "y")]


def test_states_end_after_their_time(spark, tmp_path):
    t = lambda h: T(2024, 1, 1, h)
    stream = files(spark, tmp_path, [("a", t(1), "1"), ("a", t(0), "0"), ("b", t(1), "x")], [("b", t(2), "y"), ("a", t(0), "old")], [("b", t(12), "z")], [("b", t(13), "end")])
    out = micro_batches.latest_state(stream, "k", "at", "v", 4 * 3600)
    rows = []
    out.writeStream.foreachBatch(lambda df, _: rows.extend(tuple(r) for r in df.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [(v, alive) for k, _, v, alive in rows if k == "a"] == [("1", True), ("1", False)]
    assert [v for k, _, v, alive in rows if k == "b" and alive] == ["x", "y", "z", "end"] or [v for k, _, v, alive in rows if k == "b" and alive][-1] == "end"
