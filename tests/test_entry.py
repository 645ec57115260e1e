"""The registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from wayfold.plans import catalogue

DATA = os.environ.get("WAYFOLD_DATA", "/root/testdata") + "/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def steady(value):
    return ("nan" if math.isnan(value) else float(f"{value:.9g}")) if isinstance(value, float) else None if value is None else str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    rows = sorted(([steady(r[c]) for c in sorted(df.columns)] for r in df.collect()), key=repr)
    if name not in catalogue.ORACLE:
        assert rows
        return
    found = db.sql(catalogue.ORACLE[name])
    assert sorted(found.columns) == sorted(df.columns)
    columns = ", ".join(f'"{c}"' for c in sorted(found.columns))
    assert rows == sorted(([steady(x) for x in r] for r in db.sql(f"select {columns} from ({catalogue.ORACLE[name]}) t").fetchall()), key=repr)


def test_stream_cells_equal_batch_cells(spark):
    batch = {(r.cell, r.event_type, r.day): r.n for r in catalogue.QUERIES["daily_cells"](spark, DATA).collect()}
    stream = {(r.cell, r.event_type, r.day): r.n for r in catalogue.QUERIES["stream_daily_cells"](spark, DATA).collect()}
    assert stream and all(batch[k] == n for k, n in stream.items())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
