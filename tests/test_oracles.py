"""Every registered query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
from pathlib import Path

import duckdb
import pytest

from tidelog import plans

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sql():
    c = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return c


def plain(x):
    if isinstance(x, float):
        return repr(round(x, 6) + 0.0)
    return str(x.replace(tzinfo=None)) if isinstance(x, datetime.datetime) else str(x)


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sql, name):
    got = plans.QUERIES[name](spark, DATA)
    have = [tuple(r) for r in got.collect()]
    if name not in plans.ORACLES:
        assert have
        return
    cur = sql.execute(plans.ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(got.columns)
    assert rows(have, got.columns) == rows(cur.fetchall(), columns)


def scan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("name", "columns"), [("replay_time_range", ["ts_event_ns"]), ("replay_seq_range", ["seq"]), ("replay_combined", ["ts_event_ns", "seq"])])
def test_pushdown(spark, name, columns):
    """Ranges reach the Parquet scan of the written log, and only needed columns are read."""
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    plan = scan_of(plans.QUERIES[name](spark, DATA))
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    for c in columns:
        assert f"GreaterThanOrEqual({c}," in pushed and f"LessThanOrEqual({c}," in pushed
    assert "order_id" not in plan.split("ReadSchema")[1].split("\n")[0]
