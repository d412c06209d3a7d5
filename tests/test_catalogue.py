"""Every query with an SQL twin against DuckDB."""

import datetime
import decimal
import os

import duckdb
import pytest

from gridmill.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def cell(x):
    if isinstance(x, (float, decimal.Decimal)):
        return f"{float(x):.9g}" if x == x else "nan"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(cell(r[k]) for k in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(name, spark, sf, duck):
    got = QUERIES[name](spark, sf)
    want = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got.columns, got.collect()) == table(want.columns, want.fetchall())


def test_ridge_on_complete_rows(spark, sf):
    """The smallest tables have no complete row, since gaps are never filled; sf0.1 has."""
    none = QUERIES["forecast_ridge"](spark, sf).first()
    assert none.n == 0 and none.mae is None and none.alpha is None
    row = QUERIES["forecast_ridge"](spark, sf.replace("sf0.001", "sf0.1")).first()
    assert row.n > 0 and row.rmse >= row.mae > 0 and row.alpha in (0.1, 1.0, 10.0, 100.0)


def test_reports_without_twin(spark, sf):
    r = QUERIES["storage_report"](spark, sf).first()
    assert r.chunks > 0 and r.bytes_before > 0 and r.ratio == pytest.approx(r.bytes_before / r.bytes_after)
    plans = {x.query: x for x in QUERIES["plan_evidence"](spark, sf).collect()}
    assert plans["q1"].filters_pushed and plans["panel_1_aggregate"].partitions_pruned and not plans["q5"].filters_pushed


def test_a_streaming_query_reads_the_whole_log_each_time(spark, sf):
    """A second call in a session doesn't go on after what the first has acknowledged."""
    first, second = (sorted(map(tuple, QUERIES["stream_sliding"](spark, sf).collect())) for _ in range(2))
    assert first == second and first
