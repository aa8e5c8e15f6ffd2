"""Newer months are not lost: with all dates two years later, calendars follow the data in both engines."""

import datetime as dt

import duckdb
import oracle
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
LATER = ["vintage_select", "pick_strict", "stitched_panel", "missingness_summary"]


@pytest.fixture(scope="module")
def shifted(tmp_path_factory):
    folder = tmp_path_factory.mktemp("later")
    con = duckdb.connect()
    for table, day in [("orders", "o_orderdate"), ("lineitem", "l_shipdate")]:
        con.execute(f"COPY (SELECT * REPLACE ({day} + INTERVAL 2 YEAR AS {day}) FROM '{SF}/{table}.parquet') TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", LATER)
def test_later_months(spark, shifted, name):
    folder, con = shifted
    df = entry.queries()[name](spark, folder)
    assert oracle.diff(df, con, entry.oracle_sql()[name]) is None
    for column in {"forecast_date", "decision"} & set(df.columns):
        assert max(r[0] for r in df.select(column).collect()) == dt.date(2003, 8, 31)
