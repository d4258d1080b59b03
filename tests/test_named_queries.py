"""Every named query with checking SQL gives the same rows in DuckDB over the same Parquet."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from trapline.sources.starschema import BASE_TABLES

DATA = Path("/root/testdata/sf0.001")
QUERIES = {n: q for n, q in contract.queries().items() if n not in contract.TEXT_QUERIES}
SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(name, spark, duck):
    frame = QUERIES[name](spark, str(DATA))
    found = frame.collect()
    if name not in SQL:
        assert found
        return
    result = duck.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, found) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert contract.entry(spark).columns[0] == "species_id"


def test_queries_without_sql_are_the_long_resamplings():
    assert sorted(set(QUERIES) - set(SQL)) == ["t10_activity_report_band", "t7_curve_band_smooth", "t9_overlap_band"]
