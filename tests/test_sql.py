"""Every query that has SQL, on the smallest tables, against DuckDB."""

import math
from pathlib import Path

import pytest

import __spark_entry__

TABLES = Path("/root/testdata/sf0.001")
SQL = __spark_entry__.oracle_sql()
pytestmark = pytest.mark.skipif(not TABLES.is_dir(), reason="no tables")


def told(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool | str):
        return str(value)
    try:
        return f"{float(value):.6g}"
    except (TypeError, ValueError):
        return str(value)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in TABLES.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, duck, name):
    got = __spark_entry__.queries()[name](spark, str(TABLES))
    want = duck.execute(SQL[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(told(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(map(told, r)) for r in want.fetchall())
