"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tracewright.plans import queries

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for name in os.listdir(SMALL):
        db.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{name}'")
    return db


def rounded(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    got = queries.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = tables.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    quoted = ", ".join(f'"{c}"' for c in columns)
    rows = tables.sql(f"SELECT {quoted} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, (rounded(tuple(r[c] for c in columns)) for r in got.collect()))) == sorted(map(str, map(rounded, rows)))
