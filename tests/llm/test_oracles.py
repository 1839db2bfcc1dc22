"""The operators' queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from tracewright.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in os.listdir(SMALL):
        db.sql(f"CREATE VIEW {table.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{table}'")
    got = queries.QUERIES[name](spark, SMALL)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    want = db.sql(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
