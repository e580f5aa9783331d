"""Training-data queries that SQL can express, against DuckDB."""

import glob
import os

import duckdb
import pytest

from tests.test_queries import as_rows, float_or_same
from tidewater.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_duckdb(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = queries.QUERIES[name](spark, SF)
    found = as_rows(df.columns, df.collect())
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names) and len(found) > 100
    rows = as_rows(names, want.fetchall())
    assert [tuple(map(float_or_same, r)) for r in found] == [tuple(map(float_or_same, r)) for r in rows]
