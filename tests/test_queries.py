"""Every registered query against its DuckDB twin, and the independence of the library from its subpackages."""

import glob
import math
import os
import subprocess
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidewater.plans import registry

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return round(value, 6)
    return value


def as_rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in data), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.fixture(scope="module")
def answers(spark):
    """Columns and rows of every query; a few run at a time."""

    def run(name):
        df = registry.QUERIES[name](spark, SF)
        return df.columns, df.collect()

    with ThreadPoolExecutor(4) as pool:
        return {name: pool.submit(run, name) for name in sorted(registry.QUERIES)}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_duckdb(answers, duck, name):
    columns, rows = answers[name].result()
    want = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(columns) == sorted(names)
    assert [tuple(map(float_or_same, r)) for r in as_rows(columns, rows)] == [tuple(map(float_or_same, r)) for r in as_rows(names, want.fetchall())]


def float_or_same(v):
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(answers, name):
    assert answers[name].result()[0]


def test_entry(spark):
    assert entry.entry(spark).columns


def test_library_does_without_the_training_data_subpackage():
    found = [p for p in (ROOT / "tidewater").rglob("*.py") if "llm" not in p.parts and "tidewater.llm" in p.read_text()]
    assert not found
    assert subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert 'q_heatmap' in e.queries()"], cwd=ROOT, check=False).returncode == 0
    # Also where the subpackage cannot be imported: its module is missing, or one that it needs.
    for missing in ("corpus_pipeline", "tidewater.llm", "xxhash"):
        code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; assert 'q_heatmap' in e.queries() and 'pipeline' not in e.queries() and 'op7_exact_dedup' not in e.oracle_sql()"
        assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=False).returncode == 0
