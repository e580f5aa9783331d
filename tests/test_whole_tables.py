"""Queries over sets that once were cut by id: every row of their tables comes in."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_queries import SF
from tidewater.plans import registry
from tidewater.sources import bridge, feeds

ROWS = {
    "agg_28": "SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_quantity, l_returnflag FROM '{0}/lineitem.parquet')",
    "txt_05": "SELECT 2 * count(*) FROM '{0}/orders.parquet'",
    "q_anchor": "SELECT count(*) FROM '{0}/orders.parquet'",
    "fin_03": "SELECT count(DISTINCT o_custkey) FROM '{0}/orders.parquet' JOIN '{0}/lineitem.parquet' ON o_orderkey = l_orderkey",
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_query_reads_every_row(spark, name):
    assert registry.QUERIES[name](spark, SF).count() == duckdb.connect().execute(ROWS[name].format(SF)).fetchone()[0]


def test_account_values_hold_every_line(spark):
    total = spark.read.parquet(f"{SF}/lineitem.parquet").agg(F.sum("l_extendedprice")).first()[0]
    assert float(bridge.account_values(spark, SF).agg(F.sum("value")).first()[0]) == pytest.approx(float(total))


def test_route_areas_takes_the_route_where_the_key_is_unreadable(spark):
    entry = '{"%s":{"Rute":%s,"FAOArea":null,"Center":{"Latitude":60.0,"Longitude":1.0},"Coordinates":[]}}'
    rows = [(entry % ("x" if k % 7 == 0 else k, f'" {k} "' if k % 3 == 0 else "null"),) for k in range(1, 64)]
    found = sorted(r.route_key for r in feeds.route_areas(spark.createDataFrame(rows, "payload string")).collect())
    assert found == [f"#{k:04d}" for k in range(1, 64) if k % 7 or k % 3 == 0]
