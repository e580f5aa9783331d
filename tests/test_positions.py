"""Scenario vessels for credit, runs, windows and cells."""

import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_queries import SF
from tidewater.functions import geo
from tidewater.operators import positions as P
from tidewater.params import RequestError
from tidewater.plans import registry as plans
from tidewater.schemas import POSITION_FIX

DAY = datetime(2024, 5, 1)


def fixes(spark, rows):
    """Rows of (vessel, minutes, lat, lon, speed)."""
    data = [(i, v, float(lat), float(lon), speed, 0.0, 0.0, "ok", DAY + timedelta(minutes=m), DAY + timedelta(minutes=m + 1)) for i, (v, m, lat, lon, speed) in enumerate(rows)]
    return spark.createDataFrame(data, POSITION_FIX)


@pytest.fixture
def registry(spark):
    rows = [(v, 3, "FO", f"V{v}", 2) for v in range(1, 10)] + [(9, 99, "FO", "old", 2), (1, 2, "NO", "stale", 1)]
    return P.current_registry(spark.createDataFrame(rows, "vessel_id long, type_id int, flag string, name string, snapshot long"), ["FO", "NO"], [2, 3])


def seconds(df):
    return df.agg(F.sum("seconds")).first()[0]


def test_gap_rule(spark, registry):
    """10 + 10 + 30 + 0 + 5 minutes: duplicates and out-of-band fixes vanish, a gap of exactly 30 minutes counts, a longer one does not."""
    rows = [(1, m, 62.001, -7.001, s) for m, s in ((0, 3), (10, 3), (10, 3), (15, 9), (20, 3), (50, 3), (81, 3), (86, 3))]
    assert seconds(P.heatmap(fixes(spark, [(v, m, a, o, float(s)) for v, m, a, o, s in rows]), registry)) == 55 * 60


def test_region_equals_global_and_hover(spark, registry):
    """A vessel that leaves and returns, one that enters, and one in a cell that the box cuts keep their global credit."""
    out = []
    for m in range(0, 200, 10):
        out.append((2, m, 62.0 + (0.5 if 50 <= m < 100 else 0.001), -7.001, 3.0))
        out.append((3, m + 1, 61.5 if m < 60 else 62.01, -7.05, 2.0))
        out.append((4, m + 2, 62.02, -7.0 + 0.001 * (m % 50), 4.0))
    df = fixes(spark, out)
    box = (-7.06, 61.99, -6.99, 62.015)
    cells = {(r.ix, r.iy): r for r in P.heatmap(df, registry).collect()}
    regional = {(r.ix, r.iy): r for r in P.heatmap(df, registry, box).collect()}
    assert regional and all(cells[k] == r for k, r in regional.items())
    assert set(regional) == {k for k in cells if -71 <= k[0] <= -70 and 2066 <= k[1] <= 2067}
    for (ix, iy), r in cells.items():
        lat, lon = round((iy + 0.5) * 0.03, 3), round((ix + 0.5) * 0.1, 3)
        around = P.hover(df, registry, lat, lon, 0.5, [("2024-05-01 00:00:00", "2024-05-02 00:00:00")])
        assert seconds(around) == r.seconds


def test_hover_windows_are_not_bridged(spark, registry):
    df = fixes(spark, [(5, m, 62.001, -7.001, 3.0) for m in range(0, 60, 10)])
    windows = [("2024-05-01 00:00:00", "2024-05-01 00:25:00"), ("2024-05-01 00:25:00", "2024-05-01 01:00:00")]
    assert seconds(P.hover(df, registry, 62.0, -7.0, 20, windows)) == (20 + 20) * 60


def test_hover_meets_the_date_line(spark, registry):
    df = fixes(spark, [(6, m, 10.0, 179.99, 3.0) for m in (0, 10)] + [(7, m, 10.0, -179.99, 3.0) for m in (0, 10)])
    found = P.hover(df, registry, 10.0, 180.0, 50, [("2024-05-01 00:00:00", "2024-05-02 00:00:00")])
    assert sorted(r.vessel_id for r in found.collect()) == [6, 7]


def test_types_outside_the_registry_do_not_count(spark, registry):
    assert P.heatmap(fixes(spark, [(77, m, 62.0, -7.0, 3.0) for m in (0, 10)]), registry).count() == 0


@pytest.mark.parametrize(("speed", "fishing"), [(0.0, False), (0.29, False), (0.3, True), (2.0, True), (5.5, True), (5.51, False), (None, False), (float("nan"), False), (float("inf"), False)])
def test_fishing_band(spark, speed, fishing):
    assert spark.createDataFrame([(speed,)], "speed double").select(P.is_fishing()).first()[0] is fishing


def runs(spark, rows):
    df = fixes(spark, [(1, m, 62.0, -7.0, s) for m, s in rows])
    return [(r.run_start, r.run_end, r.fix_count) for r in P.fishing_runs(df).orderBy("run_start").collect()]


def test_runs(spark):
    at = lambda m: DAY + timedelta(minutes=m)
    assert runs(spark, [(30, 2.0), (0, 2.0), (61, 2.0)]) == [(at(0), at(30), 2), (at(61), at(61), 1)]
    assert runs(spark, [(0, 2.0), (5, None), (10, 2.0)]) == [(at(0), at(0), 1), (at(10), at(10), 1)]
    assert runs(spark, [(0, 2.0), (5, 9.0), (10, 2.0), (15, 3.0)]) == [(at(0), at(0), 1), (at(10), at(15), 2)]
    assert runs(spark, [(0, 9.0)]) == []


def windows(spark, rows):
    return spark.createDataFrame([(i, v, DAY + timedelta(minutes=a), DAY + timedelta(minutes=b)) for i, v, a, b in rows], "idx int, vessel_id long, from_time timestamp, to_time timestamp")


def test_track_windows_thin_and_never_reach_the_cap(spark):
    df = fixes(spark, [(1, m / 6, 62.0, -7.0, 1.0) for m in range(0, 3000)])
    for minutes in (7, 60, 61, 133, 400, 499):
        for cap in (10, 37, 400):
            found = P.track_windows(df, windows(spark, [(0, 1, 0, minutes)]), cap)
            assert 0 < found.count() <= cap


def test_windows_overlap_and_answer_when_empty(spark):
    df = fixes(spark, [(1, m, 62.0, -7.0, 1.0) for m in (0, 10, 20, 30)])
    asked = windows(spark, [(0, 1, 0, 20), (1, 1, 10, 30), (2, 5, 0, 30)])
    assert sorted((r.idx, r.n) for r in P.track_windows(df, asked, 4000).groupBy("idx").agg(F.count("t").alias("n")).collect()) == [(0, 3), (1, 3), (2, 0)]
    newest = P.fix_windows(df, asked, 2)
    assert sorted((r.idx, r.event_time.minute) for r in newest.collect()) == [(0, 20), (1, 20), (1, 30)]


@pytest.mark.parametrize("operator", [P.track_windows, P.fix_windows])
def test_requested_windows_cut_the_scan(spark, tmp_path, operator):
    """Times and vessels of the request are filters of the scan itself."""
    fixes(spark, [(1, m, 62.0, -7.0, 1.0) for m in range(100)]).write.parquet(f"{tmp_path}/f")
    df = operator(spark.read.parquet(f"{tmp_path}/f"), windows(spark, [(0, 1, 10, 20), (1, 4, 15, 40)]), 50)
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    try:
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = [line for line in plan.split("\n") if "PushedFilters" in line and "event_time" in line]
    assert pushed and all(f in pushed[0] for f in ("GreaterThanOrEqual(event_time", "LessThanOrEqual(event_time", "In(vessel_id, [1,4])"))
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_requests_are_limited(spark):
    df = fixes(spark, [(1, 0, 62.0, -7.0, 1.0)])
    with pytest.raises(RequestError) as e:
        P.track_windows(df, windows(spark, [(i, 1, 0, 1) for i in range(501)]), 10)
    assert e.value.code == "too_many_windows"
    assert P.track_windows(df, windows(spark, []), 10).count() == 0


def test_replace_by_key_breaks_ties_alike(spark):
    rows = [(1, 5, "a"), (1, 5, "b"), (1, 4, "c"), (2, None, "d")]
    kept = {tuple(P.replace_by_key(spark.createDataFrame(order, "k int, version int, v string"), ["k"], "version").orderBy("k").collect()) for order in (rows, rows[::-1])}
    assert len(kept) == 1


def test_track_values_skip_unknown_ones(spark):
    df = fixes(spark, [(1, 0, 62.0, -7.0, 4.0), (1, 1, 62.0, -7.0, None)])
    assert P.tracks(df, 3600).first().speed == 4.0


def test_period_ends(spark):
    df = fixes(spark, [(1, m, 62.0, -7.0, 1.0) for m in (0, 10)])
    ends = ("2024-05-01 00:00:00", "2024-05-01 00:10:00")
    assert df.filter(P.in_period(*ends, closed=False)).count() == 1 and df.filter(P.in_period(*ends, closed=True)).count() == 2


def test_ring_and_distance(spark):
    ring = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)]
    points = [(1.0, 1.0, True), (2.0, 3.0, False), (3.5, 3.0, True), (5.0, 1.0, False), (-1.0, 0.0, False)]
    df = spark.createDataFrame(points, "lon double, lat double, inside boolean")
    assert df.filter(geo.in_ring(F.col("lon"), F.col("lat"), ring) != F.col("inside")).count() == 0
    a, b = spark.range(1).select(geo.haversine_asin(*map(F.lit, (0.0, 0.0, 0.0, 180.0))), geo.haversine_atan2(*map(F.lit, (60.0, 5.0, 61.0, 5.0)))).first()
    assert abs(a - 20015.11) < 0.1 and abs(b - 111.195) < 0.01


def test_broadcast_windows_do_not_shuffle_the_fixes(spark):
    plan = P.fix_windows(fixes(spark, [(1, 0, 62.0, -7.0, 1.0)]), windows(spark, [(0, 1, 0, 20)]), 5)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan


def exchanges(df):
    """Shuffles of a plan, as text, without broadcasts."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


@pytest.mark.parametrize("name", ["q_heatmap", "q_heatmap_region", "q_hover"])
def test_fixes_are_shuffled_by_vessel_alone(spark, name):
    """No shuffle by vessel and time, or by cell and kind: what is dealt by vessel, and sums by cell, serve all that follows."""
    found = exchanges(plans.QUERIES[name](spark, SF))
    keys = {re.sub(r"#\d+L?|, \d+$", "", re.search(r"hashpartitioning\((.*?)\)", x)[1]) for x in found}
    assert "vessel_id" in keys and keys <= {"vessel_id", "ix, iy", "snapshot", "type_id"}, keys
    assert sum("ix, iy" in re.sub(r"#\d+L?", "", x) for x in found) == (name != "q_hover")
