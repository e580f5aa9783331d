"""Vessel resolution, cases, sinks, dates, texts, areas, requests."""

import io
import json
import zipfile
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewater import params
from tidewater.functions import dates, geo, texts
from tidewater.functions.numbers import half_up, locale_number
from tidewater.operators import areas, cases, catches, finance, sinks
from tidewater.sources import feeds

DIRECTORY = "id long, name string, registration_number string, harbour_number string, call_sign string, mmsi string, status_id int"
FLEET = [
    (1, "Havørn", "VA-0012", "H 7", "LABC", None, 1), (2, "Twin", "R-1", None, "AAA", None, 1), (3, "Twin", "R-2", "H 9", None, None, 1), (4, "Ánna Máritt R 12", None, None, "XYZ9", None, 1), (5, "Old One", "O-5", None, None, None, 2),
    (6, "Twin R-77", "R-77", None, None, None, 2), (7, "Shared A", "S-1", None, None, None, 1), (8, "Shared B", "S-1", None, None, None, 1), (9, "Fold é", "F-1", None, None, None, 1), (10, "Fold e!", "F-2", None, None, None, 1),
]


RESOLUTIONS = [
    ("HAVØRN ", None, 1), ("havorn", None, 1), ("nobody", "va 12", 1), ("twin", "r 2", 3), ("Twin", None, None), ("twin", "h9", 3), ("Twin", "R77", 6), ("anna maritt", None, 4), ("nobody", "S-1", None), ("Old One", None, 5),
    ("nobody", "o5", 5), ("fold e", None, None), ("FOLD-E", "f 2", 10), (None, "LABC", 1), (None, None, None), ("unknown", "zz", None),
]


def test_vessel_resolution(spark):
    reports = spark.createDataFrame([r[:2] for r in RESOLUTIONS], "vessel_name string, registration_mark string")
    found = {(r.vessel_name, r.registration_mark): (r.vessel_id, r.outcome) for r in catches.resolve_vessels(reports, spark.createDataFrame(FLEET, DIRECTORY)).collect()}
    assert found == {(n, m): (v, "resolved" if v else "not-found") for n, m, v in RESOLUTIONS}


def test_account_rollup_prefers_stored_totals(spark):
    values = spark.createDataFrame([(1, 2020, 1, 100.0), (1, 2020, 2, -30.0), (1, 2020, 5, -20.0), (2, 2020, 1, 10.0), (2, 2020, 6, 99.0)], "company_id long, year int, account int, value double")
    found = {r.company_id: r for r in finance.resolve_accounts(values, ["company_id", "year"]).collect()}
    assert (found[1].a4, found[1].a6, found[1].a8, found[1].a16) == (70.0, 50.0, 50.0, 50.0)
    assert (found[2].a4, found[2].a6, found[2].a8) == (10.0, 99.0, 99.0)
    figures = {r.company_id: r for r in finance.key_figures(finance.resolve_accounts(values, ["company_id", "year"]), ["company_id"]).collect()}
    assert figures[1].ebit_margin == 0.5 and figures[1].current_ratio is None


def test_conversion_needs_both_rates(spark):
    row = lambda *a: spark.range(1).select(finance.converted(*map(F.lit, a[:2]), "DKK", *map(F.lit, a[2:]))).first()[0]
    assert row(10.0, "DKK", None, None) == 10.0 and row(90.0, "NOK", 9.0, 7.5) == 75.0 and row(90.0, "NOK", None, 7.5) is None


def test_ordered_log(spark):
    rows = [(1, 1, 10, None, False), (1, 2, 11, 10, True), (1, 3, 12, 11, False), (2, 1, 20, None, False), (2, 3, 22, 20, False), (3, 1, 30, 5, False), (3, 2, 31, 30, False)]
    df = spark.createDataFrame(rows, "case_id long, sequence long, command_id long, predecessor long, refuse boolean")
    found = {r.command_id: r.outcome for r in cases.apply_in_order(df).collect()}
    assert found == {10: "applied", 11: "refused", 12: "applied", 20: "applied", 22: "pending", 30: "pending", 31: "pending"}
    assert sorted(r.command_id for r in cases.chain_breaks(df).collect()) == [22, 30]


def test_no_area_is_not_validated(spark):
    revisions = spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 3, 2)], "case_id long, revision_id long, n_areas long")
    receipts = [(2, 1, 0, "geometry", 1, 5, False), (2, 2, 0, "geometry", 2, 4, True), (3, 1, 0, "geometry", None, 9, True), (3, 2, 1, "geometry", 1, 1, False), (1, 1, 0, "legal", None, 9, False), (1, 2, 0, "legal", 0, 1, True)]
    df = spark.createDataFrame(receipts, "revision_id long, receipt int, area long, kind string, command_sequence int, recorded_at long, passed boolean")
    found = {r.revision_id: (r.legal, r.geometry) for r in cases.review_flags(revisions, df).collect()}
    assert found == {1: (True, False), 2: (False, True), 3: (False, False)}


def test_patches_clear_and_delete(spark):
    rows = [(1, "a", 1, True, "red", True, False), (1, None, 2, True, "x", False, False), (2, "b", 3, True, None, False, False), (2, None, 4, False, None, False, True)]
    df = spark.createDataFrame(rows, "id long, name string, seq long, name_set boolean, color string, color_set boolean, deleted boolean")
    assert [tuple(r) for r in sinks.fold_patches(df, "id", "seq", ["name", "color"], "deleted").select("id", "name", "color").collect()] == [(1, None, "red")]


def test_hashes_do_not_depend_on_order(spark):
    a = spark.createDataFrame([(1, "x", None), (1, "y", 2)], "k long, s string, n int")
    b = spark.createDataFrame([(1, "y", 2), (1, "x", None)], "k long, s string, n int")
    assert sinks.classify_by_hash(sinks.detail_hash(a, "k"), sinks.detail_hash(b, "k"), "k").first().change == "unchanged"


@pytest.mark.parametrize(("raw", "iso", "date_only"), [
    ("3.8.2026", "2026-08-03", True), ("03/08/26", "2026-08-03", True), ("2026-08-03Z", "2026-08-03", True), ("31.02.2026", None, None), ("2026-08-03T19:00:00Z", "2026-08-03T19:00", False), ("soon", None, None), ("", None, None), (None, None, None), ("13.13.2026", None, None),
])
def test_validity(spark, raw, iso, date_only):
    v, end = spark.createDataFrame([(raw,)], "raw string").select(dates.validity(F.col("raw")), dates.validity_end(F.col("raw"))).first()
    if iso is None:
        assert v is None and end is None
        return
    ms = int(datetime.fromisoformat(iso).replace(tzinfo=UTC).timestamp() * 1000)
    assert (v.ms, v.date_only, end) == (ms, date_only, ms + 86_399_999 if date_only else ms)


@pytest.mark.parametrize(("local", "utc"), [("2026-07-01 12:00:00", "10:00"), ("2026-01-01 12:00:00", "11:00"), ("2026-10-25 02:30:00", "01:30"), ("2026-03-29 03:30:00", "01:30")])
def test_local_time(spark, local, utc):
    assert spark.range(1).select(F.date_format(dates.local_to_utc(F.lit(local).cast("timestamp"), "Europe/Oslo"), "HH:mm")).first()[0] == utc


@pytest.mark.parametrize(("text", "points"), [
    ("N 62° 30' 15,5\" N 5° 10' 0\" E", [(62.504306, 5.166667)]), ("Nord 62 grader, 30,5 minutter, Øst 5 grader, 10 minutter", [(62.508333, 5.166667)]), ("62°30,5’ N 5°10,0’ W og 62°30.5' N 5°10' W", [(62.508333, -5.166667)]),
    ("6230 N - 00510 V", [(62.5, -5.166667)]), ("62° 30' 15\" S 5° 10' 30,5\" Ø", [(-62.504167, 5.175139)]), ("Sør 10 grader 5 minutter Vest 20 grader 6,6 minutter", [(-10.083333, -20.11)]),
    ("62°30,5' N, 5° N", []), ("62° . ' N 5° 1' E", []), ("nord 62 grader. 30 minutter. aust 5 grader. 10 minutter", [(62.5, 5.166667)]), ("62° 30' N 5° 10' Ø 63° 0' N 6° 0' W", [(62.5, 5.166667), (63.0, -6.0)]), ("sør for 62° 00' N", []), ("95° 0' N 5° 0' E", []), (None, None),
])
def test_coordinates(spark, text, points):
    found = spark.createDataFrame([(text,)], "t string").select(texts.all_coordinates(F.col("t"))).first()[0]
    assert (found if found is None else [(round(p.lat, 6), round(p.lon, 6)) for p in found]) == points


def test_tokens_of_a_line_are_found_once(spark):
    """A plan that names the tokens in each step over them reads a line once for every pair of its tokens."""
    df = spark.createDataFrame([("61° 30' N 4° 0' E, nord 62 grader, 30 minutter, aust 5 grader 0,5 minutter; 6330N-00430W 61°30' N 4°0' E 63° 1' 2\" S 5° 6' 7,2\" Vik 1,61° 0' N 2° 0' E",)], "t string")
    plan = df.select(texts.all_coordinates(F.col("t")).alias("p"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 20 and plan.count("regexp_extract_all") == 4
    found = df.select(texts.all_coordinates(F.col("t")).alias("p")).first()[0]
    assert [(round(p.lat, 6), round(p.lon, 6)) for p in found] == [(62.5, 5.008333), (61.5, 4.0), (63.5, -4.5)]


def test_numbers(spark):
    numbers = spark.createDataFrame([("1.234,5",), ("12 %",), ("x",), (None,), ("-3,25",)], "t string").select(locale_number(F.col("t"))).collect()
    assert [r[0] for r in numbers] == [1234.5, 12.0, None, None, -3.25]
    assert [r[0] for r in spark.createDataFrame([(2.5,), (-2.5,), (0.49,)], "v double").select(half_up(F.col("v"))).collect()] == [3.0, -2.0, 0.0]


def test_areas_of_a_notice(spark):
    body = "- Old 60° 0' N 1° 0' E\nForskriften lyder etter dette:\n## Nordfjord\n61° 0' N 5° 0' E\n61° 0,00' N 5° 0,00' E\n62° 0' N 5° 30' E\n## 1. Not a name\n§ 4 Stengt\n63° 0' N 6° 0' E\n"
    found = areas.named_areas(spark.createDataFrame([(1, body), (2, None), (3, "no points")], "id long, body string"), "id").orderBy("segment").collect()
    assert [(r.name, r.paragraph, len(r.points)) for r in found] == [("Nordfjord", None, 2), ("Nordfjord", 4, 1)]


def test_notices_with_one_text_are_read_once(spark, rows, monkeypatch):
    """Many notices share two texts, a key comes twice: each has the areas of its text, and each text is read once."""
    seen, read = [], areas._text_areas

    def counting(notices, *rest):
        seen.append(notices.count())
        return read(notices, *rest)

    monkeypatch.setattr(areas, "_text_areas", counting)
    north, south = "## Nord\n§ 4 Stengt\n61° 0' N 5° 0' E\n62° 0' N 5° 30' E", "## Sør\n61° 0' N 5° 0' E\n§ 5\n62° 0' N 5° 30' E"
    notices = [(i, (north, south)[i % 2]) for i in range(200)] + [(0, north), (300, None), (301, "no points")]
    found = areas.named_areas(spark.createDataFrame(notices, "id long, body string").repartition(3), "id")
    assert found.columns == ["id", "segment", "name", "paragraph", "points"]
    want = [(i, *area) for i, text in notices for area in {north: [("Nord", 4, 2)], south: [("Sør", None, 1), ("Sør", 5, 1)]}.get(text, [])]
    assert rows(found.select("id", "name", "paragraph", F.size("points"))) == sorted(want, key=repr) and seen == [3]


def test_shapes(spark):
    square = [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0), (2.0, 2.0), (1.0, 3.0)]
    df = spark.createDataFrame([(1, square), (2, square[:2])], "id int, p array<struct<lat:double,lon:double>>")
    hulls = {r.id: r.h for r in df.select("id", areas.convex_hull("p").alias("h")).collect()}
    assert {(p.lat, p.lon) for p in hulls[1]} == set(square[:4]) and hulls[2] is None
    line = lambda box: df.filter("id = 2").select(areas.line_meets_box(F.col("p"), box)).first()[0]
    assert line((1, -1, 2, 1)) and line((-1, -1, 9, 1)) and not line((1, 1, 2, 2)) and line((4, 0, 5, 1))
    poly = lambda box: df.filter("id = 1").select(areas.polygon_meets_box(F.slice("p", 1, 4), box)).first()[0]
    assert poly((1, 1, 2, 2)) and poly((3, 3, 9, 9)) and not poly((5, 5, 6, 6))
    tile = df.filter("id = 1").select(areas.in_tile(F.slice("p", 1, 2), 0, 0, 0).alias("q")).first().q
    assert [(round(p.x), round(p.y)) for p in tile] == [(2048, 2048), (2094, 2048)]


def test_workbook(spark, tmp_path):
    rows = [["id", "name"], ["7", "Åse"], [None, "x"]]
    strings = ["id", "name", "Åse", "x"]
    cell = lambda r, c, v: f'<c r="{"AB"[c]}{r + 1}" t="s"><v>{strings.index(v)}</v></c>' if v in strings else f'<c r="{"AB"[c]}{r + 1}"><v>{v}</v></c>'
    sheet = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v) + "</row>" for r, row in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    (tmp_path / "a.xlsx").write_bytes(data.getvalue())
    assert [list(r.cells) for r in feeds.workbook_rows(spark, str(tmp_path)).orderBy("row").collect()] == rows


NOW = datetime(2026, 1, 1, tzinfo=UTC)


def test_requests():
    assert params.period(None, None, "7d", NOW).start == NOW - timedelta(days=7)
    assert params.clamp(None, 0, 1, 0.5) == 0.5 and params.clamp(9, 0, 1, 0.5) == 1
    assert params.decode_cursor(params.encode_cursor("1996-01-01", 7)) == ("1996-01-01", 7)
    ring = [[0, 0], [1, 0], [1, 1]]
    assert params.polygons(json.dumps({"type": "Polygon", "coordinates": [[*ring, [0, 1]], ring]}))[0][-1] == (0.0, 0.0)
    for code, call in {
        "window_too_long": lambda: params.guard_heatmap(params.Period(NOW - timedelta(days=40), NOW), None),
        "bbox_too_large": lambda: params.guard_heatmap(params.Period(NOW - timedelta(days=4), NOW), (-180, -60, 180, 60)),
        "overlapping_windows": lambda: params.guard_hover([params.Period(NOW, NOW + timedelta(days=2)), params.Period(NOW + timedelta(days=1), NOW + timedelta(days=3))], 5),
        "bad_radius": lambda: params.guard_hover([params.Period(NOW, NOW + timedelta(days=2))], 101), "bad_bbox": lambda: params.bbox("1,2,3"), "bad_instant": lambda: params.instant("2026-01-01T00:00:00"), "bad_cursor": lambda: params.decode_cursor("%%%"),
    }.items():
        with pytest.raises(params.RequestError) as e:
            call()
        assert e.value.code == code


def test_geodesic_distance(spark):
    """Flinders Peak to Buninyong, and a degree of latitude at the pole and at the equator."""
    rows = [(-37.951033, 144.424868, -37.652821, 143.926496, 54.972), (89.0, 0.0, 90.0, 0.0, 111.694), (0.0, 0.0, 1.0, 0.0, 110.574), (5.0, 5.0, 5.0, 5.0, 0.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, km double")
    assert df.filter(F.abs(areas.geodesic_km(F.col("a"), F.col("b"), F.col("c"), F.col("d")) - F.col("km")) > 0.002).count() == 0


def test_ring_problems(spark):
    rings = [(None, "empty"), ([(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (0.0, 0.0)], None), ([(0.0, 0.0), (0.0, 4.0), (4.0, 4.0)], "ring is not closed"), ([(0.0, 0.0), (0.0, 4.0), (0.0, 0.0)], "too few points"), ([(0.0, 0.0), (4.0, 4.0), (0.0, 4.0), (4.0, 0.0), (0.0, 0.0)], "self-intersection"), ([(99.0, 0.0), (0.0, 4.0), (4.0, 4.0), (99.0, 0.0)], "coordinate out of range")]
    df = spark.createDataFrame(rings, "r array<struct<lat:double,lon:double>>, want string")
    assert [r.got for r in df.select(areas.ring_problems(F.col("r")).alias("got")).collect()] == [w for _, w in rings]


@pytest.mark.parametrize(("text", "start", "end"), [
    ("galdandi frá 3. mars 2024 kl. 12:30 til og við 5. apríl 2024", "2024-03-03T12:30", "2024-04-05T00:00"), ("Galdandi fra í dag, hin 3 mars 2024 til 5 desember 2024 klokkan 9.05", "2024-03-03T00:00", "2024-12-05T09:05"),
    ("GALDANDI FRÁ 1. jan. 2025 til til 2. jan. 2025 kl 23:59", "2025-01-01T00:00", "2025-01-02T23:59"), ("galdandi frá 3. mars 2024", None, None), ("til 3. mars 2024", None, None),
    ("galdandi frá 31. februar 2024 til 1. mars 2024", None, None), ("galdandi frá 3. xyz 2024 til 1. mars 2024", None, None), (None, None, None),
])
def test_faroese_window(spark, text, start, end):
    w = spark.createDataFrame([(text,)], "t string").select(dates.faroese_window(F.col("t")).alias("w")).first()["w"]
    ms = lambda iso: None if iso is None else int(datetime.fromisoformat(iso).replace(tzinfo=UTC).timestamp() * 1000)
    assert (w.from_ms, w.to_ms) == (ms(start), ms(end))


def test_geometry_readers(spark):
    rows = [("POINT(1 2)",), ("MULTIPOINT((1.5 -2), (3e1 4))",), ("POLYGON((0 0, 4 0, 4 4, 0 0))",), ("GEOMETRYCOLLECTION EMPTY",), (None,)]
    found = [r.p if r.p is None else [(p.lon, p.lat) for p in r.p] for r in spark.createDataFrame(rows, "t string").select(geo.points_from_wkt(F.col("t")).alias("p")).collect()]
    assert found == [[(1.0, 2.0)], [(1.5, -2.0), (30.0, 4.0)], [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)], [], None]
    rows = [('{"type":"MultiPoint","coordinates":[[1,2],[3.5,-4]]}',), ('{"type":"Polygon","coordinates":[]}',), ("no json",)]
    found = [r.p if r.p is None else [(p.lon, p.lat) for p in r.p] for r in spark.createDataFrame(rows, "t string").select(geo.points_from_geojson(F.col("t")).alias("p")).collect()]
    assert found == [[(1.0, 2.0), (3.5, -4.0)], None, None]


def test_anchor_plan_joins_on_vessel_and_day(spark):
    from tidewater.operators import catches
    from tidewater.schemas import POSITION_FIX

    reports = spark.createDataFrame([(1, 7, NOW, 60.0, 1.0)], "innmelding_id long, vessel_id long, reported_at timestamp, reported_latitude double, reported_longitude double")
    plan = catches.anchors(reports, spark.createDataFrame([], POSITION_FIX))._jdf.queryExecution().optimizedPlan().toString()
    assert any("vessel_id" in line and "day" in line for line in plan.split("\n") if line.strip(" :+-").startswith("Join Inner"))
