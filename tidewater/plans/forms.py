"""Geometry, written forms, dates, numbers and feeds, each as a query of its own."""

from __future__ import annotations

import io
import zipfile
from datetime import UTC, datetime
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater import params
from tidewater.functions import dates, geo, numbers, requests, sweep, texts
from tidewater.operators import areas as A
from tidewater.operators import catches as C
from tidewater.operators import finance as N
from tidewater.operators import fragments
from tidewater.operators import sinks as S
from tidewater.operators import spatial, sweeps
from tidewater.operators import tiles
from tidewater.plans import ais, finance, places
from tidewater.plans.base import query
from tidewater.plans.selections import _km, _values
from tidewater.sources import bridge as B
from tidewater.sources import feeds

_FIX = "WITH " + B.FIXES_SQL
_CLOSURE = "WITH " + B.CLOSURES_SQL
_FEATURE = "WITH " + B.FEATURES_SQL


def _integer(column):
    return column.cast("int")


# --- geometry


@query("geo_01", _FIX + f" SELECT source_id, {ais._ring_sql()} AS inside FROM fix")
def geo_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even-odd test against a constant ring."""
    return B.fixes(spark, sf_dir).select("source_id", geo.in_ring(F.col("longitude"), F.col("latitude"), ais.RING).alias("inside"))


@query("geo_02", _FIX + " SELECT source_id, floor(longitude / 0.1e0)::BIGINT AS ix, floor(latitude / 0.03e0)::BIGINT AS iy, round((floor(longitude / 0.1e0) + 0.5e0) * 0.1e0, 3) AS lon, round((floor(latitude / 0.03e0) + 0.5e0) * 0.03e0, 3) AS lat FROM fix")
def geo_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice cell and its centre."""
    ix, iy = geo.cell_index(F.col("longitude"), 0.1), geo.cell_index(F.col("latitude"), 0.03)
    return B.fixes(spark, sf_dir).select("source_id", ix.alias("ix"), iy.alias("iy"), geo.cell_centre(ix, 0.1).alias("lon"), geo.cell_centre(iy, 0.03).alias("lat"))


@query("geo_03", _FIX + " SELECT source_id, round_even(latitude / 0.05e0, 0) * 0.05e0 AS lat, round_even(longitude / 0.05e0, 0) * 0.05e0 AS lon FROM fix")
def geo_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fixes(spark, sf_dir).select("source_id", geo.snapped(F.col("latitude"), 0.05).alias("lat"), geo.snapped(F.col("longitude"), 0.05).alias("lon"))


@query("geo_04", _FEATURE + f" SELECT feature_id, round({_km(-60.0, 179.0)}, 4) AS km FROM feature")
def geo_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Great-circle distance, up to nearly half of the globe."""
    return B.features(spark, sf_dir).select("feature_id", F.round(geo.haversine_asin(F.lit(-60.0), F.lit(179.0), F.col("lat"), F.col("lon")), 4).alias("km"))


@query("geo_06", _CLOSURE + " SELECT jm_number, list_bool_or([p.lat BETWEEN 60 AND 64 AND p.lon BETWEEN -5 AND 3 FOR p IN points]) AS meets FROM closure")
def geo_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point sets that meet an envelope."""
    return B.closures(spark, sf_dir).select("jm_number", geo.points_in_bbox(F.col("points"), (-5.0, 60.0, 3.0, 64.0)).alias("meets"))


@query("geo_09", _CLOSURE + " SELECT jm_number, 3 AS from_wkt, 3 AS from_json, round(list_sum([p.lat - p.lon FOR p IN points]), 6) AS total FROM closure")
def geo_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written as WKT and GeoJSON and read back from both."""
    c = B.closures(spark, sf_dir).select("jm_number", geo.points_from_wkt(geo.multipoint_wkt(F.col("points"))).alias("w"), geo.points_from_geojson(geo.multipoint_geojson(F.col("points"))).alias("j"))
    total = F.aggregate("w", F.lit(0.0), lambda a, p: a + p["lat"]) - F.aggregate("j", F.lit(0.0), lambda a, p: a + p["lon"])
    return c.select("jm_number", F.size("w").alias("from_wkt"), F.size("j").alias("from_json"), F.round(total, 6).alias("total"))


_PAIRS = "string_agg('[' || (2 + i * 0.5e0) || ',' || (60 + s_suppkey % 7 + i * 0.25e0) || ']', ',' ORDER BY i)"


@query("geo_11", f"""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 0 THEN '{{"type":"FeatureCollection","features":[{{"type":"Feature","properties":{{"name":' || CASE WHEN s_suppkey % 3 = 0 THEN 'null' ELSE '"' || s_name || '"' END || '}},"geometry":{{"type":"MultiPoint","coordinates":[' || {_PAIRS} || ']}}}}]}}' END AS geojson
FROM supplier, range(0, 3) AS r(i) GROUP BY s_suppkey, s_name""")
def geo_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature collections of named areas; areas without points are left out, and no area left is null."""
    key = F.col("s_suppkey")
    point = lambda i: F.struct((60 + key % 7 + F.lit(0.25 * i)).alias("lat"), F.lit(2 + 0.5 * i).alias("lon"))
    points = F.array(*[point(i) for i in range(3)])
    full = F.struct(F.when(key % 3 != 0, F.col("s_name")).alias("name"), F.when(key % 5 != 0, points).otherwise(F.slice(points, 1, 0)).alias("points"))
    empty = F.struct(F.lit("empty").alias("name"), F.slice(points, 1, 0).alias("points"))
    return B.table(spark, sf_dir, "supplier").select(key.alias("id"), geo.feature_collection(F.array(full, empty)).alias("geojson"))


#: Point sets around the first vertex of each closure: 3 to 8 corners on an oval, and points within, out of order.
_OVAL = "[{{'lat': lat + r * sin(radians({0} * i + turn)) / 2, 'lon': lon + r * cos(radians({0} * i + turn))}} FOR i IN range(0, {1})]"
_SPREAD = """o AS (SELECT jm_number AS id, points[1].lat AS lat, points[1].lon AS lon, (key % 40 + 1) / 10e0 AS r, key % 72 AS turn, 3 + key % 6 AS k FROM (SELECT *, split_part(jm_number, '-', 2)::BIGINT AS key FROM {0}))"""


def _spread(closures: DataFrame) -> DataFrame:
    key = F.substring_index("jm_number", "-", -1).cast("long")
    c = closures.withColumns({"first": F.get("points", F.lit(0)), "r": (key % 40 + 1) / F.lit(10.0), "turn": key % 72, "k": (key % 6 + 3).cast("int")})

    def around(r, every, count):
        at = lambda i: F.radians(i * every + F.col("turn"))
        return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct((F.col("first.lat") + r * F.sin(at(i)) / 2).alias("lat"), (F.col("first.lon") + r * F.cos(at(i))).alias("lon")))

    corners = around(F.col("r"), F.lit(360.0) / F.col("k"), F.col("k"))
    within = around(F.col("r") / 4, F.lit(50), F.lit(7))
    # The corners are worked out once.
    return c.withColumn("points", F.get(F.transform(F.array(corners), lambda r: F.concat(F.slice(r, 2, 8), within, F.slice(r, 1, 1))), F.lit(0)))


_ROUND = _OVAL.format("360e0 / k", "k")


@query("geo_12", _CLOSURE + ", " + _SPREAD.format("closure") + f", h AS (SELECT id, k, {_ROUND} AS p FROM o) SELECT id AS jm_number, k::INTEGER AS corners, round(list_sum([p[i].lon * p[i % k + 1].lat - p[i % k + 1].lon * p[i].lat FOR i IN range(1, k + 1)]) / 2, 6) AS area FROM h")
def geo_12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Convex hulls of point sets: number of corners and area."""
    c = _spread(B.closures(spark, sf_dir)).select("jm_number", A.convex_hull("points").alias("hull")).filter("hull IS NOT NULL")
    return c.select("jm_number", F.size("hull").alias("corners"), F.round(geo.ring_area_deg2(F.col("hull")), 6).alias("area"))


def _clip_sql(rings: str, z: int) -> str:
    """Clipping of convex rings, by another road: the corners of the part inside are the ring's corners within the square, the square's
    corners within the ring, and the crossings of their sides; sorted around their middle. ``rings``: id, tx, ty, ring (of lat, lon)."""
    half, size = repr(A.HALF_WORLD), repr(2 * A.HALF_WORLD / (1 << z))
    x = f"(radians(p.lon) * 6378137e0 + {half} - tx * {size}) / {size} * 4096"
    y = f"({half} - ty * {size} - ln(tan(radians(p.lat) / 2 + 0.7853981633974483e0)) * 6378137e0) / {size} * 4096"
    return f"""rings AS ({rings}), u AS (SELECT id, [{{'x': {x}, 'y': {y}}} FOR p IN ring] AS r FROM rings),
e AS (SELECT id, r[i] AS a, r[i % len(r) + 1] AS b FROM u, unnest(range(1, len(r) + 1)) AS t(i)),
side AS (SELECT * FROM (VALUES (-64e0), (4160e0)) AS t(cut)),
corner AS (SELECT s.cut AS x, t.cut AS y FROM side s, side t),
k AS (
  SELECT id, a.x AS x, a.y AS y FROM e WHERE a.x BETWEEN -64 AND 4160 AND a.y BETWEEN -64 AND 4160
  UNION ALL SELECT id, cut, a.y + (b.y - a.y) * ((cut - a.x) / (b.x - a.x)) FROM e, side WHERE (a.x < cut) <> (b.x < cut) AND a.y + (b.y - a.y) * ((cut - a.x) / (b.x - a.x)) BETWEEN -64 AND 4160
  UNION ALL SELECT id, a.x + (b.x - a.x) * ((cut - a.y) / (b.y - a.y)), cut FROM e, side WHERE (a.y < cut) <> (b.y < cut) AND a.x + (b.x - a.x) * ((cut - a.y) / (b.y - a.y)) BETWEEN -64 AND 4160
  UNION ALL SELECT id, x, y FROM e, corner GROUP BY id, x, y HAVING bool_and((b.x - a.x) * (y - a.y) - (b.y - a.y) * (x - a.x) > 0) OR bool_and((b.x - a.x) * (y - a.y) - (b.y - a.y) * (x - a.x) < 0)),
m AS (SELECT *, round(x)::INTEGER AS ix, round(y)::INTEGER AS iy, atan2(y - avg(y) OVER (PARTITION BY id), x - avg(x) OVER (PARTITION BY id)) AS angle FROM k),
d AS (SELECT id, ix, iy, min(angle) AS angle FROM m GROUP BY id, ix, iy),
n AS (SELECT id, ix, iy, count(*) OVER (PARTITION BY id) AS n, coalesce(lead(ix) OVER w, first_value(ix) OVER w) AS jx, coalesce(lead(iy) OVER w, first_value(iy) OVER w) AS jy FROM d WINDOW w AS (PARTITION BY id ORDER BY angle)),
clip AS (SELECT id, any_value(n) AS n, sum(ix::BIGINT * jy - jx::BIGINT * iy)::BIGINT AS area2, string_agg(ix || ' ' || iy, ';' ORDER BY ix, iy) AS corners FROM n GROUP BY id HAVING any_value(n) >= 3 AND sum(ix::BIGINT * jy - jx::BIGINT * iy) <> 0)"""


def _corner_text(ring: str):
    return F.array_join(F.transform(F.array_sort(F.array_distinct(ring)), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ";")


@query("geo_14", _CLOSURE + ", " + _SPREAD.format("closure") + ", " + _clip_sql(f"SELECT id, floor((radians(lon) * 6378137e0 + {A.HALF_WORLD!r}) / {2 * A.HALF_WORLD / 256!r}) AS tx, floor(({A.HALF_WORLD!r} - ln(tan(radians(lat) / 2 + 0.7853981633974483e0)) * 6378137e0) / {2 * A.HALF_WORLD / 256!r}) AS ty, {_ROUND} AS ring FROM o", 8) + " SELECT id AS jm_number, n, area2, corners FROM clip")
def geo_14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls, small and large, as the tile of their middle has them: inside it, over its edge, and around it."""
    x, y = A.tile_of(F.col("first.lon"), F.col("first.lat"), 8)
    cut = _spread(B.closures(spark, sf_dir)).select("jm_number", A.only_present(A.tile_ring(A.convex_hull("points"), 8, x, y)).alias("ring"))
    return cut.select("jm_number", F.size("ring").cast("long").alias("n"), A.turn(F.col("ring")).alias("area2"), _corner_text("ring").alias("corners"))


_WAITING = "w AS (SELECT s_suppkey AS place, 58 + s_suppkey * 37 % 1200 / 100e0 AS lat, -10 + s_suppkey * 61 % 2500 / 100e0 AS lon, (s_suppkey % 9 + 1) / 20e0 AS r, s_suppkey % 60 AS turn, 4 AS k FROM supplier)"


@query("jn_17_shapes", _CLOSURE + ", " + _SPREAD.format("closure") + ", " + _WAITING + f""", a AS (SELECT id, {_ROUND} AS p, lat, lon, r FROM o), b AS (SELECT place, {_ROUND} AS q, lat, lon, r FROM w),
near AS (SELECT * FROM a JOIN b ON abs(a.lat - b.lat) <= (a.r + b.r) / 2 AND abs(a.lon - b.lon) <= a.r + b.r)
SELECT id AS jm_number, place FROM near WHERE
  NOT list_bool_or([list_bool_and([(p[i % len(p) + 1].lon - p[i].lon) * (v.lat - p[i].lat) - (p[i % len(p) + 1].lat - p[i].lat) * (v.lon - p[i].lon) < 0 FOR v IN q]) FOR i IN range(1, len(p) + 1)])
  AND NOT list_bool_or([list_bool_and([(q[i % len(q) + 1].lon - q[i].lon) * (v.lat - q[i].lat) - (q[i % len(q) + 1].lat - q[i].lat) * (v.lon - q[i].lon) < 0 FOR v IN p]) FOR i IN range(1, len(q) + 1)])""")
def jn_17_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closures and waiting places that have a point in common. (The twin looks for a line that separates two convex shapes.)"""
    # A small table comes in one part; hulls are found in many.
    c = B.closures(spark, sf_dir).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "jm_number")
    c = _spread(c).select("jm_number", A.convex_hull("points").alias("ring"))
    k = F.col("s_suppkey")
    at = B.table(spark, sf_dir, "supplier").select(k.alias("place"), (58 + k * 37 % 1200 / F.lit(100.0)).alias("lat"), (-10 + k * 61 % 2500 / F.lit(100.0)).alias("lon"), ((k % 9 + 1) / F.lit(20.0)).alias("r"), (k % 60).alias("turn"))
    corner = lambda i: F.struct((F.col("lat") + F.col("r") * F.sin(F.radians(i * 90.0 + F.col("turn"))) / 2).alias("lat"), (F.col("lon") + F.col("r") * F.cos(F.radians(i * 90.0 + F.col("turn")))).alias("lon"))
    places = at.select("place", F.transform(F.sequence(F.lit(0), F.lit(3)), corner).alias("ring"))
    return spatial.meeting_pairs(c, places, "jm_number", "place")


@query("top_06_join", _CLOSURE + ", " + B.FEATURES_SQL + """, d AS (
  SELECT jm_number, feature_id, round(2 * 6371.0088e0 * asin(least(1e0, sqrt(pow(sin(radians(f.lat - c.points[1].lat) / 2), 2) + cos(radians(c.points[1].lat)) * cos(radians(f.lat)) * pow(sin(radians(f.lon - c.points[1].lon) / 2), 2)))) * 1e6)::BIGINT AS mm FROM closure c, feature f)
SELECT jm_number, row_number() OVER (PARTITION BY jm_number ORDER BY mm, feature_id)::INTEGER AS rank, feature_id, mm / 1e6 AS km FROM d QUALIFY rank <= 3""")
def top_06_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three features nearest to every closure."""
    c = B.closures(spark, sf_dir).select("jm_number", F.get("points", F.lit(0))["lat"].alias("lat"), F.get("points", F.lit(0))["lon"].alias("lon"))
    return spatial.nearest(c, B.features(spark, sf_dir), "jm_number", "feature_id", 3)


#: Closures by another gate in SQL: a case of the same number with an official geometry where it looks.
_GATE = """ptr AS (SELECT o_custkey AS case_id, max(o_orderkey) AS current_id, max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS published_id FROM orders GROUP BY 1),
vec AS (SELECT DISTINCT l_orderkey AS revision_id FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 1),
open_closure AS (SELECT * FROM closure c WHERE NOT EXISTS (SELECT 1 FROM ptr p WHERE 'J-' || p.case_id = c.jm_number AND coalesce(c.region, 'NO') = 'NO' AND
  ((p.published_id IS NULL AND p.current_id IN (SELECT revision_id FROM vec)) OR (p.published_id IS NOT NULL AND (p.published_id % 5 = 0 OR p.case_id % 11 = 0 OR p.published_id IN (SELECT revision_id FROM vec))))))"""


def _open_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closures with a geometry that no case shows; a case's number is the customer's, its revisions are the customer's orders."""
    r = B.revisions(spark, sf_dir).groupBy("case_id").agg(F.max("revision_id").alias("current_id"), F.max(F.when(F.col("status") == "F", F.col("revision_id"))).alias("published_id"))
    cases = r.select(F.concat(F.lit("J-"), F.col("case_id").cast("string")).alias("source_ref"), "current_id", "published_id", F.when(F.col("published_id") % 5 == 0, 1).otherwise(2).alias("model_version"), (F.col("case_id") % 11 == 0).alias("metadata_only"))
    vectors = B.validations(spark, sf_dir).filter(~F.col("passed") & (F.col("receipt") == 1)).select("revision_id")
    return A.without_published(B.closures(spark, sf_dir).filter("has_geo"), cases, vectors)


def _tile_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    spread = _spread(_open_closures(spark, sf_dir)).select("jm_number", "title", "status", A.only_present(A.near_tile("points", 5, 15, 8)).alias("points"))
    return spread.select("jm_number", "title", "status", A.only_present(A.tile_ring(A.convex_hull("points"), 5, 15, 8)).alias("corners"))


@query("q_tile", _CLOSURE + ", " + _GATE + ", " + _SPREAD.format("open_closure WHERE has_geo") + ", " + _clip_sql(f"SELECT id, 15 AS tx, 8 AS ty, {_ROUND} AS ring FROM o", 5) + " SELECT jm_number, title, status, n, area2, corners FROM clip JOIN closure ON jm_number = id")
def q_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hulls of the closures that no case shows yet, clipped to a tile."""
    tile = _tile_features(spark, sf_dir)
    return tile.select("jm_number", "title", "status", F.size("corners").cast("long").alias("n"), A.turn(F.col("corners")).alias("area2"), _corner_text("corners").alias("corners"))


@query("q_tile_mvt")
def q_tile_mvt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hulls as the bytes of a vector tile; a decoder in the tests reads them back."""
    tile = _tile_features(spark, sf_dir).select(F.lit(5).alias("z"), F.lit(15).alias("x"), F.lit(8).alias("y"), "jm_number", "title", "status", "corners")
    return tiles.encoded(tile, ["z", "x", "y"], ["jm_number", "title", "status"], "jmelding-closures")


_RING4 = "[{'lat': 0e0, 'lon': 0e0}, {'lat': (s_suppkey % 7)::DOUBLE, 'lon': 3e0}, {'lat': 4e0, 'lon': (s_suppkey % 5)::DOUBLE}, {'lat': (s_suppkey % 3)::DOUBLE, 'lon': 4e0}]"


def _ccw(a: str, b: str, c: str) -> str:
    return f"(({c}.lat - {a}.lat) * ({b}.lon - {a}.lon) > ({b}.lat - {a}.lat) * ({c}.lon - {a}.lon))"


def _crossing(a: str, b: str, c: str, d: str) -> str:
    return f"({_ccw(a, c, d)} <> {_ccw(b, c, d)} AND {_ccw(a, b, c)} <> {_ccw(a, b, d)})"


@query("geo_16", f"""WITH r AS (SELECT s_suppkey AS id, {_RING4} AS r FROM supplier), v AS (SELECT id, r[1] AS a, r[2] AS b, r[3] AS c, r[4] AS d FROM r)
SELECT id, {_crossing('a', 'b', 'c', 'd')} OR {_crossing('b', 'c', 'd', 'a')} AS crosses, round(abs(a.lon * b.lat - b.lon * a.lat + b.lon * c.lat - c.lon * b.lat + c.lon * d.lat - d.lon * c.lat + d.lon * a.lat - a.lon * d.lat) / 2, 6) AS area FROM v""")
def geo_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of four vertices: whether they cross themselves, and their area."""
    key = F.col("s_suppkey")
    point = lambda lat, lon: F.struct(lat.alias("lat"), lon.alias("lon"))
    ring = F.array(point(F.lit(0.0), F.lit(0.0)), point((key % 7).cast("double"), F.lit(3.0)), point(F.lit(4.0), (key % 5).cast("double")), point((key % 3).cast("double"), F.lit(4.0)))
    return B.table(spark, sf_dir, "supplier").select(key.alias("id"), sweep.self_intersects(ring).alias("crosses"), F.round(geo.ring_area_deg2(ring), 6).alias("area"))


@query("geo_19", _CLOSURE + " SELECT jm_number, CASE WHEN split_part(jm_number, '-', 2)::BIGINT % 4 = 0 THEN 6 ELSE 3 END AS kept, round(points[1].lat, 6) AS first_lat FROM closure")
def geo_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that come twice, once a little apart: by less than the tolerance, or in one case in four by more."""
    number = F.split_part("jm_number", F.lit("-"), F.lit(2)).cast("long")
    moved = F.transform("points", lambda p: F.struct((p["lat"] + F.when(number % 4 == 0, 0.0002).otherwise(0.00004)).alias("lat"), p["lon"].alias("lon")))
    kept = geo.without_near_repeats(F.concat("points", moved))
    return B.closures(spark, sf_dir).select("jm_number", F.size(kept).alias("kept"), F.round(F.get(kept, F.lit(0))["lat"], 6).alias("first_lat"))


@query("geo_20", _CLOSURE + """, k AS (SELECT *, split_part(jm_number, '-', 2)::BIGINT AS n FROM closure)
SELECT kind, count(*) AS findings FROM (SELECT CASE WHEN n % 8 = 0 THEN 'missing-area' WHEN n % 9 = 0 THEN 'vertex-count' WHEN n % 7 = 0 THEN 'unreadable-source' WHEN n % 6 = 0 THEN 'position' END AS kind FROM k) WHERE kind IS NOT NULL GROUP BY 1""")
def geo_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings between an authority's areas and our own, by kind."""
    number = F.split_part("jm_number", F.lit("-"), F.lit(2)).cast("long")
    c = B.closures(spark, sf_dir)
    moved = F.transform("points", lambda p: F.struct((p["lat"] + F.when(number % 6 == 0, 0.01).otherwise(0.0)).alias("lat"), p["lon"].alias("lon")))
    theirs = c.select("jm_number", F.when(number % 9 == 0, F.slice(moved, 1, 2)).otherwise(moved).alias("theirs"), F.when(number % 7 == 0, 1).otherwise(0).alias("unreadable"))
    own = c.filter(number % 8 != 0).select("jm_number", F.col("points").alias("own"))
    return A.divergence(theirs, own, "jm_number").groupBy("kind").agg(F.count("*").alias("findings"))


@query("geo_21", "SELECT s_suppkey AS id, s_suppkey % 4 IN (0, 1) AS equal FROM supplier")
def geo_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring against itself closed, nearly equal, turned by one vertex, and moved."""
    key = F.col("s_suppkey")
    point = lambda lat, lon: F.struct(F.lit(lat).cast("double").alias("lat"), (F.lit(lon) + key % 3).cast("double").alias("lon"))
    a, b, c, d = point(0, 0), point(0, 4), point(4, 4), point(4, 0)
    near, far = point(4 + 1e-10, 0), point(4 + 1e-6, 0)
    other = F.when(key % 4 == 0, F.array(a, b, c, d, a)).when(key % 4 == 1, F.array(a, b, c, near)).when(key % 4 == 2, F.array(b, c, d, a)).otherwise(F.array(a, b, c, far))
    equal = geo.rings_equal(A.without_closing_repeat(F.array(a, b, c, d)), A.without_closing_repeat(other))
    return B.table(spark, sf_dir, "supplier").select(key.alias("id"), equal.alias("equal"))


@query("geo_22", _CLOSURE + " SELECT jm_number, round((list_max([p.lat FOR p IN points]) - list_min([p.lat FOR p IN points])) * (list_max([p.lon FOR p IN points]) - list_min([p.lon FOR p IN points])), 6) AS deg2 FROM closure")
def geo_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.closures(spark, sf_dir).select("jm_number", F.round(geo.bbox_area_deg2(F.col("points")), 6).alias("deg2"))


@query("jn_20", "SELECT id, ring::INTEGER AS ring, CASE WHEN ring <= 1 + id % 3 THEN 'agreed' ELSE 'no-parser-counterpart' END AS outcome FROM (SELECT s_suppkey AS id FROM supplier), range(1, 5) AS t(ring)")
def jn_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four readings of one ring against one to three parser rings: each answers one reading, first come first served."""
    key = F.col("s_suppkey")
    point = lambda lat, lon: F.struct(F.lit(lat).cast("double").alias("lat"), F.lit(lon).cast("double").alias("lon"))
    ring = F.array(point(0, 0), point(0, 4), point(4, 4))
    base = B.table(spark, sf_dir, "supplier").select(key.alias("id"), ring.alias("points"), F.lit("closure").alias("kind"))
    read = base.withColumn("ring", F.explode(F.sequence(F.lit(1), F.lit(4))))
    parsed = base.withColumn("ring", F.explode(F.sequence(F.lit(1), (1 + F.col("id") % 3).cast("int")))).select("id", "ring", "points")
    return A.compare_readings(read, parsed, "id")


# --- texts


@query("txt_01", "SELECT s_suppkey AS id, '\"' || s_name || '\" - it''s' || chr(10) || 'a b' AS text FROM supplier")
def txt_01(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("“"), F.col("s_name"), F.lit("” – it’s\r\na b"))
    return B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), texts.normalized(raw).alias("text"))


@query("txt_03", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE round((CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) * (o_orderkey % 89 + (o_orderkey % 60) / 60e0 + 7.5e0 / 3600), 6) END AS lat, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE round((CASE WHEN o_orderkey % 3 = 0 THEN -1 ELSE 1 END) * (o_orderkey % 179 + (o_orderkey % 50) / 60e0), 6) END AS lon FROM orders")
def txt_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of both hemispheres, decimal commas, and what is out of bounds."""
    k = F.col("o_orderkey")
    lat = F.format_string("%d° %d' 7,5\" ", _integer(F.when(k % 11 == 0, 95).otherwise(k % 89)), _integer(k % 60))
    lon = F.format_string("%d° %d' 0,0\" ", _integer(k % 179), _integer(k % 50))
    pair = F.concat(lat, F.when(k % 2 == 0, "N ").otherwise("S "), lon, F.when(k % 3 == 0, "W").when(k % 3 == 1, "E").otherwise("Ø"))
    p = F.get(texts.coordinates(pair, "dms"), F.lit(0))
    return B.table(spark, sf_dir, "orders").select(k.alias("id"), F.round(p["lat"], 6).alias("lat"), F.round(p["lon"], 6).alias("lon"))


@query("txt_04", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN ' new text' WHEN o_orderkey % 3 = 1 THEN 'old Forskriften lyder etter dette:  ' ELSE 'only text ' || o_orderkey END AS body FROM orders")
def txt_04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consolidated part of a notice, if anything stands after its mark."""
    k = F.col("o_orderkey")
    text = F.when(k % 3 == 0, "old forskriften LYDER etter dette : new text").when(k % 3 == 1, "old Forskriften lyder etter dette:  ").otherwise(F.concat(F.lit("only text "), k.cast("string")))
    return B.table(spark, sf_dir, "orders").select(k.alias("id"), texts.consolidated(text).alias("body"))


@query("txt_06", "SELECT p_partkey AS id, 2 AS areas, 5 AS points, '4,' || (7 + p_partkey % 3) AS paragraphs, round(61 + (p_partkey % 60) / 60e0, 6) AS first_lat FROM part")
def txt_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole notice: its areas, points and paragraphs."""
    k = F.col("p_partkey")
    point = lambda lat, minutes, lon: F.format_string("%d° %d,0' N %d° 30,0' E\n", F.lit(lat), _integer(minutes), F.lit(lon))
    body = F.concat(F.lit("### Vestfjorden\n§ 4. Forbod\n"), point(61, k % 60, 4), point(62, k % 60, 5), point(63, k % 60, 6), F.format_string("## Austfjorden\n§ %d. Stenging\n", _integer(7 + k % 3)), point(64, k % 60, 7), point(65, k % 60, 8), point(65, k % 60, 8))
    found = A.named_areas(B.table(spark, sf_dir, "part").select(k.alias("id"), body.alias("body")), "id")
    listed = F.sort_array(F.collect_list(F.struct("segment", "paragraph", "points")))
    whole = found.groupBy("id").agg(F.count("*").alias("areas"), F.sum(F.size("points")).alias("points"), listed.alias("all"))
    return whole.select("id", "areas", "points", F.array_join(F.transform("all", lambda a: a["paragraph"].cast("string")), ",").alias("paragraphs"), F.round(F.get(F.get("all", F.lit(0))["points"], F.lit(0))["lat"], 6).alias("first_lat"))


@query("txt_10", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 0 THEN round((CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE -1 END) * (s_suppkey % 60 + (s_suppkey % 50 + 0.1234e0) / 60e0), 8) END AS degrees FROM supplier")
def txt_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of nets in degrees and decimal minutes; anything else is null."""
    k = F.col("s_suppkey")
    text = F.concat(F.format_string("%03d°%d,1234' ", _integer(k % 60), _integer(k % 50)), F.when(k % 2 == 0, "e").otherwise("W"))
    return B.table(spark, sf_dir, "supplier").select(k.alias("id"), F.round(feeds.net_degrees(F.when(k % 5 == 0, "unknown").otherwise(text)), 8).alias("degrees"))


@query("txt_18", "SELECT c_custkey AS id, 'orn asgeir aegir thor ' || (c_custkey % 700) AS folded FROM customer")
def txt_18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without accents and punctuation, and without the mark at their end."""
    k = F.col("c_custkey")
    name = F.concat(F.lit(" Ørn-Ásgeir.  ÆGIR Þór "), (k % 700).cast("string"), F.when(k % 3 == 0, " R-0412").when(k % 3 == 1, " (VN 33)").otherwise(" "))
    return B.table(spark, sf_dir, "customer").select(k.alias("id"), C.folded_name(name).alias("folded"))


@query("txt_19", "SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE 'r' || (c_custkey % 900) || 'a' || (1 + c_custkey % 9) || 'b' END AS mark FROM customer")
def txt_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks without separators, and without zeros between a letter and a figure."""
    k = F.col("c_custkey")
    mark = F.concat(F.lit(" R-00"), F.lpad((k % 900).cast("string"), 4, "0"), F.lit(" .A_0"), (1 + k % 9).cast("string"), F.lit("b "))
    return B.table(spark, sf_dir, "customer").select(k.alias("id"), C.compact_mark(F.when(k % 10 == 0, " -. ").otherwise(mark)).alias("mark"))


@query("txt_20", "WITH " + B.COMPANIES_SQL + " SELECT company_id, coalesce(array_to_string(list_sort([upper(trim(x)) FOR x IN string_split(labels, ',')]), '|'), '') AS labels, 'Bank ' || company_id AS title, lower(name || ' ' || country) LIKE '%7 fo%' AS hit FROM company")
def txt_20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels split, a title without its prefix, and a search over two columns joined."""
    title = F.trim(F.regexp_replace(F.concat(F.lit("PoI:  Bank "), F.col("company_id").cast("string")), r"(?i)^poi:\s*", ""))
    labels = F.coalesce(F.array_join(F.array_sort(N.categories(F.col("labels"))), "|"), F.lit(""))
    return B.companies(spark, sf_dir).select("company_id", labels.alias("labels"), title.alias("title"), F.lower(F.concat_ws(" ", "name", "country")).like("%7 fo%").alias("hit"))


@query("txt_21", "SELECT doc_id, length(text) >= 25 AND doc_id % 4 <> 0 AS held FROM documents")
def txt_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all quotes of a reading stand word for word in its source; one in four has a foreign one."""
    d = F.col("doc_id")
    quotes = F.create_map(F.lit("first"), F.substring("text", 1, 10), F.lit("second"), F.when(F.length("text") >= 25, F.substring("text", 11, 15)).otherwise(F.lit("\u0001 not there")), F.lit("third"), F.when(d % 4 == 0, F.lit("\u0001 foreign")).otherwise(F.substring("text", 3, 4)))
    return B.table(spark, sf_dir, "documents").select("doc_id", texts.quotes_hold(F.col("text"), quotes).alias("held"))


_FRAGMENT = """'---' || chr(10) || 'key: case-' || case_id || chr(10) || 'state: raw' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || '- Region: ' || region || chr(10) || '- Status: ' || admin_status || chr(10) || '- Assignee: ' || coalesce(assignee::VARCHAR, 'none') || chr(10) || chr(10) || '## Revisions' || chr(10) || chr(10) || coalesce(lines, '_none_')"""


@query("txt_22", f"WITH {B.CASES_SQL}, {B.REVISIONS_SQL}, l AS (SELECT case_id, string_agg('| ' || revision_id || ' | ' || status || ' | ' || n_areas || ' |', chr(10) ORDER BY revision_id) AS lines FROM revision GROUP BY 1) SELECT case_id, sha256({_FRAGMENT}) AS hash, length({_FRAGMENT})::BIGINT AS n FROM cases LEFT JOIN (SELECT case_id, '| Revision | Status | Areas |' || chr(10) || '| --- | --- | --- |' || chr(10) || lines AS lines FROM l) USING (case_id)")
def txt_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as Markdown: front matter, facts, and a table of revisions."""
    cases = B.cases(spark, sf_dir)
    rows = fragments.table(B.revisions(spark, sf_dir), "case_id", {"Revision": "revision_id", "Status": "status", "Areas": "n_areas"}, "revision_id")
    facts = {"Region": F.col("region"), "Status": F.col("admin_status"), "Assignee": F.coalesce(F.col("assignee").cast("string"), F.lit("none"))}
    text = fragments.page({"key": F.concat(F.lit("case-"), F.col("case_id").cast("string")), "state": F.lit("raw")}, F.col("title"), facts, {"Revisions": F.coalesce("table", F.lit("_none_"))})
    return cases.join(rows, "case_id", "left").select("case_id", F.sha2(text, 256).alias("hash"), F.length(text).cast("long").alias("n"))


# --- dates


@query("dt_02", "SELECT o_orderkey AS id, epoch_us(o_orderdate::DATE::TIMESTAMP) // 1000 + CASE WHEN o_orderkey % 2 = 0 THEN 86399999 ELSE 45296000 END AS end_ms FROM orders")
def dt_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of windows: a bare date lasts to the end of its day, a time is what it is."""
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T12:34:56Z")))
    return B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.validity_end(raw).alias("end_ms"))


@query("dt_03", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 <> 0 AND o_orderdate::DATE < DATE '1995-06-15' THEN 'archived' ELSE 'current' END AS status FROM orders")
def dt_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has expired is archived, whatever its stated status; on the day of its end it has not."""
    raw = F.when(F.col("o_orderkey") % 5 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    now = F.lit(int(datetime(1995, 6, 15, 12, tzinfo=UTC).timestamp() * 1000))
    return B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.with_expiry(F.lit("current"), raw, now).alias("status"))


def _oslo_offset(seconds: str) -> str:
    """Seconds east of UTC in central Europe at an instant: an hour more between the last Sundays of March and October, 01:00 UTC."""
    day = lambda month: f"epoch(make_date(year(to_timestamp({seconds}) AT TIME ZONE 'UTC')::BIGINT, {month}, 31)::TIMESTAMP) - 86400 * (isodow(make_date(year(to_timestamp({seconds}) AT TIME ZONE 'UTC')::BIGINT, {month}, 31)) % 7) + 3600"
    return f"(CASE WHEN {seconds} >= {day(3)} AND {seconds} < {day(10)} THEN 7200 ELSE 3600 END)"


_LOCAL = "WITH t AS (SELECT o_orderkey AS id, (epoch(TIMESTAMP '2020-01-01') + (o_orderkey * 48611) % 157680000)::BIGINT AS s FROM orders)"


@query("dt_05", f"{_LOCAL}, g AS (SELECT id, s, s - {_oslo_offset('s')} AS g FROM t) SELECT id, (s - {_oslo_offset('g')})::BIGINT AS utc FROM g")
def dt_05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local wall times in UTC, over five years of summer and winter time."""
    start = int(datetime(2020, 1, 1, tzinfo=UTC).timestamp())
    local = F.timestamp_seconds(start + F.col("o_orderkey") * 48_611 % 157_680_000)
    return B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.unix_timestamp(dates.local_to_utc(local, "Europe/Oslo")).alias("utc"))


@query("dt_06", f"{_LOCAL} SELECT id, strftime((epoch_ms(((s + {_oslo_offset('s')}) * 1000)::BIGINT))::DATE + 2, '%Y-%m-%d') AS day FROM t")
def dt_06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local calendar day of an instant, two days on."""
    start = int(datetime(2020, 1, 1, tzinfo=UTC).timestamp())
    instant = F.timestamp_seconds(start + F.col("o_orderkey") * 48_611 % 157_680_000)
    return B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.date_format(dates.local_day(instant, "Europe/Oslo", 2), "yyyy-MM-dd").alias("day"))


@query("dt_10", """WITH o AS (SELECT o_orderkey AS id, o_orderdate::TIMESTAMP + to_minutes((o_orderkey % 1440)::INTEGER) AS t FROM orders)
SELECT id, CASE id % 4 WHEN 0 THEN epoch_us(t) // 1000 WHEN 1 THEN epoch_us(t) // 1000 - 3600000 END AS instant_ms, epoch_us(t - to_hours(CAST((ARRAY[6, 12, 24, 48, 168, 720, 2160])[id % 7 + 1] AS INTEGER))) // 1000 AS start_ms FROM o""")
def dt_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of preset windows before each order's time, and instants as written: only those with a zone are read."""
    k = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(mins=(k % 1440).cast("int"))
    o = B.table(spark, sf_dir, "orders").select(k.alias("id"), at.alias("t"))
    plain = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(F.col("id") % 4 == 0, F.concat(plain, F.lit("Z"))).when(F.col("id") % 4 == 1, F.concat(plain, F.lit("+01:00"))).when(F.col("id") % 4 == 2, plain).otherwise("yesterday")
    preset = F.element_at(F.array(*[F.lit(p) for p in params.PRESETS]), (F.col("id") % 7 + 1).cast("int"))
    return o.select("id", F.unix_millis(requests.instant(written)).alias("instant_ms"), F.unix_millis(requests.preset_start(F.col("t"), preset)).alias("start_ms"))


@query("dt_11", _FIX + " SELECT vessel_id, strftime(event_time, '%Y-%m-%d') AS day, date_diff('second', min(event_time), max(event_time)) AS seconds FROM fix GROUP BY 1, 2")
def dt_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole seconds between the first and the last fix of a day."""
    seconds = F.unix_timestamp(F.max("event_time")) - F.unix_timestamp(F.min("event_time"))
    return B.fixes(spark, sf_dir).groupBy("vessel_id", F.date_format("event_time", "yyyy-MM-dd").alias("day")).agg(seconds.alias("seconds"))


@query("dt_13", _FIX + " SELECT source_id, ms < epoch_us(TIMESTAMP '2024-01-16 12:00:00') // 1000 - 86400000 AS immutable FROM fix")
def dt_13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether windows that end at a fix are over for more than a day."""
    now = F.lit("2024-01-16 12:00:00").cast("timestamp")
    return B.fixes(spark, sf_dir).select("source_id", dates.immutable(F.col("event_time"), now).alias("immutable"))


# --- numbers and digests


@query("fn_02", "SELECT l_orderkey AS id, l_linenumber AS line, round(l_extendedprice / 7, 2) AS two, round(l_extendedprice / 7, 6) AS six FROM lineitem")
def fn_02(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.col("l_extendedprice") / 7
    return B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(value, 2).alias("two"), F.round(value, 6).alias("six"))


@query("fn_03", """SELECT c_custkey AS id, sha256('{"a":' || c_custkey || ',"b":' || CASE WHEN c_custkey % 3 = 0 THEN 'null' ELSE '"' || c_mktsegment || '"' END || ',"c":' || CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END || '}') AS hash FROM customer""")
def fn_03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of rows as JSON with sorted keys, nulls written out."""
    key = F.col("c_custkey")
    rows = B.table(spark, sf_dir, "customer").select((key % 2 == 0).alias("c"), key.alias("a"), F.when(key % 3 != 0, F.col("c_mktsegment")).alias("b"))
    return rows.select(F.col("a").alias("id"), S.row_hash(["c", "a", "b"]).alias("hash"))


@query("fn_08", "WITH " + ", ".join([B.RATES_SQL, B.COMPANIES_SQL]) + """ SELECT c.company_id, CASE WHEN c.currency = 'DKK' THEN c.company_id * 1000.5e0 ELSE floor(c.company_id * 1000.5e0 / f.rate * t.rate + 0.5) END AS dkk
FROM company c LEFT JOIN rate f ON f.quote = c.currency AND f.year = 1990 + c.company_id % 10 LEFT JOIN rate t ON t.quote = 'DKK' AND t.year = 1990 + c.company_id % 10""")
def fn_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts through the euro; a rate that is not known gives null."""
    rates = B.rates(spark)
    year = (1990 + F.col("company_id") % 10).cast("int")
    c = B.companies(spark, sf_dir).select("company_id", "currency", year.alias("year"), (F.col("company_id") * 1000.5).alias("amount"))
    own = rates.select("year", F.col("quote").alias("currency"), F.col("rate").alias("rate_from"))
    to = rates.filter("quote = 'DKK'").select("year", F.col("rate").alias("rate_to"))
    joined = c.join(own, ["year", "currency"], "left").join(to, "year", "left")
    return joined.select("company_id", N.converted(F.col("amount"), F.col("currency"), "DKK", F.col("rate_from"), F.col("rate_to")).alias("dkk"))


@query("fn_09", _CLOSURE + """ SELECT jm_number, len([p FOR p IN points IF p.lat > 63])::INTEGER AS north, list_bool_or([p.lon > 10 FOR p IN points]) AS some_east, list_bool_and([p.lon > -5 FOR p IN points]) AS all_east, round(list_sum([p.lat * 2 FOR p IN points]), 6) AS doubled, 6 AS flat FROM closure""")
def fn_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, some, every, map with reduce, and flat map over points."""
    p = F.col("points")
    return B.closures(spark, sf_dir).select(
        "jm_number", F.size(F.filter(p, lambda x: x["lat"] > 63)).alias("north"), F.exists(p, lambda x: x["lon"] > 10).alias("some_east"), F.forall(p, lambda x: x["lon"] > -5).alias("all_east"),
        F.round(F.aggregate(F.transform(p, lambda x: x["lat"] * 2), F.lit(0.0), lambda a, x: a + x), 6).alias("doubled"), F.size(F.flatten(F.transform(p, lambda x: F.array(x["lat"], x["lon"])))).alias("flat"),
    )


@query("fn_11", "SELECT c_custkey AS id, rtrim(translate(to_base64(encode('ø?>' || c_name || c_custkey)), '+/', '-_'), '=') AS cursor, 'ø?>' || c_name || c_custkey AS back FROM customer")
def fn_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL-safe cursors, and what they say."""
    cursor = texts.base64url(F.concat(F.lit("ø?>"), F.col("c_name"), F.col("c_custkey").cast("string")))
    return B.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), cursor.alias("cursor"), texts.from_base64url(cursor).alias("back"))


# --- feeds


@query("src_07", "SELECT user_id AS vessel_id, count(*) AS fixes, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY 1")
def src_07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixes from a source by format name and declared schema."""
    rows = feeds.read_fixes(spark, f"{sf_dir}/events.parquet", "parquet", schema="user_id long, ts timestamp_ntz")
    return rows.groupBy(F.col("user_id").alias("vessel_id")).agg(F.count("*").alias("fixes"), F.unix_millis(F.max(F.col("ts").cast("timestamp"))).alias("last_ms"))


def _workbook(rows: list[list[str | None]]) -> bytes:
    """The smallest workbook with these cells, texts shared."""
    shared = sorted({v for row in rows for v in row if v is not None})
    cell = lambda r, c, v: f'<c r="{chr(65 + c)}{r + 1}" t="s"><v>{shared.index(v)}</v></c>'
    sheet = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData>{sheet}</sheetData></worksheet>")
    return out.getvalue()


@query("src_09", "SELECT s_suppkey AS id, r::INTEGER AS row, CASE r WHEN 0 THEN 'name|note|key' WHEN 1 THEN s_name || '|a < b & c|' || s_suppkey ELSE '|Åse|' || s_nationkey END AS cells FROM supplier, range(0, 3) AS t(r)")
def src_09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of workbooks: shared texts, escaped signs, and a cell that is left out."""

    @F.pandas_udf("binary")
    def packed(name: pd.Series, key: pd.Series, nation: pd.Series) -> pd.Series:
        return pd.Series([_workbook([["name", "note", "key"], [a, "a < b & c", str(b)], [None, "Åse", str(c)]]) for a, b, c in zip(name, key, nation, strict=True)])

    files = B.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), packed("s_name", "s_suppkey", "s_nationkey").alias("content"))
    cells = feeds.workbook_cells(files)
    return cells.select(F.col("path").alias("id"), "row", F.array_join("cells", "|", "").alias("cells"))


@query("src_15", "SELECT 'J-' || s_suppkey AS jm_number, (s_suppkey % 6)::INTEGER AS paragraph, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 2 END AS n_points, CASE WHEN s_suppkey % 4 = 0 THEN 1 ELSE 0 END AS unreadable, round(60 + (s_suppkey % 50 + 0.5e0) / 60e0, 6) AS first_lat FROM supplier")
def src_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closure register with its vertices as texts; some have minutes over 59."""
    k = F.col("s_suppkey")
    payload = F.format_string('{"jmNumber":"J-%d","paragraph":%d,"name":"Area","vertices":[{"lat":"60 %d,500N","lon":"004 10,000E"},{"lat":"61 %d,000N","lon":"05 00,000W"}]}', k, _integer(k % 6), _integer(k % 50), _integer(F.when(k % 4 == 0, 75).otherwise(12)))
    found = feeds.authority_closures(B.table(spark, sf_dir, "supplier").select(payload.alias("payload")))
    return found.select("jm_number", "paragraph", F.size("points").alias("n_points"), "unreadable", F.round(F.get("points", F.lit(0))["lat"], 6).alias("first_lat"))


@query("src_19", "WITH " + B.ACCOUNTS_SQL + ", " + B.COMPANIES_SQL + " SELECT company_id, currency, count(DISTINCT year) AS reports, count(account) AS stored FROM company LEFT JOIN account USING (company_id) GROUP BY 1, 2")
def src_19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies with their reports and stored accounts."""
    joined = B.companies(spark, sf_dir).join(B.account_values(spark, sf_dir), "company_id", "left")
    return joined.groupBy("company_id", "currency").agg(F.countDistinct("year").alias("reports"), F.count("account").alias("stored"))


@query("src_22", "SELECT p_partkey AS number, p_name AS title, p_brand || '|' || p_type AS aliases FROM part WHERE p_partkey BETWEEN 100 AND 999 AND p_partkey % 4 <> 0")
def src_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of interest: a key of three figures, a title without its prefix, aliases that are text."""
    key = F.col("p_partkey")
    raw = B.table(spark, sf_dir, "part").select(F.concat(F.when(key % 4 == 0, "poi ").otherwise("poi-"), key.cast("string")).alias("key"), F.concat(F.lit("POI:"), F.col("p_name")).alias("title"), F.array(F.lit(None), F.col("p_brand"), F.col("p_type")).alias("aliases"))
    return feeds.points_of_interest(raw).select("number", "title", F.array_join("aliases", "|").alias("aliases"))


_PATCH = "WITH ev AS (SELECT o_orderkey AS seq, o_custkey AS id, o_orderkey % 2 = 0 AS name_set, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderpriority END AS name, o_orderkey % 97 = 7 AS deleted FROM orders)"


@query("snk_08", _PATCH + " SELECT id, arg_max([name], CASE WHEN name_set THEN seq END)[1] AS name FROM ev GROUP BY id HAVING NOT bool_or(deleted)")
def snk_08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches in order: fields that a patch carries change, a null clears, and what is deleted is gone."""
    k = F.col("o_orderkey")
    events = B.table(spark, sf_dir, "orders").select(k.alias("seq"), F.col("o_custkey").alias("id"), (k % 2 == 0).alias("name_set"), F.when(k % 8 != 0, F.col("o_orderpriority")).alias("name"), (k % 97 == 7).alias("deleted"))
    return S.fold_patches(events, "id", "seq", ["name"], "deleted").select("id", "name")


# --- finance and counters


@query("agg_21", ",\n".join([*finance._RESOLVED, B.COMPANIES_SQL, B.RATES_SQL, finance._money(16, "NOK")]) + " SELECT company_id, round(value, 0) AS value, row_number() OVER (ORDER BY value DESC, company_id) AS place FROM money WHERE year = 1995 AND value IS NOT NULL QUALIFY place <= 100")
def agg_21(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 companies with the highest result of a year in one currency."""
    year = N.resolve_accounts(B.account_values(spark, sf_dir).filter("year = 1995"), ["company_id", "year"])
    top = N.in_currency(year, B.companies(spark, sf_dir), B.rates(spark), 16, "NOK").filter("value IS NOT NULL").orderBy(F.desc("value"), "company_id").limit(100)
    # A hundred rows at most: one task may number them.
    place = F.expr("row_number() OVER (ORDER BY value DESC, company_id)").cast("long")
    return top.select("company_id", F.round("value", 0).alias("value"), place.alias("place"))


@query("agg_22", ",\n".join([*finance._RESOLVED, B.COMPANIES_SQL, B.RATES_SQL, finance._money(35, "EUR")]) + " SELECT company_id, string_agg(year::VARCHAR, ',' ORDER BY year) AS years, count(value) AS known, round(max(value), 0) AS highest FROM money GROUP BY company_id")
def agg_22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series of companies side by side: their years in order, and the highest value."""
    money = N.in_currency(finance._resolved(spark, sf_dir), B.companies(spark, sf_dir), B.rates(spark), 35, "EUR")
    series = money.groupBy("company_id").agg(F.sort_array(F.collect_list("year")).alias("years"), F.count("value").alias("known"), F.round(F.max("value"), 0).alias("highest"))
    return series.withColumn("years", F.array_join(F.transform("years", lambda y: y.cast("string")), ","))


@query("agg_23", "WITH " + B.COMPANIES_SQL + " SELECT category, count(*) AS companies FROM (SELECT DISTINCT company_id, upper(trim(unnest(string_split(labels, ',')))) AS category FROM company) WHERE category NOT IN ('', 'TRAWL', 'MACHINERY') GROUP BY 1")
def agg_23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Companies by category, without two categories that do not count."""
    each = B.companies(spark, sf_dir).select("company_id", F.explode(N.categories(F.col("labels"))).alias("category"))
    return each.filter(~F.col("category").isin("TRAWL", "MACHINERY")).groupBy("category").agg(F.count("*").alias("companies"))


@query("agg_24", "WITH " + places.NOTICES_SQL + """ SELECT count(*) AS scanned, count(*) FILTER (candidate) AS candidates, count(*) FILTER (candidate AND live) AS in_force, count(*) FILTER (candidate AND NOT live) AS skipped, coalesce(sum(pairs) FILTER (live), 0)::BIGINT AS read,
 coalesce(sum(pairs) FILTER (NOT live), 0)::BIGINT AS withheld, count(*) FILTER (signs > 0 AND pairs = 0) AS gaps, count(*) FILTER (disagreement) AS disagreements FROM notice""")
def agg_24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All counters of a sweep over a corpus, in one pass."""
    return sweeps.counters(places.notices(spark, sf_dir))
