"""Geometry as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two contracts, two radii (km): the mean radius for hover areas, the rounded one for run distances.
EARTH_KM_HOVER = 6371.0088
EARTH_KM_RUNS = 6371.0

Ring = Sequence[tuple[float, float]]


def in_bbox(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Inside (min lon, min lat, max lon, max lat), edges included."""
    return lat.between(box[1], box[3]) & lon.between(box[0], box[2])


def in_ring(lon: Column, lat: Column, ring: Ring) -> Column:
    """Even-odd rule over a constant ring of (lon, lat); its bounding box is tested first."""
    points = list(ring)
    if points[0] == points[-1]:
        points = points[:-1]
    crossings = F.lit(0)
    for (xi, yi), (xj, yj) in zip(points, points[-1:] + points[:-1], strict=True):
        if yi == yj:
            continue
        at = (lat - yi) * ((xj - xi) / (yj - yi)) + xi
        crossings = crossings + F.when(((F.lit(yi) > lat) != (F.lit(yj) > lat)) & (lon < at), 1).otherwise(0)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return in_bbox(lon, lat, (min(xs), min(ys), max(xs), max(ys))) & (crossings % 2 == 1)


def in_any_ring(lon: Column, lat: Column, rings: Sequence[Ring]) -> Column:
    out = F.lit(False)
    for ring in rings:
        out = out | in_ring(lon, lat, ring)
    return out


def haversine_asin(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM_HOVER) -> Column:
    """Great-circle distance, arcsine form; the argument is clamped, as rounding may push it over 1."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def haversine_atan2(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_KM_RUNS) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def cell_index(value: Column, size: float) -> Column:
    return F.floor(value / F.lit(size))


def cell_centre(index: Column, size: float) -> Column:
    return F.round((index + 0.5) * F.lit(size), 3)


def snapped(value: Column, size: float) -> Column:
    """Nearest multiple of ``size``, halves to even."""
    return F.bround(value / F.lit(size)) * F.lit(size)


def mercator_x(lon: Column) -> Column:
    return F.radians(lon) * 6378137.0


def mercator_y(lat: Column) -> Column:
    return F.log(F.tan(F.radians(lat) / 2 + F.lit(0.7853981633974483))) * 6378137.0


def bbox_of(points: Column) -> Column:
    """Bounding box of an array of (lat, lon) structs."""
    lats, lons = F.transform(points, lambda p: p["lat"]), F.transform(points, lambda p: p["lon"])
    return F.struct(F.array_min(lats).alias("min_lat"), F.array_max(lats).alias("max_lat"), F.array_min(lons).alias("min_lon"), F.array_max(lons).alias("max_lon"))


def centroid_of(points: Column) -> Column:
    """Plain mean of the vertices."""
    n = F.size(points)
    mean = lambda name: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[name]) / n
    return F.struct(mean("lat").alias("lat"), mean("lon").alias("lon"))


def multipoint_wkt(points: Column) -> Column:
    """``MULTIPOINT((lon lat), ...)`` with six decimals; points that are not finite go, and no point left means null."""
    finite = F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull() & ~F.isnan(p["lat"]) & ~F.isnan(p["lon"]) & (F.abs(p["lat"]) < float("inf")) & (F.abs(p["lon"]) < float("inf")))
    text = F.transform(finite, lambda p: F.format_string("(%.6f %.6f)", p["lon"], p["lat"]))
    return F.when(F.size(finite) > 0, F.concat(F.lit("MULTIPOINT("), F.array_join(text, ", "), F.lit(")")))


def points_in_bbox(points: Column, box: tuple[float, float, float, float]) -> Column:
    return F.exists(points, lambda p: in_bbox(p["lon"], p["lat"], box))


def nearest_km(points: Column, lat: float, lon: float) -> Column:
    """Distance of the nearest vertex to a point."""
    return F.array_min(F.transform(points, lambda p: haversine_asin(F.lit(lat), F.lit(lon), p["lat"], p["lon"])))


def ring_area_deg2(ring: Column) -> Column:
    """Shoelace area of a ring of (lat, lon), in square degrees."""
    n = F.size(ring)
    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + F.get(ring, i)["lon"] * F.get(ring, F.pmod(i + 1, n))["lat"] - F.get(ring, F.pmod(i + 1, n))["lon"] * F.get(ring, i)["lat"])
    return F.abs(total) / 2


def without_near_repeats(points: Column, none: Column | None = None, eps: float = 1e-4) -> Column:
    """Points of (lat, lon) in order, without those within ``eps`` degrees, in both directions, of one that stays. (``none``: an empty array, where ``points`` costs.)"""
    near = lambda a, b: (F.abs(a["lat"] - b["lat"]) < eps) & (F.abs(a["lon"] - b["lon"]) < eps)
    return F.aggregate(points, F.slice(points, 1, 0) if none is None else none, lambda kept, p: F.when(F.exists(kept, lambda k: near(k, p)), kept).otherwise(F.array_append(kept, p)))


def rings_equal(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """Whether two open rings have the same vertices in the same order, each within ``eps`` degrees."""
    far = lambda z: (F.abs(z["a"]["lat"] - z["b"]["lat"]) > eps) | (F.abs(z["a"]["lon"] - z["b"]["lon"]) > eps)
    return (F.size(a) == F.size(b)) & ~F.exists(F.arrays_zip(a.alias("a"), b.alias("b")), far)


def bbox_area_deg2(points: Column) -> Column:
    b = bbox_of(points)
    return (b["max_lat"] - b["min_lat"]) * (b["max_lon"] - b["min_lon"])


def points_from_wkt(text: Column) -> Column:
    """Points (lat, lon) of a POINT, MULTIPOINT, LINESTRING or of the rings of a POLYGON, in order."""
    number = r"-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
    pairs = F.regexp_extract_all(text, F.lit(rf"{number}\s+{number}"), F.lit(0))
    part = lambda m, i: F.get(F.split(m, r"\s+"), F.lit(i)).cast("double")
    return F.transform(pairs, lambda m: F.struct(part(m, 1).alias("lat"), part(m, 0).alias("lon")))


def multipoint_geojson(points: Column) -> Column:
    """``{"type":"MultiPoint","coordinates":[[lon,lat],...]}`` with six decimals at most."""
    return F.to_json(F.struct(F.lit("MultiPoint").alias("type"), _positions(points).alias("coordinates")))


def points_from_geojson(text: Column) -> Column:
    """Points (lat, lon) of a GeoJSON MultiPoint or LineString; null for what is neither."""
    parsed = F.from_json(text, "struct<type:string,coordinates:array<array<double>>>")
    points = F.transform(parsed["coordinates"], lambda c: F.struct(F.get(c, F.lit(1)).alias("lat"), F.get(c, F.lit(0)).alias("lon")))
    return F.when(parsed["type"].isin("MultiPoint", "LineString"), points)


def _positions(points: Column) -> Column:
    return F.transform(points, lambda p: F.array(F.round(p["lon"], 6), F.round(p["lat"], 6)))


def feature_collection(areas: Column) -> Column:
    """GeoJSON of an array of (name, points): a MultiPoint feature for each area with points; null where no area has any."""
    feature = lambda a: F.struct(
        F.lit("Feature").alias("type"), F.struct(a["name"].alias("name")).alias("properties"), F.struct(F.lit("MultiPoint").alias("type"), _positions(a["points"]).alias("coordinates")).alias("geometry")
    )
    features = F.transform(F.filter(areas, lambda a: F.size(a["points"]) > 0), feature)
    text = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), features.alias("features")), {"ignoreNullFields": "false"})
    return F.when(F.size(features) > 0, text)


def thinned(points: Column, most: int | Column) -> Column:
    """``most`` elements of an array at even strides, both ends kept; a shorter array as it is."""
    wanted = F.lit(most) if isinstance(most, int) else most
    stride = (F.size(points) - 1) / F.nullif(wanted - 1, F.lit(0))
    picked = F.transform(F.sequence(F.lit(0), F.greatest(wanted - 1, F.lit(0))), lambda i: F.get(points, F.floor(i * stride + 0.5).cast("int")))
    return F.when(F.size(points) <= wanted, points).when(wanted < 2, F.slice(points, F.lit(1), wanted)).otherwise(picked)
