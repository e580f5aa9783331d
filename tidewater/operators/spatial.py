"""Spatial joins by hierarchical cells.

A cell of depth ``d`` is a square of 180 / 2**d degrees; it has four children of depth ``d + 1``. Cells are structs ``depth``, ``ix``, ``iy``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import geo
from tidewater.session import written as _written

#: The deepest cells have sides of about a kilometre.
DEEPEST = 14


def _size(depth: Column) -> Column:
    return F.lit(180.0) / F.pow(F.lit(2.0), depth)


def _index(degrees: Column, depth: Column, south: float) -> Column:
    """Column (``south`` = -180) or row (-90) of a coordinate; the last one takes the edge of the world."""
    cells = F.pow(F.lit(2.0), depth) * (-south / 90.0)
    return F.greatest(F.least(F.floor((degrees - south) / _size(depth)), cells - 1), F.lit(0)).cast("int")


def cell(lat: Column, lon: Column, depth: int | Column) -> Column:
    d = F.lit(depth) if isinstance(depth, int) else depth
    return F.struct(d.cast("int").alias("depth"), _index(lon, d, -180.0).alias("ix"), _index(lat, d, -90.0).alias("iy"))


def _edges_meet_boxes(lat: np.ndarray, lon: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Whether some edge of each ring (``lat``, ``lon``: rings, corners) meets its box (west, south, east, north): the part of the edge between the four sides is not empty."""
    dx, dy = np.roll(lon, -1, 1) - lon, np.roll(lat, -1, 1) - lat
    low, high = np.zeros(lat.shape), np.ones(lat.shape)
    outside = np.zeros(lat.shape, dtype=bool)
    west, south, east, north = (boxes[:, i, None] for i in range(4))
    with np.errstate(divide="ignore", invalid="ignore"):
        for p, q in ((-dx, lon - west), (dx, east - lon), (-dy, lat - south), (dy, north - lat)):
            t = q / p
            low = np.where(p < 0, np.maximum(low, t), low)
            high = np.where(p > 0, np.minimum(high, t), high)
            outside |= (p == 0) & (q < 0)
    return (~outside & (low <= high)).any(1)


def _points_in_rings(y: np.ndarray, x: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Even-odd rule for a point of each ring (``lat``, ``lon``: rings, corners)."""
    lat2, lon2 = np.roll(lat, -1, 1), np.roll(lon, -1, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (lon2 - lon) * (y[:, None] - lat) / (lat2 - lat) + lon
    return (((lat > y[:, None]) != (lat2 > y[:, None])) & (x[:, None] < at)).sum(1) % 2 == 1


def _covers(lat: np.ndarray, lon: np.ndarray, refine: int, deepest: int) -> list[np.ndarray]:
    """Cells of rings with the same number of corners (``lat``, ``lon``: rings, corners), all rings at a time: ring, depth, column, row, inside."""
    span = np.maximum(np.maximum(np.ptp(lon, 1), np.ptp(lat, 1)), 1e-9)
    first = np.clip(np.floor(np.log2(180.0 / span)), 0, deepest).astype(np.int64)

    def ends(low: np.ndarray, high: np.ndarray, south: float) -> tuple[np.ndarray, np.ndarray]:
        size, last = 180.0 / 2.0**first, 2**first * round(-south / 90.0) - 1
        west, east = (np.clip(np.floor((v - south) / size).astype(np.int64), 0, last) for v in (low, high))
        return west, east

    (x0, x1), (y0, y1) = ends(lon.min(1), lon.max(1), -180.0), ends(lat.min(1), lat.max(1), -90.0)
    # The box around a ring is no longer than a cell, up to rounding, so it meets two columns and rows, or three.
    steps = range(int(max((x1 - x0).max(initial=0), (y1 - y0).max(initial=0))) + 1)
    at = np.concatenate([np.stack([np.flatnonzero(some), (x0 + i)[some], (y0 + j)[some]]) for i in steps for j in steps for some in [(x0 + i <= x1) & (y0 + j <= y1)]], 1)
    done = []
    for step in range(refine + 1):
        ring, ix, iy = at
        depth = first[ring] + step
        size = 180.0 / 2.0**depth
        west, south = ix * size - 180.0, iy * size - 90.0
        edge = _edges_meet_boxes(lat[ring], lon[ring], np.stack([west, south, west + size, south + size], 1))
        within = _points_in_rings(south, west, lat[ring], lon[ring])
        last = (depth == deepest) | (step == refine)
        kept, more = (edge | within) & (last | ~edge), edge & ~last
        done.append(np.stack([ring, depth, ix, iy, within & ~edge])[:, kept])
        at = np.concatenate([np.stack([ring, 2 * ix + i, 2 * iy + j])[:, more] for i in (0, 1) for j in (0, 1)], 1)
    return list(np.concatenate(done, 1))


def _corners(rings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a column of rings: where each begins, how many corners it has, and the latitudes and longitudes of all."""
    at, flat = rings.offsets.to_numpy(), rings.values
    lat, lon = (flat.field(flat.type.get_field_index(name)).to_numpy(zero_copy_only=False) for name in ("lat", "lon"))
    return at[:-1], np.diff(at), lat, lon


def cover(ring: Column | str, refine: int = 1, deepest: int = DEEPEST, most: int = 1 << 16) -> Column:
    """Cells of mixed depth that hold a ring of (lat, lon), each with ``inside``: the cell lies within the ring.

    The search starts with the up to four cells that hold the box around the ring. Cells that the ring does not meet go; those that its edges meet
    are cut into their children ``refine`` times. Rings with the same number of corners are covered together, up to ``most`` corners at a time.
    """

    @F.arrow_udf("array<struct<depth:int,ix:int,iy:int,inside:boolean>>")
    def found(rings: pa.Array) -> pa.Array:
        starts, sizes, lat, lon = _corners(rings)
        cells = [np.zeros((5, 0), dtype=np.int64)]
        for n in np.unique(sizes[sizes > 0]).tolist():
            alike = np.flatnonzero(sizes == n)
            for some in np.array_split(alike, -(-len(alike) * n // most)):
                corner = starts[some, None] + np.arange(n)
                part, *rest = _covers(lat[corner], lon[corner], refine, deepest)
                cells.append(np.stack([some[part], *rest]))
        owner, depth, ix, iy, inside = np.concatenate(cells, 1)
        order = np.argsort(owner, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
        fields = [pa.array(v[order].astype(np.int32)) for v in (depth, ix, iy)] + [pa.array(inside[order] == 1)]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, names=["depth", "ix", "iy", "inside"]))

    return found(ring)


def _rings_meet(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rings meet, pair by pair: edges that touch, or one within the other. ``a`` and ``b``: pairs, corners, (lat, lon)."""
    (ya, xa), (yb, xb) = ((np.ascontiguousarray(r[..., 0]), np.ascontiguousarray(r[..., 1])) for r in (a, b))
    after = lambda v: np.roll(v, -1, 1)

    def sides(y: np.ndarray, x: np.ndarray, v: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Pairs, edges of the first, corners of the second: whether an edge has a corner and the one after it not on one side."""
        dy, dx = (after(y) - y)[:, :, None], (after(x) - x)[:, :, None]
        side = np.sign(dy * (u[:, None] - x[:, :, None]) - dx * (v[:, None] - y[:, :, None])).astype(np.int8)
        return side * np.roll(side, -1, 2) <= 0

    def overlap(p: np.ndarray, r: np.ndarray) -> np.ndarray:
        q, s = after(p), after(r)
        return (np.minimum(p, q)[:, :, None] <= np.maximum(r, s)[:, None]) & (np.minimum(r, s)[:, None] <= np.maximum(p, q)[:, :, None])

    touch = overlap(ya, yb) & overlap(xa, xb)
    if touch.any():
        touch &= sides(ya, xa, yb, xb) & sides(yb, xb, ya, xa).transpose(0, 2, 1)
    return touch.any((1, 2)) | _points_in_rings(ya[:, 0], xa[:, 0], yb, xb) | _points_in_rings(yb[:, 0], xb[:, 0], ya, xa)


def rings_meet(a: Column | str, b: Column | str, most: int = 1 << 16) -> Column:
    """Whether two rings have a point in common. Pairs with the same numbers of corners are judged together, up to ``most`` pairs of edges at a time."""

    @F.arrow_udf("boolean")
    def met(left: pa.Array, right: pa.Array) -> pa.Array:
        (at_a, size_a, *a), (at_b, size_b, *b) = _corners(left), _corners(right)
        found = np.zeros(len(size_a), dtype=bool)
        sizes, kind = np.unique(np.stack([size_a, size_b], 1), axis=0, return_inverse=True)
        for i, (n, m) in enumerate(sizes.tolist()):
            alike = np.flatnonzero(kind == i)
            for some in np.array_split(alike, -(-len(alike) * n * m // most)):
                one, other = at_a[some, None] + np.arange(n), at_b[some, None] + np.arange(m)
                found[some] = _rings_meet(np.stack([v[one] for v in a], -1), np.stack([v[other] for v in b], -1))
        return pa.array(found)

    return met(a, b)


def _up(index: Column, steps: Column) -> Column:
    return F.call_function("shiftright", index, steps)


def _holds(a: Column, b: Column) -> Column:
    """Whether cell ``a`` is ``b`` or above it."""
    steps = F.greatest(b["depth"] - a["depth"], F.lit(0))
    return (a["depth"] <= b["depth"]) & (_up(b["ix"], steps) == a["ix"]) & (_up(b["iy"], steps) == a["iy"])


def _above(c: Column, depths: list[int], strictly: bool) -> Column:
    """The cells of some depths that hold ``c``."""
    some = F.filter(F.array(*[F.lit(d) for d in depths]), lambda d: (d < c["depth"]) if strictly else (d <= c["depth"]))
    return F.transform(some, lambda d: F.struct(d.alias("depth"), _up(c["ix"], c["depth"] - d).alias("ix"), _up(c["iy"], c["depth"] - d).alias("iy")))


def meeting_pairs(left: DataFrame, right: DataFrame, left_key: str, right_key: str, ring: str = "ring", refine: int = 1) -> DataFrame:
    """``left_key``, ``right_key`` of the rings of two tables that have a point in common; each pair once.

    Rings with the same corners are one ring until the end: each different one is covered and judged once, and the rows that have it come in with the pairs.
    Both sides are covered, and the covers written, by cells of mixed depth. A cell meets those of the other side that are the same, above or below it: two equi-joins,
    of cells with the other side's cells and what is above them. Of a pair that shares several cells one row is left, and only
    rings' numbers and boxes go that way; where a ring holds the whole of the other's cell they meet for certain, and elsewhere the rings themselves decide. Null and
    empty rings meet nothing; rings do not cross the date line. Keys may repeat: rows are compared as they are.
    """

    def covered(df: DataFrame, key: str, name: str) -> tuple[DataFrame, DataFrame]:
        rows = _written(df.filter(F.size(ring) > 0).select(F.col(key).alias(f"{name}_key"), F.col(ring).alias(f"{name}_ring")), f"rows-{name}")
        # Small tables come in one part; covers are found in many.
        different = rows.select(f"{name}_ring").distinct().repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), f"{name}_ring")
        box = geo.bbox_of(F.col(f"{name}_ring"))
        rings = _written(different.select("*", F.monotonically_increasing_id().alias(f"{name}_row"), box.alias(f"{name}_box"), cover(f"{name}_ring", refine).alias(f"{name}_cover")), f"cover-{name}")
        return rings, rows.join(rings.select(f"{name}_row", f"{name}_ring"), f"{name}_ring").select(f"{name}_row", f"{name}_key")

    def depths(df: DataFrame, name: str) -> list[int]:
        return sorted(r[0] for r in df.select(F.col(f"{name}_cell.depth")).distinct().collect())

    (rings_a, rows_a), (rings_b, rows_b) = covered(left, left_key, "a"), covered(right, right_key, "b")
    cells = lambda rings, name: rings.select(f"{name}_row", f"{name}_box", F.explode(f"{name}_cover").alias(f"{name}_cell"))
    a, b = cells(rings_a, "a"), cells(rings_b, "b")
    plain = lambda c: F.struct(c["depth"].alias("depth"), c["ix"].alias("ix"), c["iy"].alias("iy"))
    own = lambda df, name: df.withColumn("at", plain(F.col(f"{name}_cell")))
    over = lambda df, name, ds, strictly: df.withColumn("at", F.explode(_above(F.col(f"{name}_cell"), ds, strictly)))
    met = own(a, "a").join(over(b, "b", depths(a, "a"), False), "at").unionByName(over(a, "a", depths(b, "b"), True).join(own(b, "b"), "at"))
    ca, cb, box_a, box_b = (F.col(c) for c in ("a_cell", "b_cell", "a_box", "b_box"))
    boxes_meet = (box_a["min_lat"] <= box_b["max_lat"]) & (box_b["min_lat"] <= box_a["max_lat"]) & (box_a["min_lon"] <= box_b["max_lon"]) & (box_b["min_lon"] <= box_a["max_lon"])
    certain = (ca["inside"] & _holds(ca, cb)) | (cb["inside"] & _holds(cb, ca))
    pairs = _written(met.filter(boxes_meet).groupBy("a_row", "b_row").agg(F.max(certain).alias("certain")), "cover-pairs")
    shapes = pairs.filter("NOT certain").join(rings_a.select("a_row", "a_ring"), "a_row").join(rings_b.select("b_row", "b_ring"), "b_row")
    meeting = pairs.filter("certain").select("a_row", "b_row").unionByName(shapes.filter(rings_meet("a_ring", "b_ring")).select("a_row", "b_row"))
    return meeting.join(rows_b, "b_row").join(rows_a, "a_row").select(F.col("a_key").alias(left_key), F.col("b_key").alias(right_key))


def _beyond_km(lat: Column, lon: Column, depth: int, radius: float) -> Column:
    """Nothing outside the nine cells around a point is nearer than this."""
    size, columns, rows = 180.0 / 2**depth, 2 ** (depth + 1), 2**depth
    ix, iy = _index(lon, F.lit(depth), -180.0), _index(lat, F.lit(depth), -90.0)
    endless = F.lit(1e9)
    south = F.when(iy > 0, F.radians(lat - ((iy - 1) * size - 90.0))).otherwise(endless)
    north = F.when(iy < rows - 1, F.radians((iy + 2) * size - 90.0 - lat)).otherwise(endless)
    aside = F.least(lon - ((ix - 1) * size - 180.0), (ix + 2) * size - 180.0 - lon)
    # The way to a meridian; beyond a right angle the pole is nearer than the meridian's foot.
    across = F.when(aside < 90.0, F.asin(F.sin(F.radians(aside)) * F.cos(F.radians(lat)))).otherwise(F.radians(90.0 - F.abs(lat)))
    return F.least(south, north, endless if columns <= 3 else across) * radius


def nearest(queries: DataFrame, features: DataFrame, query_key: str, feature_key: str, k: int, radius: float = geo.EARTH_KM_HOVER) -> DataFrame:
    """``query_key``, ``rank``, ``feature_key``, ``km``: the ``k`` nearest features of every query (both with ``lat``, ``lon``), nearest first.

    Distances are great-circle and compared in whole millimetres, ties by key. A query first looks at the nine small cells around it.
    If its k-th distance is no more than the way out of them, it is done; the others look again in cells of twice
    the side, until the cells are the world. Every round is an equi-join by cell and is written, and only open queries go on. Date line and poles
    are met like any place. Of features at one place only the first ``k`` come in, so a crowded place costs no more than ``k`` rows,
    and queries at one place look once: their rows come in at the end.

    With fewer than ``k`` features each query has them all; places without latitude or longitude give no row.
    """
    crowd = Window.partitionBy("lat", "lon").orderBy(feature_key)
    known = features.filter("lat IS NOT NULL AND lon IS NOT NULL").select(feature_key, "lat", "lon").withColumn("n", F.row_number().over(crowd)).filter(F.col("n") <= k).drop("n")

    known = _written(known.select(F.col(feature_key).alias("_feature"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "nearest-features")
    asking = queries.filter("lat IS NOT NULL AND lon IS NOT NULL").select(F.col(query_key).alias("_query"), (F.col("lat") + 0.0).alias("lat"), (F.col("lon") + 0.0).alias("lon"))
    open_ = _written(asking.select("lat", "lon").distinct(), "nearest-queries")
    count = known.count()
    depth = min(DEEPEST, 2 + math.ceil(math.log(max(count / k, 1), 4)))
    parts = []
    while True:
        columns, rows = 2 ** (depth + 1), 2**depth
        mid = cell(F.col("lat"), F.col("lon"), depth)
        around = [F.struct(F.pmod(mid["ix"] + dx, F.lit(columns)).alias("ix"), (mid["iy"] + dy).alias("iy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
        asked = open_.withColumn("_at", F.explode(F.array_distinct(F.array(*around)))).filter(F.col("_at.iy").between(0, rows - 1))
        there = cell(F.col("_lat"), F.col("_lon"), depth)
        held = known.withColumn("_at", F.struct(there["ix"].alias("ix"), there["iy"].alias("iy")))
        km = geo.haversine_asin(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon"), radius)
        met = asked.join(held, "_at").withColumn("mm", F.round(km * 1e6).cast("long"))
        order = Window.partitionBy("lat", "lon").orderBy("mm", "_feature")
        best = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = best.groupBy("lat", "lon").agg(F.sort_array(F.collect_list(F.struct("rank", "_feature", "mm"))).alias("best"))
        sure = F.lit(True) if depth == 0 else (F.size("best") == k) & (F.element_at("best", -1)["mm"] < F.floor(_beyond_km(F.col("lat"), F.col("lon"), depth, radius) * 1e6) - 1)
        done = _written(best.filter(sure), "nearest-done")
        parts.append(done)
        if depth == 0:
            break
        open_ = _written(open_.join(done.select("lat", "lon"), ["lat", "lon"], "left_anti"), "nearest-open")
        if open_.isEmpty():
            break
        depth -= 1
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = asking.join(found, ["lat", "lon"]).select("_query", F.explode("best").alias("b"))
    return found.select(F.col("_query").alias(query_key), F.col("b.rank").alias("rank"), F.col("b._feature").alias(feature_key), (F.col("b.mm") / 1e6).alias("km"))
