"""Spatial joins and nearest neighbours against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import spatial

RING = "id long, ring array<struct<lat:double,lon:double>>"


def rings(rng, n, spread, sizes):
    """Stars of 3 to 12 corners, most of them not convex."""
    out = []
    for i in range(n):
        k = int(rng.integers(3, 13))
        r = rng.choice(sizes) * rng.uniform(0.3, 1, k)
        at = np.sort(rng.uniform(0, 2 * np.pi, k))
        lat, lon = rng.uniform(-spread, spread, 2)
        out.append((i, [(float(np.clip(lat + a * np.sin(t), -89, 89)), float(lon + a * np.cos(t))) for a, t in zip(r, at, strict=True)]))
    return out


def brute_meet(a, b):
    def side(p, q, r):
        return np.sign((q[1] - p[1]) * (r[0] - p[0]) - (q[0] - p[0]) * (r[1] - p[1]))

    def touch(p, q, r, s):
        box = all(min(p[i], q[i]) <= max(r[i], s[i]) and min(r[i], s[i]) <= max(p[i], q[i]) for i in (0, 1))
        return box and side(p, q, r) * side(p, q, s) <= 0 and side(r, s, p) * side(r, s, q) <= 0

    def inside(p, ring):
        odd = False
        for u, v in zip(ring, ring[1:] + ring[:1], strict=True):
            if (u[0] > p[0]) != (v[0] > p[0]) and p[1] < (v[1] - u[1]) * (p[0] - u[0]) / (v[0] - u[0]) + u[1]:
                odd = not odd
        return odd

    edges = lambda ring: list(zip(ring, ring[1:] + ring[:1], strict=True))
    return any(touch(*e, *f) for e in edges(a) for f in edges(b)) or inside(a[0], b) or inside(b[0], a)


@pytest.mark.parametrize(("seed", "refine"), [(1, 0), (2, 1), (3, 3)])
def test_pairs_match_brute_force(spark, seed, refine):
    """Small and large rings, one around all others, copies; each pair comes once, whatever the cells are."""
    rng = np.random.default_rng(seed)
    left = rings(rng, 60, 12, [0.05, 0.6, 4.0]) + [(900, [(-60.0, -80.0), (60.0, -80.0), (60.0, 80.0), (-60.0, 80.0)]), (901, [(1.0, 1.0), (1.0, 2.0), (2.0, 2.0), (2.0, 1.0)])]
    right = rings(rng, 50, 12, [0.02, 0.5, 6.0]) + [(800, left[3][1]), (801, [(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (2.0, 2.0)])]
    frame = lambda rows, key: spark.createDataFrame([*rows, (None, None), (-1, [])], RING).withColumnRenamed("id", key).repartition(3)
    found = spatial.meeting_pairs(frame(left, "a"), frame(right, "b"), "a", "b", refine=refine)
    want = sorted((i, j) for i, r in left for j, s in right if brute_meet(r, s))
    assert (901, 801) in want and len(want) > 100 and sorted(tuple(r) for r in found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_cells_within_a_ring_are_marked(spark):
    ring = [(0.0, 0.0), (0.0, 40.0), (40.0, 40.0), (40.0, 0.0)]
    cells = spark.createDataFrame([(1, ring)], RING).select(F.explode(spatial.cover("ring", refine=3)).alias("c")).select("c.*").collect()
    assert any(c.inside for c in cells) and not all(c.inside for c in cells)
    for c in cells:
        size = 180 / 2**c.depth
        west, south = c.ix * size - 180, c.iy * size - 90
        within = 0 <= west and west + size <= 40 and 0 <= south and south + size <= 40
        assert within or not c.inside
    # The cells hold the ring's area: each point of it lies in one.
    at = {(c.depth, c.ix, c.iy) for c in cells}
    for lat, lon in np.random.default_rng(0).uniform(0.1, 39.9, (200, 2)):
        assert any((d, math.floor((lon + 180) / (180 / 2**d)), math.floor((lat + 90) / (180 / 2**d))) in at for d in range(15))


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_match_brute_force(spark, k):
    """A crowded place, far places, both sides of the date line, the poles, ties and missing coordinates."""
    rng = np.random.default_rng(k)
    features = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(50, 60, 150), rng.uniform(-10, 10, 150), strict=True))]
    features += [(200 + i, 55.0, 5.0) for i in range(60)] + [(300, 10.0, 179.9), (301, 10.0, -179.8), (302, 89.9, 100.0), (303, 88.0, -80.0), (304, -89.5, 0.0), (305, -40.0, -120.0), (306, 90.0, 0.0)]
    queries = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(48, 62, 40), rng.uniform(-12, 12, 40), strict=True))]
    queries += [(100, 10.0, 180.0), (101, 10.0, -180.0), (102, 90.0, 12.0), (103, 89.5, -170.0), (104, -90.0, 77.0), (105, 0.0, 0.0), (106, 55.0, 5.0), (107, -40.0, 60.0), (108, 11.0, -179.99)]
    f = spark.createDataFrame([*features, (999, None, 1.0)], "feature long, lat double, lon double").repartition(3)
    q = spark.createDataFrame([*queries, (998, 1.0, None)], "query long, lat double, lon double").repartition(3)
    found = {}
    for r in spatial.nearest(q, f, "query", "feature", k).collect():
        found.setdefault(r["query"], {})[r["rank"]] = (r.feature, r.km)
    assert set(found) == {i for i, _, _ in queries}
    for i, lat, lon in queries:
        want = sorted((round(km((lat, lon), (a, b)) * 1e6), j) for j, a, b in features)[:k]
        assert [(round(d * 1e6), j) for j, d in (found[i][n] for n in range(1, k + 1))] == want, i


def test_nearest_with_few_features(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0)], "query long, lat double, lon double")
    f = spark.createDataFrame([(7, 80.0, 170.0), (8, -80.0, 10.0)], "feature long, lat double, lon double")
    assert [(r["rank"], r.feature) for r in spatial.nearest(q, f, "query", "feature", 5).orderBy("rank").collect()] == [(1, 8), (2, 7)]
    assert spatial.nearest(q, f.limit(0), "query", "feature", 5).count() == 0 == spatial.nearest(q.limit(0), f, "query", "feature", 5).count()


def test_rings_are_judged_many_at_a_time():
    """As many pairs as a batch holds, with different numbers of corners, in one call for each pair of numbers."""
    rng = np.random.default_rng(5)
    square = np.array([(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)])
    shift = rng.uniform(-2, 2, (5000, 1, 2))
    met = spatial._rings_meet(np.broadcast_to(square, (5000, 4, 2)), square[:3] * 0.5 + shift)
    y, x = shift[:, 0, 0], shift[:, 0, 1]
    # A triangle of half the side, its right angle above: what is left free is below its slope.
    assert met[(np.abs(y - 0.25) < 0.7) & (np.abs(x - 0.25) < 0.2)].all() and not met[(y > 1) | (x > 1) | (y < -0.5) | (x < -0.5)].any()


def test_queries_at_one_place_look_once(spark, rows, monkeypatch):
    """Queries that share a place are searched for as one and all get its features; their keys may repeat."""
    seen, written = [], spatial._written

    def counting(df, label):
        out = written(df, label)
        seen.extend([out.count()] if label == "nearest-queries" else [])
        return out

    monkeypatch.setattr(spatial, "_written", counting)
    asked = spark.createDataFrame([(i, 60.0 + i % 2, 5.0) for i in range(400)], "q long, lat double, lon double")
    known = spark.createDataFrame([(1, 60.1, 5.0), (2, 61.2, 5.0)], "f long, lat double, lon double")
    found = spatial.nearest(asked, known, "q", "f", 1)
    assert rows(found.select("q", "rank", "f")) == sorted([(i, 1, 1 + i % 2) for i in range(400)], key=repr) and seen == [2]


def test_rings_with_the_same_corners_are_judged_once(spark, rows, monkeypatch):
    """Rows share a ring on both sides, keys repeat, a ring that begins elsewhere is another: each row has its pairs, each different ring one cover."""
    seen, written = {}, spatial._written

    def counting(df, label):
        out = written(df, label)
        seen[label] = out.count()
        return out

    monkeypatch.setattr(spatial, "_written", counting)
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0)]
    far, turned = [(y + 9.0, x) for y, x in square], square[1:] + square[:1]
    left = [(i, (square, far)[i % 2]) for i in range(200)] + [(0, square), (900, turned), (901, None), (902, [])]
    right = [(i, [(y + 0.5, x - 0.5) for y, x in square]) for i in range(7)] + [(7, [(8.5, 0.2), (9.5, 0.2), (9.0, 0.8)])]
    found = spatial.meeting_pairs(spark.createDataFrame(left, RING).withColumnRenamed("id", "a"), spark.createDataFrame(right, RING).withColumnRenamed("id", "b"), "a", "b")
    want = [(i, j) for i, ring in left for j in range(8) if ring and (ring is far) == (j == 7)]
    assert rows(found) == sorted(want, key=repr) and (seen["cover-a"], seen["cover-b"], seen["cover-pairs"]) == (3, 2, 3)
