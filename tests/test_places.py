"""Joins by place against brute force."""

import math
import random

from pyspark.sql import functions as F

from gridlake.operators import ordered, places

BOX = "x0 double, y0 double, x1 double, y1 double"


def boxes(rng, n):
    out = []
    for i in range(n):
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        size = rng.choice([0.0, 0.01, 1.0, 9.0, 300.0])
        out.append((i, x, y, x + size * rng.random(), y + size * rng.random()))
    return out


def test_each_overlapping_pair_is_reported_once(spark):
    rng = random.Random(1)
    left = [*boxes(rng, 150), (900, None, 0.0, 1.0, 1.0), (901, 5.0, 5.0, 4.0, 6.0), (902, 0.0, 0.0, 8.0, 8.0), (903, -1e6, -1e6, 1e6, 1e6)]
    right = [*boxes(rng, 150), (902, 8.0, 8.0, 16.0, 16.0), (904, 4.0, 4.0, 4.0, 4.0), (905, -1e6, 2.0, 1e6, 2.0)]
    got = places.overlapping(spark.createDataFrame(left, f"id int, {BOX}"), spark.createDataFrame(right, f"key int, {BOX}")).collect()
    usable = lambda t: [b for b in t if b[1] is not None and b[1] <= b[3] and b[2] <= b[4]]
    want = {(a[0], b[0]) for a in usable(left) for b in usable(right) if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_first_valid_source_and_empty_tables(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0), (2, 9.0, 9.0, 9.0, 9.0)], f"id int, {BOX}")
    sources = spark.createDataFrame([(7, 2, True, -1.0, -1.0, 1.0, 1.0), (8, 1, False, -1.0, -1.0, 1.0, 1.0), (9, 2, True, 0.0, 0.0, 1.0, 1.0)], f"key int, rank int, ok boolean, {BOX}")
    found = places.first_valid(places.overlapping(points, sources), sources.drop(*places.BOX), "rank", F.col("ok"), "rank")
    assert [tuple(r) for r in found.collect()] == [(1, 7, 2)]
    assert places.overlapping(points.limit(0), sources).count() == 0


def test_points_in_polygons_with_holes_and_several_rings(spark):
    rng = random.Random(2)
    rings = {}
    for p in range(12):
        x, y, r = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.choice([0.05, 1.0, 4.0])
        star = [(x + r * (0.4 + rng.random()) * math.cos(a), y + r * (0.4 + rng.random()) * math.sin(a)) for a in [2 * math.pi * k / 9 for k in range(9)]]
        hole = [(x + dx * r, y + dy * r) for dx, dy in ((-0.2, -0.2), (-0.2, 0.2), (0.2, 0.2), (0.2, -0.2))]
        apart = [(x + 7, y), (x + 8, y), (x + 8, y + 1), (x + 7, y + 1)]
        rings[p] = [star, hole, apart]
    vertices = [(p, k, i, *v) for p, found in rings.items() for k, ring in enumerate(found) for i, v in enumerate(ring)]
    points = [(i, rng.uniform(-10, 14), rng.uniform(-10, 10)) for i in range(1500)] + [(5000, None, 0.0)] + [(6000 + i, i * 0.5 - 5, 1.0) for i in range(40)]

    def holds(p, x, y):
        sides = [(a, b) for ring in rings[p] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)]
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for (x1, y1), (x2, y2) in sides) % 2 == 1

    want = sorted((i, p) for i, x, y in points if x is not None for p in rings if holds(p, x, y))
    table, corners = spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(vertices, "polygon int, ring int, seq int, x double, y double")
    for size in (0.3, 5.0):
        assert sorted(map(tuple, places.in_polygons(table, corners, size).collect())) == want
    cells = places.cover(places.edges_of(corners), 0.3)
    assert cells.where("inside").count() > 0 and cells.count() == cells.select("polygon", "i", "j").distinct().count()


def test_points_and_polygons_that_are_equal_are_tried_once_and_keep_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(places, "TOGETHER", 4)
    square = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
    vertices = [(p, 0, i, x + p % 2, y) for p in range(30) for i, (x, y) in enumerate(square)]
    points = [(i, 0.5 if i % 3 else 1.5, 0.25) for i in range(50)] + [(99, math.nan, 0.25), (98, 0.5, math.nan)]
    want = sorted((i, p) for i, x, _ in points[:50] for p in range(30) if -1 + p % 2 <= x < 1 + p % 2)
    table, corners = spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(vertices, "polygon int, ring int, seq int, x double, y double")
    assert sorted(map(tuple, places.in_polygons(table, corners, 0.5).collect())) == want
    shared = places._together(table.where("id < 50"), ["x", "y"], "id").collect()
    assert sorted(i for r in shared for i in r["members"]) == list(range(50)) and len(shared) < 30


def test_nearest_centres_are_carried_between_ranges(spark, monkeypatch):
    monkeypatch.setattr(ordered.ranges, "__defaults__", (40,))
    rng = random.Random(3)
    centres = sorted({round(rng.gauss(0, 10), 1) for _ in range(12)} | {1e6})
    values = [rng.uniform(-60, 60) for _ in range(600)] + [*centres, 2e6, float("nan"), None] + [(centres[3] + centres[4]) / 2]
    points = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    axis = spark.createDataFrame([(c,) for c in [*centres, None]], "c double")
    got = {r["i"]: r["c"] for r in places.nearest_centre(points, "v", axis, "c").collect()}
    for i, v in enumerate(values):
        assert got[i] == (None if v is None or v != v else min(centres, key=lambda c: (abs(v - c), c)))
    assert all(r["c"] is None for r in places.nearest_centre(points, "v", axis.limit(0), "c").collect())
