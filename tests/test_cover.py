"""Polygon covers: exact containment from rim cells, whatever the outline's length."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoledger.operators import cover as C
from geoledger.operators import footprint as P


def even_odd(rings, x, y):
    """Whole-ring test, the way the reference text defines it."""
    odd = np.zeros(len(x), int)
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            spans = (ay > y) != (by > y)
            if by != ay:
                odd += spans & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd % 2 == 1


def even_odd_many(rings, x, y):
    """The same, edges vectorised, for outlines of many vertices."""
    odd = np.zeros(len(x), int)
    a = np.concatenate([np.array(r[:-1]) for r in rings])
    b = np.concatenate([np.array(r[1:]) for r in rings])
    for i in range(len(x)):
        spans = (a[:, 1] > y[i]) != (b[:, 1] > y[i])
        p, q = a[spans], b[spans]
        odd[i] = (x[i] < (q[:, 0] - p[:, 0]) * (y[i] - p[:, 1]) / (q[:, 1] - p[:, 1]) + p[:, 0]).sum()
    return odd % 2 == 1


def star(n, cx, cy, size, seed, back=False):
    rng = np.random.default_rng(seed)
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))[:: -1 if back else 1]
    r = size * (1 + 0.3 * np.sin(7 * angle) + 0.02 * rng.normal(size=n))
    ring = [(float(cx + a), float(cy + b)) for a, b in zip(r * np.cos(angle), r * np.sin(angle))]
    return [*ring, ring[0]]


def wkt(rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in ring) + ")" for ring in rings) + ")"


def joined(spark, shapes, points, **options):
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(points)], "unique_id int, longitude double, latitude double")
    right = spark.createDataFrame([(i, wkt(rings)) for i, rings in enumerate(shapes)], "osm_id int, geom_wkt string")
    return {tuple(r) for r in P.point_in_polygon_join(left, right, **options).select("unique_id", "osm_id").collect()}


def test_outline_of_100000_vertices_with_holes(spark):
    outline = [star(100_000, -122.4, 37.7, 0.05, 1), star(3_000, -122.4, 37.7, 0.01, 2, True), star(500, -122.375, 37.72, 0.004, 3, True)]
    rng = np.random.default_rng(4)
    angle, r = rng.uniform(0, 2 * np.pi, 1500), rng.uniform(0, 0.08, 1500)
    x = np.concatenate([rng.uniform(-122.48, -122.32, 2500), -122.4 + r * np.cos(angle)])
    y = np.concatenate([rng.uniform(37.62, 37.78, 2500), 37.7 + r * np.sin(angle)])
    corners = np.array(outline[0][:: 400] + outline[1][:: 100])  # the vertices themselves, too
    x, y = np.concatenate([x, corners[:, 0]]), np.concatenate([y, corners[:, 1]])
    expected = {(int(i), 0) for i in np.flatnonzero(even_odd_many(outline, x, y))}
    assert joined(spark, [outline], zip(x, y)) == expected and 500 < len(expected) < len(x) - 500
    shape = spark.createDataFrame([(0, wkt(outline))], "osm_id int, geom_wkt string")
    cells = C.polygon_cover(shape)
    assert cells.agg(F.max(F.size("_edges"))).first()[0] <= C.EDGES
    assert cells.where("_inside").count() > 50


@pytest.mark.parametrize("edges", [4, 64])
def test_lattice_shapes_and_points_on_edges(spark, monkeypatch, edges):
    monkeypatch.setattr(C, "EDGES", edges)
    rng = np.random.default_rng(7)
    w = C.BASE_CELL
    shapes = []
    for k in range(12):  # corners, edges and points on cell borders, horizontal and vertical runs, teeth
        x0, y0, n = -122.4 + k * w / 2, 37.7, 5 + 3 * k
        top = [(x0 + i * w / 4, y0 + (2 + i % 2 * (k % 3)) * w / 2) for i in range(n)]
        ring = [(x0, y0), *[(x, y) for x, y in top], (x0 + (n - 1) * w / 4, y0), (x0, y0)]
        shapes.append([ring] if k % 2 else [ring, [(x0 + w / 8, y0 + w / 8), (x0 + w / 4, y0 + w / 8), (x0 + w / 4, y0 + w / 4), (x0 + w / 8, y0 + w / 8)]])
    shapes.append([star(200, -122.4, 37.7, 3 * w, 9)])
    at = [(-122.4 + i * w / 8, 37.7 + j * w / 8) for i in range(-10, 60) for j in range(-2, 20)] + [v for s in shapes for ring in s for v in ring]
    at += [(float(a), float(b)) for a, b in zip(rng.uniform(-122.403, -122.39, 400), rng.uniform(37.697, 37.704, 400))]
    x, y = (np.array(v) for v in zip(*at))
    expected = {(int(i), k) for k, rings in enumerate(shapes) for i in np.flatnonzero(even_odd(rings, x, y))}
    assert joined(spark, shapes, at) == expected


def test_text_that_is_no_polygon_has_no_cells(spark):
    rows = [(1, None), (2, ""), (3, "POINT (1 2)"), (4, "POLYGON ((1 2, 3 4, 1 2))"), (5, "POLYGON ((0 0, 1 e, 1 1, 0 0))"), (6, "POLYGON ((0 0, 1 0, 1 1, 0 1))")]
    shapes = spark.createDataFrame(rows, "osm_id int, geom_wkt string")
    assert {r["osm_id"] for r in C.polygon_cover(shapes).collect()} == {6}
    assert C.polygon_cover(shapes.limit(0)).collect() == []


def test_small_and_large_outlines_over_one_hot_place(spark):
    shapes = [[star(n, -122.4, 37.7, 0.0004, n)] for n in (4, 30, 64, 65, 900)]
    rng = np.random.default_rng(5)
    x, y = rng.normal(-122.4, 0.0003, 400), rng.normal(37.7, 0.0003, 400)
    expected = {(int(i), k) for k, rings in enumerate(shapes) for i in np.flatnonzero(even_odd(rings, x, y))}
    assert joined(spark, shapes, zip(x, y), hot_rows=20) == expected
