"""Shared walls stay shared; counts against thinning every arc by hand."""

from __future__ import annotations

import math

import numpy as np

from geoledger.operators.shared_outlines import simplify_shared


def text(*rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x} {y}" for x, y in r) + ")" for r in rings) + ")"


def corners(wkt):
    return [[tuple(map(float, p.split())) for p in r.strip("() ").split(", ")] for r in wkt[len("POLYGON ("):-1].split("), (")]


def edges(ring):
    return {frozenset(e) for e in zip(ring, ring[1:])}


def terrace():
    """Two houses with a wavy wall, drawn from different corners, a yard inside one of them that a shed fills, and a lone round pond."""
    wall = [(10.0 + 0.4 * math.sin(y), y / 2) for y in range(21)]
    left = [(0.0, 0.0), *wall, (0.0, 10.0)]
    right = [(20.0, 10.0), *wall[::-1], (20.0, 0.0)]
    yard = [(13.0 + 2 * math.cos(a / 5), 5.0 + 2 * math.sin(a / 5)) for a in range(31)]
    shed = yard[::-1][7:] + yard[::-1][:7]
    pond = [(50 + 3 * math.cos(a / 10), 3 * math.sin(a / 10)) for a in range(62)]
    close = lambda r: [*r, r[0]]
    return close(left), close(right), close(yard), close(shed), close(pond)


def test_shared_walls(spark):
    left, right, yard, shed, pond = terrace()
    rows = [(1, text(left)), (2, text(right, yard)), (3, text(shed)), (4, text(pond)), (5, None), (6, "POINT (1 2)"), (7, "POLYGON EMPTY"), (1, text(left))]
    schema = "osm_id long, geom_wkt string"
    for tolerance in (0.0, 0.1, 0.3, 1.0):
        got = simplify_shared(spark.createDataFrame(rows, schema), tolerance=tolerance).collect()
        assert len(got) == len(rows) and {r["geom_wkt"] for r in got if r["osm_id"] > 4} == {None, "POINT (1 2)", "POLYGON EMPTY"}
        by = {r["osm_id"]: corners(r["geom_wkt"]) for r in got if r["osm_id"] <= 4}
        (a,), (b, hole), (c,), (d,) = by[1], by[2], by[3], by[4]
        for ring, before in ((a, left), (b, right), (hole, yard), (c, shed), (d, pond)):
            assert ring[0] == ring[-1] and set(ring) <= set(before) and len(ring) >= 4
        near_wall = lambda ring: {e for e in edges(ring) if all(9 < x < 11 for x, _ in e)}
        assert near_wall(a) == near_wall(b) and edges(hole) == edges(c)
        if tolerance >= 0.3:
            assert len(a) < len(left) / 2 and len(c) < len(shed) and len(d) < len(pond) / 2


def test_a_small_ring_keeps_its_wall_for_all(spark):
    """A sliver that thinning would flatten stays whole, and so does the wall in the house beside it."""
    sliver = [(0.0, 0.0), (5.0, 0.01), (10.0, 0.0), (5.0, 0.02), (0.0, 0.0)]
    house = [(0.0, 0.0), (5.0, 0.01), (10.0, 0.0), (10.0, -9.0), (0.0, -9.0), (0.0, 0.0)]
    got = {r["osm_id"]: r for r in simplify_shared(spark.createDataFrame([(1, text(sliver)), (2, text(house))], "osm_id long, geom_wkt string"), tolerance=0.5).collect()}
    assert corners(got[1]["geom_wkt"]) == [sliver] and corners(got[2]["geom_wkt"]) == [house]
    alone = simplify_shared(spark.createDataFrame([(2, text(house))], "osm_id long, geom_wkt string"), tolerance=0.5).collect()
    assert alone[0]["vertices_after"] == 5


def test_empty(spark):
    assert simplify_shared(spark.createDataFrame([], "osm_id long, geom_wkt string")).collect() == []


def test_short_spans_are_decided_as_by_arrays(monkeypatch):
    from geoledger.operators import footprint

    rng = np.random.default_rng(3)
    for k in range(2000):
        n = int(rng.integers(3, 24))
        xy = rng.integers(0, 6, size=(n, 2)).astype(float) if k % 2 else rng.integers(0, 40, size=(n, 2)) * 1e-6 + [-122.4, 37.7]
        kept = []
        for short in (footprint.SHORT_SPAN, 0):
            monkeypatch.setattr(footprint, "SHORT_SPAN", short)
            keep = np.zeros(n, bool)
            footprint.thin_spans(xy, keep, [(0, n - 1)], 1.0 if k % 2 else 1e-5)
            kept.append(keep.tolist())
            monkeypatch.undo()
        assert kept[0] == kept[1]
