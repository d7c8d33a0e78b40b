"""Density clustering and co-location against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoledger.operators.analytics import co_location
from geoledger.operators.cell_pairs import cell_pairs, with_finest_cell
from geoledger.operators.density import dbscan_districts


def brute(points, reach, least):
    near = {a: [b for b in points if (points[a][0] - points[b][0]) ** 2 + (points[a][1] - points[b][1]) ** 2 <= reach * reach]
            for a in points}
    core = {a for a in points if len(near[a]) >= least}
    label = {}
    for a in sorted(core):
        if a in label:
            continue
        stack, seen = [a], {a}
        while stack:
            for b in near[stack.pop()]:
                if b in core and b not in seen:
                    seen.add(b), stack.append(b)
        for b in seen:
            label[b] = a
    out = {}
    for a in points:
        mine = [label[b] for b in near[a] if b in core]
        out[a] = (label[a] if a in core else min(mine, default=None), a in core)
    return out


@pytest.mark.parametrize("seed,least", [(1, 4), (2, 6), (3, 1)])
def test_dbscan(spark, seed, least):
    rnd = random.Random(seed)
    units = {}
    for c in range(6):  # blobs, a line, one spot with many copies, noise
        cx, cy = rnd.randrange(60_000), rnd.randrange(60_000)
        for _ in range(25):
            units[len(units)] = (cx + int(rnd.gauss(0, 1500)), cy + int(rnd.gauss(0, 1500)))
    for i in range(40):
        units[len(units)] = (i * 900, 70_000)
    for _ in range(60):
        units[len(units)] = (90_000, 5_000)
    for _ in range(40):
        units[len(units)] = (rnd.randrange(100_000), rnd.randrange(100_000))
    rows = [(k, -122.4 + x / 1e7, 37.7 + y / 1e7) for k, (x, y) in units.items()]
    fixed = {k: (round(lon * 1e7), round(lat * 1e7)) for k, lon, lat in rows}
    df = spark.createDataFrame([*rows, (-1, None, None)], "unique_id long, longitude double, latitude double")
    got = {r.unique_id: (r.cluster_id, r.is_core) for r in dbscan_districts(df, eps=0.0001, min_points=least).collect()}
    assert got == brute(fixed, 1000, least)


def test_co_location(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("abc"), rnd.random() * 0.002, rnd.random() * 0.002) for _ in range(120)] + [("a", 0.001, 0.001)] * 30
    df = spark.createDataFrame(rows, "naics_code string, longitude double, latitude double")
    want = {}
    for i, p in enumerate(rows):
        for q in rows[:i]:
            if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 0.0003 ** 2:
                key = tuple(sorted((p[0], q[0])))
                want[key] = want.get(key, 0) + 1
    for test_work in (100_000, 256, 4, 1):
        got = {(r.kind_1, r.kind_2): r.pair_count for r in co_location(df, 0.0003, test_work=test_work).collect()}
        assert got == want


def test_a_crowded_place_is_counted_by_cells(spark):
    rng = np.random.default_rng(8)
    r, n = 0.0003, 6_000
    x, y = np.concatenate([rng.normal(0.5, r / 3, n), rng.uniform(0.5, 0.51, 500)]), np.concatenate([rng.normal(0.5, r / 3, n), rng.uniform(0.5, 0.51, 500)])
    rows = [("ab"[i % 2], float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "naics_code string, longitude double, latitude double")
    got = {(g.kind_1, g.kind_2): g.pair_count for g in co_location(df, r).collect()}
    want = {("a", "a"): 0, ("a", "b"): 0, ("b", "b"): 0}
    for i in range(len(x)):
        near = (x[i] - x[:i]) ** 2 + (y[i] - y[:i]) ** 2 <= r * r
        for kind in "ab":
            want[tuple(sorted((rows[i][0], kind)))] += int(near["ab".index(kind) :: 2].sum())
    assert got == want
    spots = df.select("longitude", "latitude")
    tests = cell_pairs(with_finest_cell(spots, r))[1].agg(F.sum(F.col("na") * F.col("nb"))).first()[0]
    plain = cell_pairs(with_finest_cell(spots, r), test_work=10**12)[1].agg(F.sum(F.col("na") * F.col("nb"))).first()[0]
    assert tests < plain / 10
    assert co_location(df.limit(0), r).collect() == []
