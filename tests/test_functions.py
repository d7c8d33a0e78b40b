"""Scalar functions on edge rows."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoledger.functions import geometry as G
from geoledger.functions import measures as M
from geoledger.functions import text as X


def column(spark, values, kind, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(build(F.col("v"))).collect()]


def test_null_tokens_and_strip(spark):
    got = column(spark, ["", "null", "NULL", "PRUSS", "94103", None], "string", X.null_tokens_to_null)
    assert got == [None, None, None, None, "94103", None]
    assert column(spark, [" \t a b\n", "", None], "string", X.strip) == ["a b", "", None]
    assert column(spark, [" ca "], "string", X.strip_upper) == ["CA"]


def test_points(spark):
    texts = ["POINT (-122.4 37.7)", "POINT (x 37.7)", "POINT(-122.4 37.7)", "", None]
    assert column(spark, texts, "string", X.point_lon) == [-122.4, None, None, None, None]
    assert column(spark, texts, "string", X.point_lat) == [37.7, 37.7, None, None, None]


def test_dates(spark):
    got = column(spark, ["02/29/2020", "02/30/2021", "13/45/2020", "2020-01-01", None], "string", X.us_date)
    assert got == [dt.datetime(2020, 2, 29), None, None, None, None]


def test_height_and_levels(spark):
    got = column(spark, ["10.5 m", "35 ft", "12", "tall", "", None], "string", X.height_m)
    assert got == [10.5, pytest.approx(35 * 0.3048), 12.0, None, None, None]
    assert column(spark, ["3", "2.9", "-1.5", "x", "", None], "string", X.level_count) == [3, 2, -1, None, None, None]


def test_building_class(spark):
    tags = ["House", "retail", "cathedral", "yes", "", None]
    assert column(spark, tags, "string", X.building_category) == [
        "residential", "commercial", "other", "unknown", "unknown", "unknown"]
    assert column(spark, tags, "string", X.building_type) == ["House", "retail", "cathedral", "yes", "unknown", "unknown"]


def test_age_takes_first_tag_with_a_year_then_style(spark):
    rows = [("C19", "1931 built", None), ("1906-04-18", "1931", None), (None, None, "Victorian"), ("x1906y", None, "gothic")]
    df = spark.createDataFrame(rows, "a string, b string, s string")
    age = X.construction_age({"start_date": F.col("a"), "construction_date": F.col("b")}, F.col("s"), 2024)
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in age.items()]).collect()]
    assert got == [
        (1931, 93, "construction_date"), (1906, 118, "start_date"), (1890, 134, "architectural_style"), (None, None, None)]


SQUARE = "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
WKTS = [SQUARE, "POLYGON((0 0,4 0,4 2,0 2,0 0))", "POLYGON ((0 0, 1 1, 2 2, 0 0))", "POLYGON EMPTY", "null", "", None,
        "POLYGON ((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))", "POLYGON ((0 0, a b, 2 2, 0 0))"]


def test_centroid(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(WKTS)], "i int, geom_wkt string")
    kept = {r.i: (r.center_lon, r.center_lat) for r in G.with_centroid(df).collect()}
    assert kept == {0: (1.0, 1.0), 1: (2.0, 1.0), 7: (6.0541667, 3.0208333)}
    assert G.with_centroid(df, keep_all=True).count() == len(WKTS)


def test_vertex_mean_and_first_vertex(spark):
    df = spark.createDataFrame([(i, w) for i, w in enumerate(WKTS[:2])], "i int, geom_wkt string")
    assert [(r.mean_lon, r.mean_lat) for r in G.with_vertex_mean(df).orderBy("i").collect()] == [(0.8, 0.8), (1.6, 0.8)]
    assert [(r.first_lon, r.first_lat) for r in G.with_first_vertex(df).collect()] == [(0.0, 0.0)] * 2


def test_centroid_is_parsed_once_per_row(spark):
    df = spark.createDataFrame([(1, SQUARE)], "i int, geom_wkt string")
    plan = G.with_centroid(df).withColumn("d", F.col("center_lon") + F.col("center_lat"))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all(") == 2  # brackets and vertices


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-500, 500), st.integers(-500, 500)), min_size=3, max_size=9, unique=True))
def test_centroid_matches_shoelace(spark, corners):
    ring = [*corners, corners[0]]
    cross = [(x1 * y2 - x2 * y1) for (x1, y1), (x2, y2) in zip(ring, ring[1:])]
    area = sum(cross)
    wkt = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in ring) + "))"
    rows = G.with_centroid(spark.createDataFrame([(wkt,)], "geom_wkt string")).collect()
    if area == 0:
        assert rows == []
        return
    cx = sum((a[0] + b[0]) * c for a, b, c in zip(ring, ring[1:], cross)) / (3 * area)
    assert rows[0].center_lon == pytest.approx(cx, abs=1e-6, rel=1e-9)


def test_polygon_text(spark):
    rows = [([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)],), ([(0.0, 0.0), (1.0, 0.0), (0.0, 0.0)],), (None,)]
    df = spark.createDataFrame(rows, "p array<struct<lon:double,lat:double>>")
    got = [r[0] for r in df.select(G.polygon_wkt(F.col("p"))).collect()]
    assert got == ["POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 1.0, 0.0 0.0))", None, None]


def test_distances(spark):
    df = spark.createDataFrame([(37.7749, -122.4194, 37.7849, -122.4094), (None, 1.0, 1.0, 1.0)],
                               "a double, b double, c double, d double")
    near, missing = [r[0] for r in df.select(M.haversine_m(*[F.col(c) for c in "abcd"])).collect()]
    assert near == pytest.approx(1417.3, abs=1.0)
    assert missing is None


def test_cells_round_half_to_even(spark):
    assert column(spark, [0.5, 1.5, 2.5, -0.5, -1.2], "double", lambda c: M.round_cell(c, 1.0)) == [0, 2, 2, 0, -1]
    assert column(spark, [0.5, -0.5, -1.2], "double", lambda c: M.floor_cell(c, 1.0)) == [0, -1, -2]


def test_hexagon_cell(spark):
    size, (lon, lat) = 0.1, (-122.41, 37.77)
    df = spark.createDataFrame([(lon, lat)], "lon double, lat double")
    q, r = df.select(M.hex_q(F.col("lon"), F.col("lat"), F.lit(size)), M.hex_r(F.col("lat"), F.lit(size))).first()
    assert q == round(math.sqrt(3) / 3 * lon / size - lat / size / 3)
    assert r == round(2 / 3 * lat / size)


def test_bands_and_scores(spark):
    assert column(spark, [0, 1, 2, 5, 10, 99], "int", lambda c: M.band(c, M.BUILDING_BANDS)) == [
        "none", "low", "medium", "high", "very_high", "very_high"]
    assert column(spark, [-3, 4, 40], "int", lambda c: M.intensity(c, 10)) == [0, 40, 100]
    assert column(spark, [2, 3], "int", M.mixed_use) == [False, True]
    assert column(spark, [None, "7207"], "string", M.code_class)[0] is None
    assert column(spark, [3, 7, 30], "int", M.point_size) == [4, 3, 2]


def test_true_hexagons_are_the_nearest_and_have_six_neighbours(spark):
    import random

    from geoledger.operators.pyramid import true_hexagons

    rnd, size = random.Random(6), M.hex_size(8)
    at = [(i, -122.42 + rnd.random() * 0.02, 37.76 + rnd.random() * 0.02) for i in range(400)] + [(900, None, 37.0)]
    df = spark.createDataFrame(at, "unique_id long, longitude double, latitude double")

    def centre(q, r):
        return size * math.sqrt(3) * (q + r / 2), size * 1.5 * r

    hexed = df.where("longitude is not null").withColumn("h", M.true_hex(F.col("longitude"), F.col("latitude"), size))
    rows = hexed.select("longitude", "latitude", "h.q", "h.r", M.hex_ring(F.col("h.q"), F.col("h.r")).alias("near"), M.hex_ring(F.col("h.q"), F.col("h.r"), 2).alias("far")).collect()
    counts: dict = {}
    for row in rows:
        own = math.dist(centre(row["q"], row["r"]), (row["longitude"], row["latitude"]))
        others = [math.dist(centre(row["q"] + a, row["r"] + b), (row["longitude"], row["latitude"])) for a in range(-3, 4) for b in range(-3, 4) if a or b]
        assert own <= min(others)
        step = size * math.sqrt(3)
        for ring, n, reach in ((row["near"], 6, 1), (row["far"], 12, 2)):
            cells = {(c["q"], c["r"]) for c in ring}
            assert len(cells) == n
            assert all((reach - 0.3) * step < math.dist(centre(*c), centre(row["q"], row["r"])) < (reach + 0.01) * step for c in cells)
        counts[row["q"], row["r"]] = counts.get((row["q"], row["r"]), 0) + 1
    got = {(r["hex_q"], r["hex_r"]): r for r in true_hexagons(df, 8).collect()}
    assert {k: r["business_count"] for k, r in got.items()} == counts
    for (q, r), row in got.items():
        near = [counts[q + a, r + b] for a, b in ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)) if (q + a, r + b) in counts]
        assert (row["neighbours"], row["neighbour_count"]) == (len(near), sum(near))
        parent = centre(row["parent_q"], row["parent_r"])
        assert math.dist((2 * parent[0], 2 * parent[1]), centre(q, r)) <= 2 * size + 1e-9
