"""Distance joins against brute force, with and without hot cells."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from geoledger.operators import footprint as P
from geoledger.operators import near as J

R = 6_371_000.0


def metres(lat1, lon1, lat2, lon2):
    a = math.sin(math.radians(lat2 - lat1) / 2) ** 2 + math.cos(math.radians(lat1)) * math.cos(
        math.radians(lat2)) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(a))


@pytest.fixture(scope="module")
def scene(spark):
    """A third of both sides lies at one spot; some coordinates are missing; some copies are exact."""
    rnd = random.Random(7)
    businesses = [(i, f"shop {i}", "c%d" % (i % 4), "d%d" % (i % 3), -122.42 + rnd.random() * 0.004, 37.77 + rnd.random() * 0.004)
                  for i in range(200)]
    businesses += [(i, "tower", "c1", "d1", -122.4195, 37.7725) for i in range(200, 300)]
    businesses += [(300, "nowhere", "c1", "d1", None, None), (301, "half", "c1", "d1", -122.42, None)]
    buildings = [(i, "t%d" % (i % 3), "k%d" % (i % 2), -122.42 + rnd.random() * 0.004, 37.77 + rnd.random() * 0.004)
                 for i in range(60)]
    buildings += [(i, "t0", "k0", -122.4195 + (i - 60) * 1e-6, 37.7725) for i in range(60, 90)]
    left = spark.createDataFrame(
        businesses, "unique_id long, dba_name string, naics_code string, naics_description string, longitude double, latitude double")
    right = spark.createDataFrame(
        buildings, "osm_id long, building_type string, building_category string, center_lon double, center_lat double")
    return businesses, buildings, left, right


@pytest.mark.parametrize("hot_rows", [J.HOT_ROWS, 7])
def test_radius_join_degrees(scene, hot_rows):
    businesses, buildings, left, right = scene
    r = 0.0005
    want = sorted(
        (b[0], c[0]) for b in businesses if b[4] is not None and b[5] is not None
        for c in buildings if (b[4] - c[3]) ** 2 + (b[5] - c[4]) ** 2 <= r * r)
    out = J.radius_join(left, right, r, hot_rows=hot_rows)
    assert sorted((x.unique_id, x.osm_id) for x in out.collect()) == want
    assert out.agg(F.max("distance_degrees")).first()[0] <= r
    other = J.radius_join(left, right, r, hot_rows=hot_rows, repeat="businesses")
    assert sorted((x.unique_id, x.osm_id) for x in other.collect()) == want


def test_radius_join_keeps_points_exactly_on_the_radius(spark):
    left = spark.createDataFrame([(1, 0.0003, 0.0004), (2, -0.0005, 0.0), (3, 0.0, 0.00051)], "unique_id long, longitude double, latitude double")
    right = spark.createDataFrame([(9, 0.0, 0.0)], "osm_id long, center_lon double, center_lat double")
    assert sorted(r.unique_id for r in J.radius_join(left, right, 0.0005).collect()) == [1, 2]


@pytest.mark.parametrize("hot_rows", [J.HOT_ROWS, 7])
def test_radius_join_metres(scene, hot_rows):
    businesses, buildings, left, right = scene
    want = sorted(
        (b[0], c[0]) for b in businesses if b[4] is not None and b[5] is not None
        for c in buildings if metres(b[5], b[4], c[4], c[3]) <= 50)
    out = J.radius_join(left, right, 50.0, "meters", hot_rows=hot_rows)
    assert sorted((x.unique_id, x.osm_id) for x in out.collect()) == want


@pytest.mark.parametrize("lat", [0.0, 37.77, 64.1, -54.8])
def test_metre_cells_hold_at_every_latitude(spark, lat):
    rnd = random.Random(3)
    spread = 0.01 / math.cos(math.radians(lat))
    a = [(i, 10 + rnd.random() * spread, lat + rnd.random() * 0.01) for i in range(150)]
    b = [(i, 10 + rnd.random() * spread, lat + rnd.random() * 0.01) for i in range(150)]
    left = spark.createDataFrame(a, "unique_id long, longitude double, latitude double")
    right = spark.createDataFrame(b, "osm_id long, center_lon double, center_lat double")
    want = sorted((p[0], q[0]) for p in a for q in b if metres(p[2], p[1], q[2], q[1]) <= 100)
    out = J.radius_join(left, right, 100.0, "meters")
    assert sorted((x.unique_id, x.osm_id) for x in out.collect()) == want
    other = J.radius_join(left, right, 100.0, "meters", repeat="businesses")
    assert sorted((x.unique_id, x.osm_id) for x in other.collect()) == want
    assert want


@pytest.mark.parametrize("hot_rows", [J.HOT_ROWS, 7])
@pytest.mark.parametrize("k", [1, 3])
def test_nearest(scene, k, hot_rows):
    businesses, buildings, left, right = scene
    want = {}
    for b in businesses:
        if b[4] is None or b[5] is None:
            continue
        near = sorted((metres(b[5], b[4], c[4], c[3]), c[0]) for c in buildings)
        near = [(d, i) for d, i in near if d <= 100][:k]
        if near:
            want[b[0]] = [i for _, i in near]
    out = J.nearest_join(left, right, 100.0, k=k, hot_rows=hot_rows).collect()
    if k == 1:
        assert {r.business_unique_id: [r.building_osm_id] for r in out} == want
    else:
        assert {r.business_unique_id: list(r.building_osm_ids) for r in out} == want
        assert all(r.match_count == len(r.distances_meters) == len(r.building_types) for r in out)


def test_empty_sides(scene):
    _, _, left, right = scene
    assert J.radius_join(left.where("1 = 0"), right).count() == 0
    assert J.radius_join(left, right.where("1 = 0")).count() == 0
    assert J.nearest_join(left, right.where("1 = 0")).count() == 0


@pytest.mark.parametrize("hot_rows", [J.HOT_ROWS, 5])
def test_points_in_polygons_of_all_sizes(spark, hot_rows):
    rnd = random.Random(11)
    shapes = []
    for i, size in enumerate([0.0002] * 15 + [0.003] * 5 + [0.2, 30.0]):
        x, y = rnd.uniform(-122.42, -122.41), rnd.uniform(37.77, 37.78)
        shapes.append((i, [(x, y), (x + size, y), (x + size * 0.4, y + size * 0.4), (x, y + size)]))
    points = [(i, rnd.uniform(-122.42, -122.405), rnd.uniform(37.77, 37.785)) for i in range(300)]

    def inside(ring, x, y):
        hits, closed = 0, [*ring, ring[0]]
        for (ax, ay), (bx, by) in zip(closed, closed[1:]):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                hits += 1
        return hits % 2 == 1

    wkts = [(i, "POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in [*r, r[0]]) + "))") for i, r in shapes]
    wkts += [(98, None), (99, "POLYGON EMPTY")]
    left = spark.createDataFrame([*points, (999, None, None)], "unique_id long, longitude double, latitude double")
    right = spark.createDataFrame(wkts, "osm_id long, geom_wkt string")
    want = sorted((p[0], i) for p in points for i, r in shapes if inside(r, p[1], p[2]))
    out = P.point_in_polygon_join(left, right, hot_rows=hot_rows)
    assert sorted((r.unique_id, r.osm_id) for r in out.collect()) == want
    assert {i for _, i in want} >= {20, 21}


def test_weighted_positions_give_the_same_profile(scene, spark):
    from geoledger.operators.aggregates import agg_by_building_full
    from geoledger.plans.profile import pair_table, weighted_pair_table

    _, _, left, right = scene
    plain = agg_by_building_full(pair_table(left, right))
    folded = agg_by_building_full(weighted_pair_table(left, right), weight="weight")
    exact = ["building_id", "business_count", "unique_business_types", "business_diversity", "primary_business_type",
             "min_distance", "max_distance", "density_category", "intensity_score", "mixed_use"]

    def key(df):
        return sorted(tuple(r) for r in df.select(*exact).collect())

    assert key(plain) == key(folded)
    averages = [dict(df.select("building_id", "avg_distance").collect()) for df in (plain, folded)]
    assert all(averages[0][k] == pytest.approx(averages[1][k]) for k in averages[0])


def test_simplify_keeps_the_shape(spark):
    dense = "POLYGON ((0 0, 5 0.0000001, 10 0, 10 5, 10 10, 0 10, 0 0))"
    rows = [(1, dense), (2, "POLYGON ((0 0, 1 0, 0 1, 0 0))"), (3, None), (4, "LINESTRING (0 0, 1 1)"),
            (5, "POLYGON ((0 0, 0.000001 0, 0.000001 0.000001, 0 0.000001, 0 0))")]
    out = {r.osm_id: r for r in P.simplify_footprints(spark.createDataFrame(rows, "osm_id long, geom_wkt string")).collect()}
    assert out[1].geom_wkt == "POLYGON ((0.0 0.0, 10.0 0.0, 10.0 10.0, 0.0 10.0, 0.0 0.0))"
    assert (out[1].vertices_before, out[1].vertices_after) == (7, 5)
    assert out[2].vertices_after == 4
    assert out[3].geom_wkt is None and out[4].geom_wkt == rows[3][1]
    assert out[5].vertices_after == 5  # would collapse, so it stays


def test_nearest_adapts_to_density(spark):
    """A crowd of buildings in a thin town: the same matches as all pairs, for far fewer tests."""
    rnd = random.Random(12)
    crowd = [(-122.41 + rnd.gauss(0, 0.0001), 37.77 + rnd.gauss(0, 0.0001)) for _ in range(1500)]
    town = [(rnd.uniform(-122.42, -122.40), rnd.uniform(37.76, 37.78)) for _ in range(300)]
    buildings = [(i, x, y, "b") for i, (x, y) in enumerate(crowd + town)]
    places = [(i, x + rnd.gauss(0, 0.00005), y + rnd.gauss(0, 0.00005), f"n{i}") for i, (x, y) in enumerate(rnd.sample(crowd, 150) + rnd.sample(town, 150))]
    places += [(5, *places[5][1:3], "again"), (900, None, 37.77, "nowhere")]
    left = spark.createDataFrame(places, "unique_id long, longitude double, latitude double, dba_name string")
    right = spark.createDataFrame(buildings, "osm_id long, center_lon double, center_lat double, building_type string")
    for k in (1, 3):
        want = []
        for i, x, y, name in places:
            near = [] if x is None else sorted((metres(y, x, b[2], b[1]), b[0]) for b in buildings)
            ids = [b for d, b in near if d <= 100][:k]
            if ids:
                want.append((i, name, ids))
        out = J.nearest_join(left, right, 100.0, k=k).collect()
        assert sorted((r.business_unique_id, r.business_name, [r.building_osm_id] if k == 1 else list(r.building_osm_ids)) for r in out) == sorted(want)
    spots = right.select("osm_id", F.col("center_lon").alias("building_lon"), F.col("center_lat").alias("building_lat"))
    at = left.where("longitude is not null").select(F.col("longitude").alias("business_lon"), F.col("latitude").alias("business_lat"))
    starts = [r["_start"] for r in J._with_start(at, spots, 100.0, 1).collect()]
    assert min(starts) == 0 and max(starts) >= 2

    def tests(places, radius):
        a, b = J._own_cell(places, "business_lon", "business_lat", radius, "meters"), J._nine_cells(spots, "building_lon", "building_lat", radius, "meters")
        return a.join(b, ["_cy", "_cx"]).count()

    started = J._with_start(at, spots, 100.0, 1)
    adapted = sum(tests(started.where(F.col("_start") == s), 100.0 / 4**s) for s in set(starts) - {0})
    assert 2 * adapted < tests(started.where("_start > 0"), 100.0 / 4)  # one width for all, as a first step


def _crowded(scene, spark):
    """The scene with every building there three times under other ids, and one row doubled."""
    _, _, left, right = scene
    many = right.crossJoin(spark.range(3).withColumnRenamed("id", "_i")).withColumn("osm_id", F.col("osm_id") + F.col("_i") * 100_000).drop("_i")
    return left, many.unionByName(right.orderBy("osm_id").limit(1))


def test_buildings_that_share_a_centre_make_no_more_pairs(scene, spark):
    from geoledger.operators import aggregates as A
    from geoledger.plans.profile import pair_table, spot_pairs

    _, _, left, right = scene
    left, many = _crowded(scene, spark)
    spots, plain = spot_pairs(left, many), pair_table(left, many)
    assert spots.count() == spot_pairs(left, right).count() < plain.count()
    assert spots.agg(F.sum(F.col("weight") * F.col("buildings"))).first()[0] == plain.count()

    def rows(df):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())

    assert rows(A.agg_by_building_full(spots, "weight", many)) == rows(A.agg_by_building_full(plain))
    assert rows(A.agg_by_building_slim(spots, "weight", many)) == rows(A.agg_by_building_slim(plain))
    for size in (0.001, 0.002):
        assert rows(A.agg_by_grid(spots, size, weight="weight", buildings=many)) == rows(A.agg_by_grid(plain, size))


def test_pairs_take_attributes_and_lose_repeats_without_a_shuffle_of_pairs(scene, spark):
    from geoledger.operators.upsert import distinct_pairs
    from geoledger.plans.profile import pair_table

    _, _, left, right = scene
    # repeated rows, and ids of either side that lie at two near places
    left = left.unionByName(left.limit(20)).unionByName(left.where("unique_id < 15").withColumn("latitude", F.col("latitude") + 1e-5))
    right = right.unionByName(right.limit(9)).unionByName(right.where("osm_id < 15").withColumn("center_lat", F.col("center_lat") + 1e-5))
    plain = pair_table(left, right).select("business_id", "building_id")

    def rows(df):
        return sorted(tuple(r) for r in df.select(sorted(df.columns)).collect())

    assert rows(J.distinct_radius_pairs(left, right)) == rows(distinct_pairs(plain))
    assert rows(J.attributed_pairs(left, right, "dba_name")) == rows(J.attach_attributes(plain, left, "dba_name"))
    plan = J.attributed_pairs(left, right, "dba_name")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3  # both sides with the hot cells, and with each other; none on the pairs


def test_looked_up_attributes_are_not_copied_to_all_tasks(scene, monkeypatch):
    _, _, left, right = scene
    plans, write = {}, J.written

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, label)

    monkeypatch.setattr(J, "written", seen)
    J.attributed_pairs(left, right, "dba_name")
    assert "SortMergeJoin" in plans["places"] and "Broadcast" not in plans["places"]


@pytest.mark.parametrize("hot_rows", [J.HOT_ROWS, 7])
@pytest.mark.parametrize("metric, radius", [("degrees", 0.0005), ("meters", 50.0)])
def test_pairs_by_position_are_those_of_rows(scene, metric, radius, hot_rows):
    """Also with exact copies of rows, and where a position's rows are cut into several."""
    _, _, left, right = scene
    left, right = left.unionByName(left.where("unique_id % 3 = 0")), right.unionByName(right.where("osm_id % 4 = 0"))

    def rows(df):
        return sorted(map(repr, df.collect()))

    plain = J.radius_join(left, right, radius, metric)
    assert rows(J.position_pairs(left, right, radius, metric, hot_rows=hot_rows, fold=9)) == rows(plain)
    assert rows(J.position_pairs(left, right, radius, metric, digits=3)) == rows(plain.withColumn(plain.columns[-1], F.round(plain.columns[-1], 3)))
    assert J.position_pairs(left.where("1 = 0"), right).count() == J.position_pairs(left, right.where("1 = 0")).count() == 0


def test_positions_are_held_in_bounded_arrays(spark):
    copies = spark.range(0, 3_000, 1, 3).selectExpr("7L as unique_id", "1.0D as longitude", "2.0D as latitude")
    folded = J._by_position(copies, "longitude", "latitude", "_rows", 100).selectExpr("size(_rows) as n").collect()
    assert sum(r["n"] for r in folded) == 3_000 and len(folded) == 30 and max(r["n"] for r in folded) < 200


def test_pairs_of_a_join_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    """Sides of a few KB whose pairs are many do not end in one task."""
    monkeypatch.setattr(J, "TASK_PAIRS", 500, raising=False)
    at = "(id % 40) * 0.002D as {}", "(id % 17) * 0.002D as {}"
    left = spark.range(0, 4_000, 1, 1).selectExpr("id as unique_id", at[0].format("longitude"), at[1].format("latitude"))
    right = spark.range(800).selectExpr("id as osm_id", at[0].format("center_lon"), at[1].format("center_lat"))
    out = J.radius_join(left, right, 0.0005)
    per_task = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("osm_id").alias("n")).collect()]
    assert sum(per_task) == sum(1 for a in range(4_000) for b in range(800) if a % 40 == b % 40 and a % 17 == b % 17)
    assert out.rdd.getNumPartitions() > 1 and len(per_task) > 1
