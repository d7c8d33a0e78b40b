"""Inputs that once lost, multiplied, misplaced or hid rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from geoledger.functions import geometry as G
from geoledger.operators import changes as C
from geoledger.operators import footprint as P
from geoledger.operators import near as J
from geoledger.operators import pyramid as Z
from geoledger.operators import upsert as U
from geoledger.operators.analytics import co_location
from geoledger.plans import full_build as B
from geoledger.session import has_folder, scratch, shared_dir, written
from geoledger.sources import registrations as R
from geoledger.sources import sinks as S
from geoledger.sources.derived import Tables
from geoledger.streaming import ingest as I

from .conftest import SF
from .test_sources import GOOD, write_csv

SQUARE = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))"
HOLED = "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 2 0, 2 4, 0 4, 0 0))"
TWO = "MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0)), ((10 0, 10 2, 12 2, 12 0, 10 0)))"


@pytest.fixture()
def shapes(spark):
    return spark.createDataFrame([(1, SQUARE), (2, HOLED), (3, TWO), (4, "POINT (1 1)"), (5, None), (6, "POLYGON EMPTY"), (7, "POLYGON ((0 0, 1 x, 1 1, 0 0))")], "osm_id long, geom_wkt string")


def test_centroids_of_holes_and_parts(shapes):
    assert {r.osm_id: (r.center_lon, r.center_lat) for r in G.with_centroid(shapes).collect()} == {1: (2.0, 2.0), 2: (3.0, 2.0), 3: (6.0, 1.0)}
    assert {r.osm_id: (r.mean_lon, r.mean_lat) for r in G.with_vertex_mean(shapes).collect()} == {1: (1.6, 1.6), 2: (1.2, 1.6), 3: (5.8, 0.8)}


def test_points_in_holes_and_parts(spark, shapes):
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 3.0, 1.0), (3, 11.0, 1.0), (4, 5.0, 1.0)], "unique_id long, longitude double, latitude double")
    got = {(r.unique_id, r.osm_id) for r in P.point_in_polygon_join(points, shapes).collect()}
    assert got == {(1, 1), (1, 3), (2, 1), (2, 2), (3, 3)}


def test_simplification_keeps_rows_rings_and_parts(spark):
    dense = "MULTIPOLYGON (((0 0, 1 0, 2 0, 2 2, 0 2, 0 0), (0.5 0.5, 1 0.5, 1 1, 0.5 0.5)), ((5 5, 6 5, 7 5, 7 7, 5 7, 5 5)))"
    df = spark.createDataFrame([(1, dense, "a"), (1, dense, "b"), (2, "LINE", "c"), (3, None, "d")], "osm_id long, geom_wkt string, name string")
    got = {r.name: r for r in P.simplify_footprints(df, tolerance=1e-5).collect()}
    assert len(got) == 4 and got["a"].geom_wkt == got["b"].geom_wkt
    assert got["a"].geom_wkt == "MULTIPOLYGON (((0.0 0.0, 2.0 0.0, 2.0 2.0, 0.0 2.0, 0.0 0.0), (0.5 0.5, 1.0 0.5, 1.0 1.0, 0.5 0.5)), ((5.0 5.0, 7.0 5.0, 7.0 7.0, 5.0 7.0, 5.0 5.0)))"
    assert (got["a"].vertices_before, got["a"].vertices_after) == (16, 14)
    assert got["c"].geom_wkt == "LINE" and got["c"].vertices_before is None and got["d"].geom_wkt is None


def _places(spark, rows):
    return spark.createDataFrame(rows, "unique_id long, longitude double, latitude double, dba_name string")


def _targets(spark, rows):
    return spark.createDataFrame([(i, "t", x, y) for i, x, y in rows], "osm_id long, building_type string, center_lon double, center_lat double")


@pytest.mark.parametrize("repeat", ["buildings", "businesses"])
def test_metre_joins_around_the_globe(spark, repeat):
    places = _places(spark, [(1, 179.9999, 10.0, "a"), (2, -179.9999, 10.0, "b"), (3, 0.0, 89.99999, "c"), (4, 20.0, -89.9, "d")])
    targets = _targets(spark, [(1, -179.9999, 10.0), (2, 180.0, 89.99999), (3, 20.0001, -89.9)])
    pairs = J.radius_join(places, targets, 30.0, "meters", repeat=repeat).select("unique_id", "osm_id").collect()
    assert sorted(map(tuple, pairs)) == [(1, 1), (2, 1), (3, 2), (4, 3)]


def test_cells_are_cut_by_their_pairs(spark):
    points = spark.range(900).select(F.col("id").alias("p"), F.lit(1).alias("cell"))
    targets = spark.range(900).select(F.col("id").alias("t"), F.lit(1).alias("cell"))
    shares = J._hot_cells(points, targets, ["cell"], 100).first()
    assert shares._ts == 9 and shares._ps == 9
    joined = J.cell_join(points, targets, ["cell"], F.col("p") == F.col("t"), 100)
    assert joined.count() == 900 and joined.distinct().count() == 900
    lean = J._hot_cells(points, targets.limit(1), ["cell"], 10).first()
    assert (lean._ps, lean._ts) == (9, 1)


def test_nearest_for_every_row(spark):
    places = _places(spark, [(1, 0.0, 0.0, "a"), (1, 0.001, 0.0, "b"), (1, 0.001, 0.0, "b")])
    targets = _targets(spark, [(1, 0.0, 0.0), (2, 0.001, 0.0)])
    got = sorted((r.business_name, r.building_osm_id) for r in J.nearest_join(places, targets, 50.0).collect())
    assert got == [("a", 1), ("b", 2), ("b", 2)]


def test_fingerprint_sees_a_value_change_its_column(spark):
    a, b = (spark.createDataFrame([row], "x string, y string") for row in (("x", None), (None, "x")))
    assert C.content_fingerprint(a).first() != C.content_fingerprint(b).first()


def test_update_leaves_other_rows_alone(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "z")], "k int, v string")
    assert sorted(map(tuple, U.upsert_update(old, new, ["k"], F.col("v")).collect())) == [(1, "z"), (2, "b"), (2, "c")]


def test_base_outlives_a_new_checkpoint(spark, tmp_path):
    inbox, table, base = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "base")
    write_csv(inbox / "1.csv", [GOOD, {**GOOD, "UniqueID": "2"}])
    I.incremental_ingest(spark, str(inbox), table, str(tmp_path / "m1"))
    I.compact(spark, table, base)
    more = tmp_path / "more"
    write_csv(more / "1.csv", [{**GOOD, "UniqueID": "3"}])
    I.incremental_ingest(spark, str(more), base, str(tmp_path / "m2"))
    assert {r.unique_id for r in I.current_businesses(spark, base).collect()} == {"1", "2", "3"}


def test_a_record_that_moved_away_is_gone(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "table")
    write_csv(inbox / "1.csv", [GOOD, {**GOOD, "Business Location": "POINT (-100 40)", "data_as_of": "2024-05-01"}, {**GOOD, "UniqueID": "2"}])
    I.incremental_ingest(spark, str(inbox), table, str(tmp_path / "marks"))
    assert {r.unique_id for r in I.current_businesses(spark, table).collect()} == {"2"}
    assert {r.unique_id for r in I.current_businesses(spark, table, None).collect()} == {"1", "2"}


def test_a_file_with_other_columns_fails(spark, tmp_path):
    write_csv(tmp_path / "in" / "1.csv", [GOOD])
    swapped = list(R.RAW_COLUMNS)
    i, j = swapped.index("City"), swapped.index("State")
    swapped[i], swapped[j] = swapped[j], swapped[i]
    (tmp_path / "in" / "2.csv").write_text(",".join(swapped) + "\n" + ",".join('"%s"' % GOOD.get(c, "") for c in swapped) + "\n")
    with pytest.raises(Exception, match="(?i)header"):
        R.scan_registrations(spark, str(tmp_path / "in")).collect()


def test_one_position_fills_several_files(spark, tmp_path):
    rows = spark.range(8000).select("id", F.lit(1.0).alias("longitude"), F.lit(2.0).alias("latitude"))
    S.sink_located(rows, str(tmp_path / "one"), files=8)
    assert spark.read.parquet(str(tmp_path / "one")).select(F.input_file_name()).distinct().count() > 4


def test_counts_of_a_crowded_position(spark):
    n = 3_000_000_000
    located = spark.createDataFrame([(0.0, 0.0, "a", n), (0.0, 0.0, "b", 2)], "longitude double, latitude double, naics_code string, weight long")
    import geoledger.operators.analytics as N

    original = N.collapse_positions
    N.collapse_positions = lambda *_: located
    try:
        got = {(r.kind_1, r.kind_2): int(r.pair_count) for r in co_location(located.drop("weight")).collect()}
    finally:
        N.collapse_positions = original
    assert got == {("a", "a"): n * (n - 1) // 2, ("a", "b"): 2 * n, ("b", "b"): 1}


def test_everything_can_be_built_twice(spark, tmp_path):
    t = Tables(spark, SF)
    out, now = str(tmp_path / "out"), dt.datetime(2024, 1, 1)
    raw, elements = t.write_csv(t.raw_registrations(), "raw"), t.write_elements()
    for _ in range(2):
        B.build_all(spark, raw, elements, out, now)
    levels = spark.read.parquet(f"{out}/pyramid")
    located = spark.read.parquet(f"{out}/businesses").count()
    totals = {r.zoom_level: r.n for r in levels.groupBy("zoom_level").agg(F.sum("business_count").alias("n")).collect()}
    assert set(totals.values()) == {located} and len(totals) == 12
    assert spark.read.json(f"{out}/refresh_events").count() == 10
    shown = Z.features_at(levels, spark.read.parquet(f"{out}/pyramid").limit(0).selectExpr("1L as osm_id", "center_lon", "center_lat", "business_count"), 12, top=5)
    assert shown.count() == 5


def test_scratch_tables_are_removed(spark):
    import os

    assert has_folder(spark)
    with scratch(spark):
        written(spark.range(3), "gone")
        assert any(n.startswith("gone") for n in os.listdir(f"{shared_dir(spark)}/geoledger"))
    assert not any(n.startswith("gone") for n in os.listdir(f"{shared_dir(spark)}/geoledger"))


def test_quantiles_of_many_rows_and_far_outliers(spark):
    from geoledger.operators.quantiles import exact_quantiles

    df = spark.range(0, 60_001, 1, 7).select(
        F.when(F.col("id") % 1000 == 0, 1e12).otherwise((F.col("id") * 7919 % 60_001).cast("double")).alias("x"), F.lit(2.0).alias("y"), F.lit(None).cast("double").alias("z"),
    )
    import numpy as np

    x = [r.x for r in df.collect()]
    got = {(r.column, r.probability): r.value for r in exact_quantiles(df, ["x", "y", "z"], [0.0, 0.25, 0.5, 0.9995, 1.0]).collect()}
    assert got == {("x", p): float(np.quantile(x, p)) for p in (0.0, 0.25, 0.5, 0.9995, 1.0)} | {("y", p): 2.0 for p in (0.0, 0.25, 0.5, 0.9995, 1.0)}
