"""Files in and out, SQL functions and the file stream."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from geoledger.session import fresh_path, shared_dir
from geoledger.sources import footprints as FP
from geoledger.sources import registrations as R
from geoledger.sources import sinks as S
from geoledger.sources.derived import Tables
from geoledger.sources.sql_functions import register_sql_functions
from geoledger.sources.tables import scan
from geoledger.streaming import ingest as I


def write_csv(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    lines = [",".join(R.RAW_COLUMNS)]
    for row in rows:
        lines.append(",".join('"%s"' % row.get(c, "").replace('"', '""') for c in R.RAW_COLUMNS))
    path.write_text("\n".join(lines) + "\n")


GOOD = {
    "UniqueID": "1", "DBA Name": '  The "Shop", Inc ', "Street Address": " 1 A ST", "City": " sf ", "State": "ca",
    "Source Zipcode": "PRUSS", "Business Start Date": "01/31/2020", "Business End Date": "null",
    "Business Location": "POINT (-122.41 37.77)", "NAICS Code": "7220-7229", "data_as_of": "2024-01-01",
}


def test_clean_registrations(spark, tmp_path):
    rows = [GOOD, {**GOOD, "UniqueID": "2", "Business Location": "POINT (-121.0 37.77)"},
            {**GOOD, "UniqueID": "3", "Business Location": ""}, {**GOOD, "UniqueID": "4", "Business Start Date": "31/31/2020"}]
    write_csv(tmp_path / "in" / "a.csv", rows)
    raw = R.scan_registrations(spark, str(tmp_path / "in"))
    assert raw.count() == 4 and raw.where(F.col("`Source Zipcode`").isNotNull()).count() == 0
    got = {r.unique_id: r for r in R.clean_registrations(raw).collect()}
    assert set(got) == {"1", "4"}
    one = got["1"]
    assert (one.dba_name, one.street_address, one.city, one.state) == ('The "Shop", Inc', "1 A ST", "SF", "CA")
    assert (one.business_start_date, one.business_end_date) == (dt.datetime(2020, 1, 31), None)
    assert (one.longitude, one.latitude, one.zipcode) == (-122.41, 37.77, None)
    assert got["4"].business_start_date is None
    assert tuple(R.clean_registrations(raw).columns) == R.BUSINESS_COLUMNS


def test_elements(spark, tmp_path):
    ring = [{"lon": 0.0, "lat": 0.0}, {"lon": 1.0, "lat": 0.0}, {"lon": 1.0, "lat": 1.0}, {"lon": 0.0, "lat": 1.0}]
    doc = {"elements": [
        {"type": "way", "id": 1, "version": 3, "geometry": ring, "tags": {"building": "House", "height": "35 ft", "building:levels": "2.5", "start_date": "1906-04-18"}},
        {"type": "way", "id": 2, "geometry": [*ring, ring[0]]},
        {"type": "way", "id": 3, "geometry": ring[:3], "tags": {}},
        {"type": "relation", "id": 4, "geometry": ring, "tags": {}},
        {"type": "way", "id": 5, "tags": {}}, {"type": "node", "id": 6}]}
    (tmp_path / "osm.json").write_text(json.dumps(doc, indent=1))
    elements = FP.scan_elements(spark, str(tmp_path / "osm.json"), multi_line=True)
    got = {r.osm_id: r for r in FP.buildings_from_elements(elements).collect()}
    assert set(got) == {1, 2}
    assert (got[1].building_category, got[1].levels, got[1].construction_year, got[1].age_source) == ("residential", 2, 1906, "start_date")
    assert got[1].height == pytest.approx(10.668, abs=1e-3)
    assert (got[2].building_type, got[2].building_category, got[2].height) == ("yes", "unknown", None)
    assert got[1].geom_wkt == got[2].geom_wkt == "POLYGON ((0.0 0.0, 1.0 0.0, 1.0 1.0, 0.0 1.0, 0.0 0.0))"
    thin = FP.buildings_from_elements(elements, simplify_tolerance=1e-5)
    assert {r.osm_id: r.geom_wkt for r in thin.collect()}[1] == got[1].geom_wkt


def test_scan_reads_only_the_named_columns(spark, tables):
    df = scan(spark, f"{tables.dir}/orders.parquet", key="o_orderkey").where("key > 5")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan and "GreaterThan(o_orderkey,5)" in plan


def test_partitioned_sink_prunes_and_drops_null_keys(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, area string")
    S.sink_parquet(df, str(tmp_path / "t"), ["area"])
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.count() == 2
    assert "PartitionFilters: [isnotnull(area" in back.where("area = 'a'")._jdf.queryExecution().executedPlan().toString()


def test_geojson_leaves_out_null_properties(spark):
    df = spark.createDataFrame([(1, None, 1.5, 2.5)], "id int, kind string, center_lon double, center_lat double")
    assert json.loads(S.geojson_features(df).first()[0]) == {
        "type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"id": 1}}
    kept = json.loads(S.geojson_features(df, ["kind"], keep_nulls=True).first()[0])
    assert kept["properties"] == {"kind": None}


def test_snapshots_add_up(spark, tmp_path):
    df = spark.range(3)
    for day in (1, 2):
        S.sink_snapshot(df, str(tmp_path / "s"), dt.datetime(2024, 1, day))
    assert spark.read.parquet(str(tmp_path / "s")).groupBy("snapshot_ts").count().count() == 2


def test_database_rows(spark, tables):
    rows = S.db_building_rows(tables.buildings)
    assert tuple(rows.columns) == S.DB_BUILDING_COLUMNS and rows.count() == tables.buildings.count()
    assert tuple(S.db_business_rows(tables.businesses).columns) == S.DB_BUSINESS_COLUMNS


def test_shared_dir_follows_the_session(spark):
    assert fresh_path(spark, "x").startswith(shared_dir(spark))
    assert fresh_path(spark, "x") != fresh_path(spark, "x")


def test_sql_functions(spark, tables):
    register_sql_functions(spark, tables.businesses)
    d = spark.sql("select calculate_distance(37.7749D, -122.4194D, 37.7849D, -122.4094D) d, point_in_bbox(1D, 1D, 0D, 0D, 1D, 1D) p").first()
    assert d.d == pytest.approx(1417.3, abs=1) and d.p is True
    every = spark.sql("select * from get_businesses_in_bbox(37.76D, -122.43D, 37.80D, -122.39D)").count()
    some = spark.sql("select * from get_businesses_in_bbox(37.76D, -122.43D, 37.80D, -122.39D, naics_filter => '7207')").count()
    assert 0 < some < every


def test_incremental_ingest(spark, tmp_path):
    inbox, table, marks = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "marks")
    write_csv(inbox / "1.csv", [GOOD, {**GOOD, "UniqueID": "2"}])
    I.incremental_ingest(spark, str(inbox), table, marks)
    write_csv(inbox / "2.csv", [{**GOOD, "DBA Name": "newer", "data_as_of": "2024-02-01"},
                                {**GOOD, "UniqueID": "2", "DBA Name": "late and older", "data_as_of": "2023-01-01"},
                                {**GOOD, "UniqueID": "3"}])
    I.incremental_ingest(spark, str(inbox), table, marks)
    I.incremental_ingest(spark, str(inbox), table, marks)  # nothing new
    got = {r.unique_id: r.dba_name for r in I.current_businesses(spark, table).collect()}
    assert got == {"1": "newer", "2": 'The "Shop", Inc', "3": 'The "Shop", Inc'}
    I.compact(spark, table, str(tmp_path / "compact"))
    again = {r.unique_id: r.dba_name for r in I.current_businesses(spark, str(tmp_path / "compact")).collect()}
    assert again == got


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "table")
    write_csv(inbox / "1.csv", [GOOD])
    for marks in ("m1", "m2"):  # a lost checkpoint replays batch 0
        I.incremental_ingest(spark, str(inbox), table, str(tmp_path / marks))
    assert spark.read.parquet(table).count() == 1


def test_jdbc_rows_come_back_in_ranges(spark):
    from geoledger.plans.catalog import QUERIES

    from .conftest import SF

    back = QUERIES["sink_jdbc"](spark, SF)
    assert back.rdd.getNumPartitions() > 1
    assert back.count() == back.select("osm_id").distinct().count() > 0


def test_footprint_rows_are_spread_before_the_costly_work(spark, tmp_path):
    keys = F.col("id").alias("p_partkey")
    spark.range(0, 25_000, 1, 1).select(keys, F.lit("SMALL").alias("p_type"), (F.col("id") % 50 + 1).cast("int").alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    buildings = Tables(spark, str(tmp_path)).buildings
    sizes = [r["n"] for r in buildings.groupBy(F.spark_partition_id().alias("task")).agg(F.count("osm_id").alias("n")).collect()]
    assert len(sizes) == 3 and sum(sizes) == 25_000 and max(sizes) < 9_000  # one row group, three tasks
    assert buildings.agg(F.count_distinct("osm_id")).first()[0] == 25_000
