"""Raw files to all tables and reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from geoledger.plans import full_build as B
from geoledger.sources.derived import Tables

from .conftest import SF


def test_full_build(spark, tmp_path):
    t = Tables(spark, SF)
    out, now = str(tmp_path / "out"), dt.datetime(2024, 1, 1)
    B.build_all(spark, t.write_csv(t.raw_registrations(), "raw"), t.write_elements(), out, now)
    pairs = spark.read.parquet(f"{out}/pairs")
    profiles = spark.read.parquet(f"{out}/building_profile")
    grid = spark.read.parquet(f"{out}/grid_profile")
    n = pairs.count()
    assert n > 0
    assert profiles.agg(F.sum("business_count")).first()[0] == n
    assert grid.agg(F.sum("total_businesses")).first()[0] == n
    assert pairs.agg(F.max("distance_degrees")).first()[0] <= 0.0005
    bands = profiles.groupBy("density_category").count()
    assert bands.agg(F.sum("count")).first()[0] == profiles.count()
    assert spark.read.parquet(f"{out}/pyramid").select("zoom_level").distinct().count() == 12
    coverage = spark.read.json(f"{out}/reports/coverage").first()
    assert coverage.spatial_associations == n and coverage.buildings_with_businesses == profiles.count()
    alerts = B.monitoring_report(spark, out, now + dt.timedelta(days=8)).collect()
    assert {(a.alert_type, a.subject) for a in alerts} == {("data_freshness", "business_data"), ("data_freshness", "spatial_joins")}


def test_files_laid_out_by_place_are_skipped(spark, tmp_path):
    from geoledger.sources.sinks import sink_located

    path = str(tmp_path / "located")
    df = spark.range(4000).select(F.col("id").alias("k"), (F.col("id") % 200 / 100).alias("longitude"), (F.col("id") / 2000).alias("latitude"))
    sink_located(df, path, files=8)
    files = spark.read.parquet(path).withColumn("f", F.input_file_name())
    hit = files.where("latitude between 0.5 and 0.55").select("f").distinct().count()
    assert hit <= 2 and files.select("f").distinct().count() == 8
