"""From raw files to every stored table and report, as a sequence of Spark jobs.

Each step reads what an earlier one wrote and replaces what it wrote before,
so a step, or all of it, can be run again. The quality history and the refresh
events are appended to.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import changes as C
from ..operators import pyramid as Z
from ..operators import quality as Q
from ..operators.near import nearest_join
from ..sources import footprints as FP
from ..sources import registrations as R
from ..sources import sinks as S
from . import profile


def build_businesses(spark: SparkSession, csv_path: str, out: str) -> DataFrame:
    """Cleaned businesses laid out by place, and copies by industry and by neighbourhood."""
    S.sink_located(R.clean_registrations(R.scan_registrations(spark, csv_path)), f"{out}/businesses", mode="overwrite")
    businesses = spark.read.parquet(f"{out}/businesses")
    S.sink_parquet(businesses, f"{out}/businesses_by_naics", ["naics_code"], rows_per_file=1_000_000, mode="overwrite")
    S.sink_parquet(businesses, f"{out}/businesses_by_neighborhood", ["neighborhood"], rows_per_file=1_000_000, mode="overwrite")
    return businesses


def build_buildings(
    spark: SparkSession, elements_path: str, out: str, multi_line: bool = False, simplify_tolerance: float | None = 1e-5
) -> DataFrame:
    """Footprints, their centres, and copies by type and by category."""
    elements = FP.scan_elements(spark, elements_path, multi_line)
    S.sink_parquet(FP.buildings_from_elements(elements, simplify_tolerance=simplify_tolerance), f"{out}/buildings", mode="overwrite")
    buildings = spark.read.parquet(f"{out}/buildings")
    S.sink_parquet(buildings, f"{out}/buildings_by_type", ["building_type"], mode="overwrite")
    S.sink_parquet(buildings, f"{out}/buildings_by_category", ["building_category"], mode="overwrite")
    S.sink_parquet(profile.footprint_centres(buildings), f"{out}/centres", mode="overwrite")
    return buildings


def build_matches(spark: SparkSession, out: str, max_distance_m: float = 100.0, radius: float = 0.0005) -> None:
    """Nearest matches, (building, business) pairs, and their building and grid profiles."""
    businesses, centres = spark.read.parquet(f"{out}/businesses"), spark.read.parquet(f"{out}/centres")
    S.sink_parquet(nearest_join(businesses, centres, max_distance_m), f"{out}/matches", mode="overwrite")
    S.sink_parquet(profile.pair_table(businesses, centres, radius), f"{out}/pairs", mode="overwrite")
    # the profiles come from pairs folded by centre, position and kind
    S.sink_parquet(profile.spot_pairs(businesses, centres, radius), f"{out}/spot_pairs", mode="overwrite")
    folded = spark.read.parquet(f"{out}/spot_pairs")
    S.sink_parquet(A.agg_by_building_full(folded, weight="weight", buildings=centres), f"{out}/building_profile", mode="overwrite")
    S.sink_parquet(A.agg_by_grid(folded, weight="weight", buildings=centres), f"{out}/grid_profile", mode="overwrite")
    S.sink_geojson(spark.read.parquet(f"{out}/building_profile"), f"{out}/building_profile_geojson", "overwrite")


def build_pyramid(spark: SparkSession, out: str) -> None:
    levels = Z.zoom_pyramid(spark.read.parquet(f"{out}/businesses"))
    S.sink_parquet(levels, f"{out}/pyramid", ["zoom_level"], mode="overwrite")


def build_reports(spark: SparkSession, out: str, now: dt.datetime) -> None:
    """Validation, quality score, coverage and processing reports, and the quality history line."""
    businesses, buildings = spark.read.parquet(f"{out}/businesses"), spark.read.parquet(f"{out}/buildings")
    centres, pairs = spark.read.parquet(f"{out}/centres"), spark.read.parquet(f"{out}/spot_pairs").withColumn("weight", F.col("weight") * F.col("buildings"))
    profiles, matches = spark.read.parquet(f"{out}/building_profile"), spark.read.parquet(f"{out}/matches")
    score = Q.quality_score(businesses, now).withColumn("ts", F.lit(now.isoformat()))
    S.sink_report_json(Q.validation_report(businesses, buildings), f"{out}/reports/validation", "overwrite")
    S.sink_report_json(A.coverage_stats(businesses, buildings, centres, pairs, profiles, weight="weight"), f"{out}/reports/coverage", "overwrite")
    S.sink_report_json(A.processing_stats(businesses, buildings, matches), f"{out}/reports/processing", "overwrite")
    S.sink_report_json(A.match_summary(matches), f"{out}/reports/matches", "overwrite")
    score.write.mode("append").json(f"{out}/reports/quality_history")


def build_all(
    spark: SparkSession, csv_path: str, elements_path: str, out: str, now: dt.datetime, multi_line: bool = False
) -> None:
    """Everything in order; every step appends a refresh event."""
    steps = {
        "business_refresh": lambda: build_businesses(spark, csv_path, out),
        "buildings_refresh": lambda: build_buildings(spark, elements_path, out, multi_line),
        "spatial_join": lambda: build_matches(spark, out),
        "pyramid": lambda: build_pyramid(spark, out),
        "monitoring": lambda: build_reports(spark, out, now),
    }
    for name, step in steps.items():
        status, detail = "success", ""
        try:
            step()
        except Exception as error:
            status, detail = "error", str(error)
            raise
        finally:
            event = spark.range(1).select(
                F.lit(now).alias("timestamp"), F.lit(name).alias("event_type"), F.lit(status).alias("status"),
                F.lit(detail).alias("details"),
            )
            S.append_refresh_events(event, f"{out}/refresh_events")


def monitoring_report(spark: SparkSession, out: str, now: dt.datetime) -> DataFrame:
    """Alerts on stale data and on a low or falling quality score."""
    events = spark.read.json(f"{out}/refresh_events").where("status = 'success'")
    kinds = {"business_refresh": "business_data", "buildings_refresh": "building_data", "spatial_join": "spatial_joins"}
    named = F.element_at(F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv]), F.col("event_type"))
    loads = events.select(named.alias("dataset"), F.to_timestamp("timestamp").alias("ts")).where(F.col("dataset").isNotNull())
    history = spark.read.json(f"{out}/reports/quality_history").select(
        F.lit("businesses").alias("dataset"), "ts", F.col("overall_score").alias("score")
    )
    return C.monitor_alerts(C.freshness_check(loads, now), Q.quality_trend(history))
