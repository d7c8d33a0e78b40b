"""Session SQL functions for distance, box test and box lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def register_sql_functions(spark: SparkSession, businesses: DataFrame, view: str = "businesses") -> None:
    """Create ``calculate_distance``, ``point_in_bbox`` and the table function ``get_businesses_in_bbox``."""
    businesses.createOrReplaceTempView(view)
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION calculate_distance(lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE)
        RETURNS DOUBLE
        RETURN 2 * 6371000 * atan2(
            sqrt(pow(sin(radians(lat2 - lat1) / 2), 2)
                 + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)),
            sqrt(1 - pow(sin(radians(lat2 - lat1) / 2), 2)
                 - cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2)))
    """)
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION point_in_bbox(
            lat DOUBLE, lon DOUBLE, min_lat DOUBLE, min_lon DOUBLE, max_lat DOUBLE, max_lon DOUBLE)
        RETURNS BOOLEAN
        RETURN lat BETWEEN min_lat AND max_lat AND lon BETWEEN min_lon AND max_lon
    """)
    kinds = {f.name: f.dataType.simpleString() for f in businesses.schema}
    columns = [
        "unique_id", "dba_name", "longitude", "latitude", "naics_code", "naics_description", "neighborhood",
        "supervisor_district",
    ]
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION get_businesses_in_bbox(
            min_lat DOUBLE, min_lon DOUBLE, max_lat DOUBLE, max_lon DOUBLE,
            naics_filter STRING DEFAULT NULL, neighborhood_filter STRING DEFAULT NULL)
        RETURNS TABLE({", ".join(f"{c} {kinds[c]}" for c in columns)})
        RETURN SELECT {", ".join(f"b.{c}" for c in columns)} FROM {view} b
        WHERE b.latitude BETWEEN min_lat AND max_lat AND b.longitude BETWEEN min_lon AND max_lon
          AND (naics_filter IS NULL OR b.naics_code = naics_filter)
          AND (neighborhood_filter IS NULL OR b.neighborhood = neighborhood_filter)
    """)
