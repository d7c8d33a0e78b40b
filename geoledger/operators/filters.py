"""Row filters and lookups."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from .rollup import top_rows

# The columns of the box lookup and of the building lookup.
BOX_COLUMNS = (
    "unique_id", "dba_name", "longitude", "latitude", "naics_code", "naics_description",
    "neighborhood", "supervisor_district",
)
NEAR_BUILDING_COLUMNS = (
    "business_account_number", "dba_name", "naics_description", "street_address", "longitude", "latitude",
)


def not_null(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def bbox_filter(
    df: DataFrame, box: Sequence[float] | None, lon: str = "longitude", lat: str = "latitude"
) -> DataFrame:
    return df.where(M.in_box(F.col(lon), F.col(lat), box))


def businesses_in_bbox(
    businesses: DataFrame, box: Sequence[float], naics: str | None = None, neighborhood: str | None = None
) -> DataFrame:
    out = bbox_filter(businesses, box)
    if naics is not None:
        out = out.where(F.col("naics_code") == naics)
    if neighborhood is not None:
        out = out.where(F.col("neighborhood") == neighborhood)
    return out.select(*BOX_COLUMNS)


def businesses_near_building(
    businesses: DataFrame, centred: DataFrame, building_id: int, radius: float = 0.0001, limit: int = 20
) -> DataFrame:
    """The closest businesses in a square of +-radius around one building."""
    at = centred.where(F.col("osm_id") == building_id).agg(
        F.min_by(F.struct("center_lon", "center_lat"), "osm_id").alias("c")
    ).scalar()
    lon, lat = F.col("longitude"), F.col("latitude")
    near = businesses.withColumn("_c", at).where(
        lon.between(F.col("_c.center_lon") - radius, F.col("_c.center_lon") + radius)
        & lat.between(F.col("_c.center_lat") - radius, F.col("_c.center_lat") + radius)
    )
    gap = M.planar_degrees(lon, lat, F.col("_c.center_lon"), F.col("_c.center_lat"))
    ranked = top_rows(near.withColumn("_gap", gap), limit, F.col("_gap"), F.col("unique_id"))
    return ranked.select("unique_id", *NEAR_BUILDING_COLUMNS)


def buildings_in_bbox(enriched: DataFrame, box: Sequence[float] | None, limit: int | None = None) -> DataFrame:
    """Buildings whose centre lies in the box; with ``limit`` only that many of the smallest ids."""
    found = bbox_filter(enriched, box, "center_lon", "center_lat")
    return found if limit is None else top_rows(found, limit, F.col("osm_id"))


def with_business_counts(centred: DataFrame, profiles: DataFrame) -> DataFrame:
    """Buildings with the number and density band of businesses in reach, from their profiles; none: 0 and "none"."""
    counts = profiles.select(F.col("building_id").alias("osm_id"), "business_count", "density_category")
    return centred.join(counts, "osm_id", "left").withColumns({
        "business_count": F.coalesce("business_count", F.lit(0)), "density_category": F.coalesce("density_category", F.lit("none")),
    })


def stand_in_density(centred: DataFrame) -> DataFrame:
    """Simulated density by building id and category, for layouts without any business data."""
    return centred.withColumns({
        "business_count": M.stand_in_count(F.col("osm_id"), F.col("building_category")),
        "business_intensity": M.category_intensity(F.col("building_category")),
        "business_density": (F.col("osm_id") % 10).cast("int"),
    })


def multi_filter(
    businesses: DataFrame,
    codes: Sequence[str] | None = None,
    neighborhoods: Sequence[str] | None = None,
    started: tuple[dt.date, dt.date] | None = None,
    box: Sequence[float] | None = None,
    open_at: dt.date | None = None,
    locations: tuple[int, int | None] | None = None,
) -> DataFrame:
    """Businesses that meet all given criteria.

    ``locations`` bounds the size of the owner: registrations per account over
    the whole table.
    """
    out = bbox_filter(businesses, box)
    if codes is not None:
        out = out.where(F.col("naics_code").isin(*codes))
    if neighborhoods is not None:
        out = out.where(F.col("neighborhood").isin(*neighborhoods))
    if started is not None:
        out = out.where(F.col("business_start_date").between(*[F.lit(d) for d in started]))
    if open_at is not None:
        out = out.where(F.col("business_end_date").isNull() | (F.col("business_end_date") > F.lit(open_at)))
    if locations is not None:
        least, most = locations
        sizes = businesses.groupBy("business_account_number").agg(F.count(F.lit(1)).alias("_n"))
        fits = F.col("_n") >= least
        if most is not None:
            fits = fits & (F.col("_n") <= most)
        out = out.join(sizes.where(fits), "business_account_number", "left_semi")
    return out
