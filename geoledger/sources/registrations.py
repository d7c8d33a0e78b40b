"""Raw registration files and their cleaned table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import measures as M
from ..functions import text as T
from ..functions.geometry import once

# Header of the registration file.
RAW_COLUMNS = (
    "UniqueID", "Business Account Number", "Location Id", "Ownership Name", "DBA Name", "Street Address", "City",
    "State", "Source Zipcode", "Business Start Date", "Business End Date", "Location Start Date",
    "Location End Date", "Administratively Closed", "Mail Address", "Mail City", "Mail State", "Mail Zipcode",
    "NAICS Code", "NAICS Code Description", "NAICS Code Descriptions List", "LIC Code", "LIC Code Description",
    "LIC Code Descriptions List", "Parking Tax", "Transient Occupancy Tax", "Business Location",
    "Business Corridor", "Neighborhoods - Analysis Boundaries", "Supervisor District",
    "Community Benefit District", "data_as_of", "data_loaded_at", "SF Find Neighborhoods",
    "Current Police Districts", "Current Supervisor Districts", "Analysis Neighborhoods", "Neighborhoods",
)
RAW_SCHEMA = StructType([StructField(name, StringType()) for name in RAW_COLUMNS])

# Cleaned column -> raw column that is taken over as it is.
_PLAIN = {
    "unique_id": "UniqueID",
    "business_account_number": "Business Account Number",
    "location_id": "Location Id",
    "zipcode": "Source Zipcode",
    "naics_code": "NAICS Code",
    "naics_description": "NAICS Code Description",
    "supervisor_district": "Supervisor District",
    "neighborhood": "Neighborhoods - Analysis Boundaries",
}

BUSINESS_COLUMNS = (
    "unique_id", "business_account_number", "location_id", "ownership_name", "dba_name", "street_address", "city",
    "state", "zipcode", "business_start_date", "business_end_date", "location_start_date", "location_end_date",
    "naics_code", "naics_description", "longitude", "latitude", "supervisor_district", "neighborhood",
)

CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', "mode": "PERMISSIVE", "enforceSchema": "false"}


def without_null_tokens(df: DataFrame) -> DataFrame:
    """Every text that stands for "no value" becomes null, in one projection."""
    return df.select(*[T.null_tokens_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])


def scan_registrations(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """Registration CSV with all columns as text, in the fixed order.

    Every file's header is checked against it: one with other columns, or in
    another order, fails instead of being read into wrong columns. Files stay
    splittable unless ``multi_line`` (quoted line breaks) is asked for.
    """
    return without_null_tokens(spark.read.schema(RAW_SCHEMA).options(**CSV_OPTIONS, multiLine=str(multi_line).lower()).csv(path))


def _cleaned() -> dict[str, Column]:
    raw = {name: F.col(f"`{name}`") for name in RAW_COLUMNS}
    out = {name: raw[source] for name, source in _PLAIN.items()}
    out["ownership_name"] = T.strip(raw["Ownership Name"])
    out["dba_name"] = T.strip(raw["DBA Name"])
    out["street_address"] = T.strip(raw["Street Address"])
    out["city"] = T.strip_upper(raw["City"])
    out["state"] = T.strip_upper(raw["State"])
    for name in ("business_start_date", "business_end_date", "location_start_date", "location_end_date"):
        out[name] = T.us_date(raw[name.replace("_", " ").title()])
    out["longitude"], out["latitude"] = F.col("_lon"), F.col("_lat")
    return out


def clean_registrations(
    raw: DataFrame, box: Sequence[float] | None = M.SF_BOX, keep: Sequence[str] = ()
) -> DataFrame:
    """Raw registrations to the businesses table; rows outside ``box`` are dropped.

    ``keep`` names raw columns to carry along under their own name.
    """
    columns, place = _cleaned(), F.col("`Business Location`")
    located = once(raw, _lon=T.point_lon(place), _lat=T.point_lat(place))  # the point text is parsed once, before any filter
    inside = located.where(M.in_box(F.col("_lon"), F.col("_lat"), box))
    return inside.select(*[columns[c].alias(c) for c in BUSINESS_COLUMNS], *keep)
