"""Text, number and date parsing. Every function maps Columns to Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the input files use for "no value".
NULL_TOKENS = ("", "null", "NULL", "PRUSS")

# Building tag -> category.
BUILDING_CATEGORIES = {
    "house": "residential",
    "apartments": "residential",
    "residential": "residential",
    "detached": "residential",
    "terrace": "residential",
    "dormitory": "residential",
    "hotel": "commercial",
    "office": "commercial",
    "commercial": "commercial",
    "retail": "commercial",
    "shop": "commercial",
    "supermarket": "commercial",
    "warehouse": "industrial",
    "industrial": "industrial",
    "factory": "industrial",
    "manufacture": "industrial",
    "school": "institutional",
    "hospital": "institutional",
    "church": "institutional",
    "university": "institutional",
    "public": "institutional",
    "government": "institutional",
    "civic": "institutional",
    "garage": "utility",
    "garages": "utility",
    "parking": "utility",
    "service": "utility",
    "utility": "utility",
    "yes": "unknown",
}

# Architectural style -> assumed year of construction.
STYLE_YEARS = {
    "victorian": 1890,
    "edwardian": 1905,
    "art_deco": 1925,
    "modernist": 1955,
    "contemporary": 1990,
}

# Date tags in the order they are trusted.
AGE_TAGS = ("start_date", "construction_date", "building:construction_date")

POINT_PATTERN = r"POINT \(([^\s]+) ([^\s]+)\)"
YEAR_PATTERN = r"\b(?:19|20)\d{2}\b"
METRES_PER_FOOT = 0.3048


def _extract(col: Column, pattern: str, group: int) -> Column:
    """``regexp_extract`` that gives null, not an empty string, on no match."""
    return F.nullif(F.regexp_extract(col, pattern, group), F.lit(""))


def _lookup(mapping: dict, key: Column) -> Column:
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.element_at(F.create_map(*pairs), key)


def null_tokens_to_null(col: Column) -> Column:
    return F.when(~col.isin(*NULL_TOKENS), col)


def strip(col: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(col, r"^\s+|\s+$", "")


def strip_upper(col: Column) -> Column:
    return F.upper(strip(col))


def point_lon(col: Column) -> Column:
    return _extract(col, POINT_PATTERN, 1).try_cast("double")


def point_lat(col: Column) -> Column:
    return _extract(col, POINT_PATTERN, 2).try_cast("double")


def us_date(col: Column) -> Column:
    """``MM/DD/YYYY`` text to a timestamp; null if it is no such date."""
    return F.try_to_timestamp(col, F.lit("M/d/yyyy"))


def height_m(col: Column) -> Column:
    """First number in the text, feet turned into metres."""
    number = _extract(col, r"(\d+\.?\d*)", 1).try_cast("double")
    return F.when(F.lower(col).contains("ft"), number * F.lit(METRES_PER_FOOT)).otherwise(number)


def level_count(col: Column) -> Column:
    """Whole part of a number text; null for anything else."""
    return col.try_cast("double").try_cast("int")


def building_category(tag: Column) -> Column:
    mapped = F.coalesce(_lookup(BUILDING_CATEGORIES, F.lower(tag)), F.lit("other"))
    return F.when(F.coalesce(tag, F.lit("")) == "", F.lit("unknown")).otherwise(mapped)


def building_type(tag: Column) -> Column:
    return F.when(F.coalesce(tag, F.lit("")) == "", F.lit("unknown")).otherwise(tag)


def construction_age(tags: dict[str, Column], style: Column, reference_year: int = 2024) -> dict[str, Column]:
    """Year of construction, age and where the year came from.

    ``tags`` maps tag names to text columns in order of trust; the first one
    that holds a year wins, then the architectural style.
    """
    found = {name: _extract(col, YEAR_PATTERN, 0).try_cast("int") for name, col in tags.items()}
    by_style = _lookup(STYLE_YEARS, F.lower(style))
    year = F.coalesce(*found.values(), by_style)
    source = F.coalesce(
        *[F.when(value.isNotNull(), F.lit(name)) for name, value in found.items()],
        F.when(by_style.isNotNull(), F.lit("architectural_style")),
    )
    return {
        "construction_year": year,
        "estimated_age_years": F.lit(reference_year) - year,
        "age_source": source,
    }
