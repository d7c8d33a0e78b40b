"""Map-feature JSON to the footprint table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType

from ..functions import text as T
from ..functions.geometry import polygon_wkt
from ..operators.footprint import simplify_footprints

ELEMENT = StructType([
    StructField("type", StringType()),
    StructField("id", LongType()),
    StructField("timestamp", StringType()),
    StructField("version", IntegerType()),
    StructField("geometry", ArrayType(StructType([
        StructField("lon", DoubleType()), StructField("lat", DoubleType()),
    ]))),
    StructField("tags", MapType(StringType(), StringType())),
])
DOCUMENT = StructType([StructField("elements", ArrayType(ELEMENT))])


def scan_elements(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Elements of map JSON documents: one document per line, or one per file with ``multi_line``."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", multi_line).json(path)
    return docs.select(F.inline("elements"))


def buildings_from_elements(
    elements: DataFrame, reference_year: int = 2024, simplify_tolerance: float | None = None
) -> DataFrame:
    """One row per way with at least four points; everything else drops out."""
    tags = F.col("tags")

    def tag(name: str):
        return F.try_element_at(tags, F.lit(name))

    kind = F.coalesce(tag("building"), F.lit("yes"))
    age = T.construction_age({t: tag(t) for t in T.AGE_TAGS}, tag("architectural_style"), reference_year)
    ways = elements.where((F.col("type") == "way") & (F.size("geometry") >= 4))
    out = ways.select(
        F.col("id").alias("osm_id"), F.col("type").alias("osm_type"),
        T.building_type(kind).alias("building_type"), T.building_category(kind).alias("building_category"),
        tag("name").alias("name"), tag("addr:housenumber").alias("addr_housenumber"),
        tag("addr:street").alias("addr_street"), tag("addr:city").alias("addr_city"),
        tag("addr:postcode").alias("addr_postcode"),
        T.height_m(tag("height")).cast("float").alias("height"), T.level_count(tag("building:levels")).alias("levels"),
        *[c.alias(n) for n, c in age.items()],
        tag("architectural_style").alias("architectural_style"), F.col("timestamp").alias("last_modified"),
        F.col("version"), polygon_wkt(F.col("geometry")).alias("geom_wkt"),
    )
    if simplify_tolerance is None:
        return out
    return simplify_footprints(out, tolerance=simplify_tolerance).select(*out.columns)
