"""Base tables derived from the star-schema test tables.

The test data has no coordinates, so businesses, footprints, raw files and
event logs are computed from it with whole-number arithmetic. The SQL texts run
unchanged on any engine; ``{name}`` stands for an input table.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import ring_points, with_centroid
from ..session import fresh_path, written
from .registrations import RAW_COLUMNS
from .tables import scan, spread

BUSINESSES = """
select o_orderkey as unique_id,
       o_custkey as business_account_number,
       o_orderkey % 7 as location_id,
       c_name as ownership_name,
       case when o_orderkey % 4 = 0 then upper(c_name) else concat(o_orderpriority, ' SHOP ', cast(o_orderkey % 500 as varchar(9))) end as dba_name,
       case when o_orderkey % 200 = 0 then 'PIER LOT' else concat(cast(o_custkey % 900 + 1 as varchar(9)), ' MARKET ', case when o_orderkey % 3 = 0 then 'ST' when o_orderkey % 3 = 1 then 'AVE' else 'WALK' end) end as street_address,
       'SAN FRANCISCO' as city,
       'CA' as state,
       concat('941', lpad(cast(c_nationkey as varchar(9)), 2, '0')) as zipcode,
       o_orderdate as business_start_date,
       case when o_orderstatus = 'F' then o_orderdate + interval 400 day end as business_end_date,
       case when o_orderkey % 8 = 0 then null when o_orderkey % 5 = 0 then '7220-7229' else concat('72', lpad(cast((o_orderkey * 7) % 40 as varchar(9)), 2, '0')) end as naics_code,
       case when o_orderkey % 8 = 0 then null else o_orderpriority end as naics_description,
       case when o_orderkey % 97 = 0 then null else cast(-122430000 + (o_orderkey * o_orderkey * 31 + o_orderkey * 7919) % 40000 as double) / cast(1000000 as double) end as longitude,
       case when o_orderkey % 97 = 0 then null else cast(37760000 + (o_orderkey * o_orderkey * 13 + o_orderkey * 104729) % 30000 + case when o_orderkey % 50 = 0 then 80000 else 0 end as double) / cast(1000000 as double) end as latitude,
       case when o_custkey % 13 = 0 then null else o_custkey % 11 + 1 end as supervisor_district,
       c_mktsegment as neighborhood
from {orders} join {customer} on o_custkey = c_custkey
"""

BUILDINGS = """
select osm_id, building_type,
       case building_type when 'SMALL' then 'residential' when 'MEDIUM' then 'commercial' when 'LARGE' then 'industrial' when 'STANDARD' then 'institutional' when 'ECONOMY' then 'utility' else 'other' end as building_category,
       case when osm_id % 5 = 0 then null when osm_id % 3 = 0 then concat(cast(sz as varchar(9)), ' ft') else concat(cast(sz as varchar(9)), '.5 m') end as height_tag,
       case when osm_id % 4 = 0 then null when osm_id % 9 = 0 then 'x' else concat(cast(sz % 12 as varchar(9)), '.0') end as levels_tag,
       case when osm_id % 6 = 0 then null when osm_id % 7 = 0 then 'C19' else concat(cast(1880 + osm_id % 140 as varchar(9)), '-04-18') end as start_date_tag,
       case when osm_id % 11 = 0 then 'Victorian' end as architectural_style,
       case when osm_id % 40 <> 0 then concat('POLYGON ((',
            '-122.', lpad(cast(x0 as varchar(9)), 6, '0'), ' 37.', lpad(cast(y0 as varchar(9)), 6, '0'), ', ',
            '-122.', lpad(cast(x0 - w as varchar(9)), 6, '0'), ' 37.', lpad(cast(y0 as varchar(9)), 6, '0'), ', ',
            '-122.', lpad(cast(x0 - w as varchar(9)), 6, '0'), ' 37.', lpad(cast(y0 + w as varchar(9)), 6, '0'), ', ',
            '-122.', lpad(cast(x0 as varchar(9)), 6, '0'), ' 37.', lpad(cast(y0 + 2 * w as varchar(9)), 6, '0'), ', ',
            '-122.', lpad(cast(x0 as varchar(9)), 6, '0'), ' 37.', lpad(cast(y0 as varchar(9)), 6, '0'), '))') end as geom_wkt
from (select p_partkey as osm_id, p_type as building_type, p_size as sz, 40 + p_size as w,
             430000 - (p_partkey * p_partkey * 17 + p_partkey * 6007) % 40000 as x0,
             760000 + (p_partkey * p_partkey * 7 + p_partkey * 3001) % 30000 as y0
      from {part}) q
"""

# Map tags of a footprint, as they would stand in a map export.
TAGS = """
select osm_id, geom_wkt, height_tag, levels_tag, start_date_tag,
       case osm_id % 9 when 0 then 'house' when 1 then 'Retail' when 2 then 'warehouse' when 3 then 'school'
            when 4 then 'garage' when 5 then 'yes' when 6 then '' when 7 then null else lower(building_type) end as building_tag,
       case when osm_id % 12 = 0 then 'built 1931' end as construction_tag,
       case osm_id % 11 when 0 then 'Victorian' when 1 then 'Edwardian' when 2 then 'art_deco' when 3 then 'Brutalist' end as style_tag,
       case when osm_id % 3 = 0 then 'MARKET ST' end as street_tag,
       case when osm_id % 37 = 0 then 'relation' else 'way' end as element_type
from {buildings}
"""

HISTORY = """
select event_id, event_type as dataset, ts, least(cast(1 as double), value / cast(20 as double)) as score
from {events}
"""

REFRESHES = """
select event_id, ts,
       case event_type when 'click' then 'business_refresh' when 'view' then 'buildings_refresh'
            when 'signup' then 'spatial_join' when 'purchase' then 'monitoring' else 'full_pipeline' end as event_type,
       case when event_id % 9 = 0 then 'error' when event_id % 10 = 1 then 'skipped' else 'success' end as status,
       props as details
from {events}
"""

LOADS = """
select event_id, ts, case event_type when 'click' then 'business_data' when 'view' then 'building_data'
       when 'signup' then 'spatial_joins' else event_type end as dataset
from {events}
"""


_FILES: dict[tuple[str, str, str], str] = {}


class Tables:
    """The derived tables over one folder of test tables, all lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return scan(self.spark, f"{self.dir}/{name}.parquet")

    def _run(self, text: str, **inputs: DataFrame) -> DataFrame:
        return self.spark.sql(text, **inputs)

    @cached_property
    def businesses(self) -> DataFrame:
        return self._run(BUSINESSES, orders=self.raw("orders"), customer=scan(self.spark, f"{self.dir}/customer.parquet"))

    @cached_property
    def buildings(self) -> DataFrame:
        """Footprints; their text is costly to make and to parse, so the rows are spread first."""
        return self._run(BUILDINGS, part=spread(scan(self.spark, f"{self.dir}/part.parquet", "p_partkey", "p_type", "p_size")))

    @cached_property
    def stored(self) -> DataFrame:
        """The businesses as a written table, for work that reads them more than once."""
        return written(self.businesses, "businesses")

    def kept(self, *columns: str) -> DataFrame:
        """Some columns of the businesses as a written table."""
        return written(self.businesses.select(*columns), "businesses")

    @cached_property
    def centred(self) -> DataFrame:
        """Footprint centres as a written table, so every polygon text is parsed once."""
        columns = ["osm_id", "building_type", "building_category", "geom_wkt"]
        return written(with_centroid(self.buildings.select(*columns)).drop("geom_wkt"), "centres")

    @cached_property
    def tags(self) -> DataFrame:
        return self._run(TAGS, buildings=self.buildings)

    @cached_property
    def history(self) -> DataFrame:
        return self._run(HISTORY, events=self.raw("events"))

    @cached_property
    def refreshes(self) -> DataFrame:
        return self._run(REFRESHES, events=self.raw("events"))

    @cached_property
    def loads(self) -> DataFrame:
        return self._run(LOADS, events=self.raw("events"))

    def raw_registrations(self) -> DataFrame:
        """Businesses turned back into the text columns of a registration file."""
        b = self.businesses
        uid = F.col("unique_id")

        def padded(c: str) -> Column:
            return F.concat(F.lit("  "), F.col(c), F.lit(" \t"))

        def us(c: str) -> Column:
            return F.date_format(c, "MM/dd/yyyy")

        point = F.concat(
            F.lit("POINT ("), F.col("longitude").cast("string"), F.lit(" "), F.col("latitude").cast("string"), F.lit(")")
        )
        values = {
            "UniqueID": uid.cast("string"),
            "Business Account Number": F.col("business_account_number").cast("string"),
            "Location Id": F.col("location_id").cast("string"),
            "Ownership Name": padded("ownership_name"),
            "DBA Name": padded("dba_name"),
            "Street Address": padded("street_address"),
            "City": F.concat(F.lit(" "), F.lower("city"), F.lit("  ")),
            "State": F.lower("state"),
            "Source Zipcode": F.when(uid % 500 == 0, "PRUSS").otherwise(F.col("zipcode")),
            "Business Start Date": F.when(uid % 333 == 0, "13/45/2020").otherwise(us("business_start_date")),
            "Business End Date": us("business_end_date"),
            "Location Start Date": us("business_start_date"),
            "NAICS Code": F.when(uid % 8 == 0, "NULL").otherwise(F.col("naics_code")),
            "NAICS Code Description": F.col("naics_description"),
            "Business Location": F.when(uid % 101 == 0, "POINT (unknown place)").otherwise(point),
            "Neighborhoods - Analysis Boundaries": F.col("neighborhood"),
            "Supervisor District": F.col("supervisor_district").cast("string"),
            "data_as_of": F.date_format("business_start_date", "yyyy-MM-dd"),
        }
        none = F.lit(None).cast("string")
        return b.select(*[values.get(c, none).alias(c) for c in RAW_COLUMNS])

    def file(self, label: str, write: Callable[[], str]) -> str:
        """Path of an input file made once per session and folder of tables."""
        key = (self.spark.sparkContext.applicationId, self.dir, label)
        if key not in _FILES:
            _FILES[key] = write()
        return _FILES[key]

    def registrations_csv(self) -> str:
        return self.file("registrations", lambda: self.write_csv(self.raw_registrations(), "registrations"))

    def elements_json(self) -> str:
        return self.file("elements", self.write_elements)

    def write_csv(self, df: DataFrame, label: str) -> str:
        path = fresh_path(self.spark, label)
        options = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
        df.write.options(**options).csv(path)
        return path

    def write_elements(self, path: str | None = None, version: int = 1, every: int = 1) -> str:
        """Footprints as map JSON documents, one per line; newer versions are all houses.

        Every second ring is left open, every 29th is cut to three points,
        every 37th is a relation.
        """
        ring = F.transform(ring_points(F.col("geom_wkt")), lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat")))
        osm = F.col("osm_id")
        geometry = F.when(osm % 29 == 0, F.slice(ring, 1, 3)).when(osm % 2 == 0, F.slice(ring, 1, 4)).otherwise(ring)
        tags = {
            "building": "building_tag", "height": "height_tag", "building:levels": "levels_tag",
            "start_date": "start_date_tag", "construction_date": "construction_tag",
            "architectural_style": "style_tag", "addr:street": "street_tag",
        }
        kind = F.col("building_tag") if version == 1 else F.lit("house")
        entries = F.array(*[F.struct(F.lit(k).alias("key"), (kind if k == "building" else F.col(v)).alias("value")) for k, v in tags.items()])
        element = F.struct(
            F.col("element_type").alias("type"), osm.alias("id"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"),
            F.lit(version).alias("version"), geometry.alias("geometry"),
            F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull())).alias("tags"),
        )
        path = path or fresh_path(self.spark, "elements")
        self.tags.where(osm % every == 0).select(F.array(element).alias("elements")).write.mode("append").json(path)
        return path
