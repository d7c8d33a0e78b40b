"""Named queries over a folder of test tables; one per operator."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import measures as M
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import analytics as N
from ..operators import changes as C
from ..operators import filters as L
from ..operators import footprint as P
from ..operators import near as J
from ..operators import pyramid as Z
from ..operators import quality as Q
from ..operators import upsert as U
from ..operators import versions as V
from ..operators.density import dbscan_districts
from ..operators.live_pyramid import LivePyramid
from ..operators.rollup import top_rows
from ..operators.shared_outlines import simplify_shared
from ..session import fresh_path, written
from ..sources import footprints as FP
from ..sources import registrations as R
from ..sources import sinks as S
from ..sources.derived import Tables
from ..sources.sql_functions import register_sql_functions
from ..sources.tables import scan
from ..streaming import ingest as I
from ..streaming import keyed as K
from . import profile

NOW = dt.datetime(2024, 2, 20)
SCORE_NOW = dt.datetime(1998, 1, 1)
BOX = (-122.42, 37.765, -122.40, 37.78)
BUILDING_ID = 1
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(Tables(spark, sf_dir))

    QUERIES[build.__name__] = run
    return build


def r(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round measured columns, so results can be compared across engines."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _counted_buildings(t: Tables, box=None) -> DataFrame:
    """Buildings with the real number of businesses in reach."""
    return profile.counted_buildings(t.businesses, t.centred, box)


def joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda v: v.cast("string")), ",")


# Scans, sources, sinks ------------------------------------------------------


@query
def scan_registrations(t: Tables) -> DataFrame:
    path = t.registrations_csv()
    raw = R.scan_registrations(t.spark, path)
    names = {
        "UniqueID": "unique_id", "DBA Name": "dba_name", "Source Zipcode": "zipcode", "NAICS Code": "naics_code",
        "Business Start Date": "start_text", "Business Location": "location", "Mail City": "mail_city",
    }
    return raw.select(*[F.col(f"`{old}`").alias(new) for old, new in names.items()])


@query
def scan_pruned(t: Tables) -> DataFrame:
    return scan(t.spark, f"{t.dir}/orders.parquet", business_id="o_orderkey", started="o_orderdate")


@query
def scan_osm_elements(t: Tables) -> DataFrame:
    out = FP.buildings_from_elements(FP.scan_elements(t.spark, t.elements_json()))
    return out.select(
        "osm_id", "osm_type", "building_type", "building_category", "addr_street",
        F.round(F.col("height").cast("double"), 3).alias("height"), "levels", "construction_year",
        "estimated_age_years", "age_source", "version", "geom_wkt",
    )


@query
def sink_parquet(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "businesses")
    S.sink_parquet(t.businesses, path, rows_per_file=50_000)
    return scan(t.spark, path, "unique_id", "naics_code", "longitude", "latitude", "business_start_date")


@query
def sink_partitioned(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "by-neighborhood")
    S.sink_parquet(t.businesses, path, partition_by=["neighborhood"], rows_per_file=10_000)
    back = scan(t.spark, path, "unique_id", "naics_code", "neighborhood")
    return back.where(F.col("neighborhood").isin("BUILDING", "MACHINERY"))


@query
def sink_located(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "located")
    S.sink_located(t.businesses.select("unique_id", "longitude", "latitude"), path, files=8)
    return L.bbox_filter(scan(t.spark, path), BOX)


@query
def sink_snapshot(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "snapshots")
    for day in (1, 2):
        S.sink_snapshot(t.buildings.select("osm_id", "building_type"), path, dt.datetime(2024, 1, day))
    return t.spark.read.option("recursiveFileLookup", False).parquet(path).groupBy(
        F.col("snapshot_ts").cast("string").alias("snapshot_ts")
    ).agg(F.count(F.lit(1)).alias("row_count"), F.sum("osm_id").alias("id_sum"))


@query
def sink_geojson(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "geojson")
    S.sink_geojson(
        _counted_buildings(t), path,
        properties=["osm_id", "building_type", "building_category", "business_count", "density_category"],
    )
    return t.spark.read.text(path).select(F.col("value").alias("feature"))


@query
def sink_csv(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "csv")
    S.sink_csv(t.businesses.select("unique_id", "dba_name", "zipcode", "naics_code"), path)
    return t.spark.read.schema("unique_id bigint, dba_name string, zipcode string, naics_code string").option(
        "header", True
    ).csv(path)


@query
def sink_report_json(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "report")
    S.sink_report_json(Q.validation_report(t.stored, t.buildings), path)
    fields = ("completeness", "coordinates", "naics", "outliers", "addresses", "geometries", "overall_score")
    back = t.spark.read.schema(", ".join(f"{f} double" for f in fields) + ", total_checks int").json(path)
    return r(back, 9, *fields)


@query
def append_refresh_events(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "refresh-events")
    events = t.refreshes.select(F.col("ts").alias("timestamp"), "event_type", "status", "details")
    S.append_refresh_events(events.where(F.col("status") == "error"), path)
    S.append_refresh_events(events.where(F.col("status") != "error"), path)
    back = t.spark.read.schema("timestamp string, event_type string, status string, details string, month string").json(path)
    return back.groupBy("month", "event_type", "status").agg(F.count(F.lit(1)).alias("event_count"))


@query
def sink_jdbc(t: Tables) -> DataFrame:
    """Written to a database and read back in ranges.

    ``spark.geoledger.jdbc.url`` names the database (and ``.driver`` its
    driver). Without it, on one machine, it is the one in memory that comes
    with Spark; on a cluster, whose executors can't reach that, it is an error.
    """
    rows = S.db_building_rows(t.buildings).select("osm_id", "building_type", "address", "geom_wkt", "centroid_lon", "centroid_lat")
    url = t.spark.conf.get("spark.geoledger.jdbc.url", None)
    if url is None:
        if t.spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.geoledger.jdbc.url to a database that all executors reach")
        url, driver = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    else:
        driver = t.spark.conf.get("spark.geoledger.jdbc.driver", None)
    options = {"driver": driver} if driver else {}
    name = f"buildings_{uuid.uuid4().hex}"
    S.sink_jdbc(rows, url, name, options)
    ends = rows.agg(F.min("osm_id").alias("low"), F.max("osm_id").alias("high")).first()
    ranges = {} if ends["low"] is None else {"column": "osm_id", "lowerBound": ends["low"], "upperBound": ends["high"] + 1, "numPartitions": t.spark.sparkContext.defaultParallelism}
    return t.spark.read.jdbc(url, name, properties=options, **ranges).select(*[F.col(c).cast(k).alias(c) for c, k in rows.dtypes])


@query
def verify_load(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "loaded")
    S.sink_parquet(S.db_business_rows(t.businesses), path)
    loaded = scan(t.spark, path)
    probe = M.haversine_m(F.lit(37.7749), F.lit(-122.4194), F.lit(37.7849), F.lit(-122.4094))
    out = S.verify_load(t.businesses, loaded, "longitude", "latitude")
    return out.withColumn("distance_test", F.round(probe, 4))


# Projections, parsing, cleaning ---------------------------------------------


@query
def parse_point(t: Tables) -> DataFrame:
    place = F.col("`Business Location`")
    return t.raw_registrations().select(
        F.col("UniqueID").alias("unique_id"), X.point_lon(place).alias("longitude"), X.point_lat(place).alias("latitude")
    )


@query
def clean_text(t: Tables) -> DataFrame:
    raw = t.raw_registrations()
    return raw.select(
        F.col("UniqueID").alias("unique_id"), X.strip(F.col("`DBA Name`")).alias("dba_name"),
        X.strip(F.col("`Street Address`")).alias("street_address"), X.strip_upper(F.col("City")).alias("city"),
        X.strip_upper(F.col("State")).alias("state"),
    )


@query
def parse_us_date(t: Tables) -> DataFrame:
    raw = t.raw_registrations()
    return raw.select(
        F.col("UniqueID").alias("unique_id"),
        *[X.us_date(F.col(f"`Business {k} Date`")).cast("timestamp_ntz").alias(f"{k.lower()}_date") for k in ("Start", "End")],
    )


@query
def clean_registrations(t: Tables) -> DataFrame:
    path = t.registrations_csv()
    cleaned = R.clean_registrations(R.scan_registrations(t.spark, path))
    dates = [c for c in cleaned.columns if c.endswith("_date")]
    return cleaned.withColumns({c: F.col(c).cast("timestamp_ntz") for c in dates})


@query
def classify_building(t: Tables) -> DataFrame:
    tag = F.coalesce("building_tag", F.lit("yes"))
    return t.tags.select("osm_id", X.building_type(tag).alias("building_type"), X.building_category(tag).alias("building_category"))


@query
def estimate_building_age(t: Tables) -> DataFrame:
    tags = dict(zip(X.AGE_TAGS, (F.col("start_date_tag"), F.col("construction_tag"), F.lit(None).cast("string"))))
    age = X.construction_age(tags, F.col("style_tag"))
    return t.tags.select("osm_id", *[c.alias(n) for n, c in age.items()])


@query
def parse_height(t: Tables) -> DataFrame:
    return t.tags.select("osm_id", F.round(X.height_m(F.col("height_tag")), 6).alias("height_m"))


@query
def parse_levels(t: Tables) -> DataFrame:
    return t.tags.select("osm_id", X.level_count(F.col("levels_tag")).alias("levels"))


@query
def build_polygon_wkt(t: Tables) -> DataFrame:
    ring = F.transform(G.ring_points(F.col("geom_wkt")), lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat")))
    cut = F.when(F.col("osm_id") % 29 == 0, F.slice(ring, 1, 3)).when(F.col("osm_id") % 2 == 0, F.slice(ring, 1, 4)).otherwise(ring)
    return t.tags.select("osm_id", cut.alias("points")).select("osm_id", G.polygon_wkt(F.col("points")).alias("wkt"))


@query
def simplify_footprints(t: Tables) -> DataFrame:
    """Rings with a midpoint added to every edge: simplification takes them out again."""
    pairs = F.transform(G.ring_points(F.col("geom_wkt")), lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat")))
    ring = t.buildings.select("osm_id", pairs.alias("ring"))

    def with_midpoint(p: Column, i: Column) -> Column:
        q = F.get("ring", i + 1)
        middle = F.struct(((p["lon"] + q["lon"]) / 2).alias("lon"), ((p["lat"] + q["lat"]) / 2).alias("lat"))
        return F.when(q.isNull(), F.array(p)).otherwise(F.array(p, middle))

    dense = F.flatten(F.transform("ring", with_midpoint))
    return P.simplify_footprints(ring.select("osm_id", G.polygon_wkt(dense).alias("geom_wkt")), tolerance=1e-5)


@query
def simplify_terraces(t: Tables) -> DataFrame:
    """Blocks of 50 houses a row with bent walls between them: slight bends go from both sides of a wall, others stay on both."""
    k = F.col("osm_id").cast("long")
    i, j = k % 50, F.floor(k / 50)

    def bend(a: Column, b: Column, m: int) -> Column:
        return F.when((a * 7 + b * 3) % m == 0, 30).otherwise(2)

    x, y = i * 100 - 122430000, j * 100 + 37760000
    corners = [
        (x, y), (x + 50, y + bend(i, j, 4)), (x + 100, y), (x + 100 + bend(i + 1, j, 5), y + 50),
        (x + 100, y + 100), (x + 50, y + 100 + bend(i, j + 1, 4)), (x, y + 100), (x + bend(i, j, 5), y + 50), (x, y),
    ]
    ring = F.array(*[F.struct((a.cast("double") / 1000000).alias("lon"), (b.cast("double") / 1000000).alias("lat")) for a, b in corners])
    thin = simplify_shared(t.tags.select("osm_id", G.polygon_wkt(ring).alias("geom_wkt")), tolerance=1e-5)
    points = G.ring_points(F.col("geom_wkt"))

    def total(axis: str, origin: int) -> Column:
        return F.aggregate(F.slice(points, 1, F.size(points) - 1), F.lit(0).cast("long"), lambda s, p: s + F.round(p[axis] * 1000000).cast("long") - origin)

    return thin.select("osm_id", "vertices_before", "vertices_after", total("x", -122430000).alias("x_total"), total("y", 37760000).alias("y_total"))


@query
def wkt_centroid(t: Tables) -> DataFrame:
    return G.with_centroid(t.buildings.select("osm_id", "geom_wkt")).drop("geom_wkt")


@query
def wkt_vertex_mean(t: Tables) -> DataFrame:
    return G.with_vertex_mean(t.buildings.select("osm_id", "geom_wkt")).drop("geom_wkt")


@query
def wkt_first_vertex(t: Tables) -> DataFrame:
    return G.with_first_vertex(t.buildings.select("osm_id", "geom_wkt")).drop("geom_wkt")


@query
def haversine_m(t: Tables) -> DataFrame:
    d = M.haversine_m(F.col("latitude"), F.col("longitude"), F.lit(37.7749), F.lit(-122.4194))
    return t.businesses.select("unique_id", F.round(d, 4).alias("meters"))


@query
def distance_degrees(t: Tables) -> DataFrame:
    d = M.planar_degrees(F.col("longitude"), F.col("latitude"), F.lit(-122.4194), F.lit(37.7749))
    return t.businesses.select("unique_id", F.round(d, 9).alias("degrees"))


@query
def grid_cell_floor(t: Tables) -> DataFrame:
    sizes = F.explode(F.array(*[F.lit(s) for s in M.GRID_LEVELS]))
    leveled = t.businesses.where(F.col("longitude").isNotNull()).select("unique_id", "longitude", "latitude", sizes.alias("grid_size"))
    x, y = M.floor_cell(F.col("longitude"), F.col("grid_size")), M.floor_cell(F.col("latitude"), F.col("grid_size"))
    key = F.concat(x.cast("string"), F.lit("_"), y.cast("string"))
    return leveled.select("unique_id", "grid_size", x.alias("grid_x"), y.alias("grid_y"), key.alias("grid_key"))


@query
def grid_cell_round(t: Tables) -> DataFrame:
    lon, lat = F.col("longitude"), F.col("latitude")
    sizes = {"fixed": 0.002, "z12": M.on_demand_grid_size(12), "c10": M.cluster_size(10)}
    cells = [
        M.round_cell(c, s).alias(f"{name}_{axis}") for name, s in sizes.items() for axis, c in (("x", lon), ("y", lat))
    ]
    return t.businesses.where(lon.isNotNull()).select("unique_id", *cells)


@query
def hex_cell(t: Tables) -> DataFrame:
    located = t.businesses.where(F.col("longitude").isNotNull())
    zooms = F.explode(F.sequence(F.lit(1), F.lit(8)))
    sized = located.select("unique_id", "longitude", "latitude", zooms.alias("zoom_level")).withColumn(
        "size", F.lit(0.1) / F.pow(F.lit(2.0), F.col("zoom_level") - 1)
    )
    return sized.select(
        "unique_id", "zoom_level", M.hex_q(F.col("longitude"), F.col("latitude"), F.col("size")).alias("hex_q"),
        M.hex_r(F.col("latitude"), F.col("size")).alias("hex_r"),
    )


@query
def hash_bucket(t: Tables) -> DataFrame:
    return t.businesses.select("unique_id", M.code_class(F.col("naics_code")).alias("bucket"))


@query
def age_proxy(t: Tables) -> DataFrame:
    return t.businesses.select("unique_id", M.age_proxy(F.col("business_start_date")).alias("age"))


@query
def pack_points(t: Tables) -> DataFrame:
    packed = Z.pack_points(t.businesses.where(F.col("longitude").isNotNull()))
    names = ("lon", "lat", "size", "red", "green", "blue", "alpha")
    return packed.select("unique_id", *[F.col("point")[i].alias(n) for i, n in enumerate(names)])


@query
def density_category(t: Tables) -> DataFrame:
    n = F.col("n")
    sets = {
        "building": M.BUILDING_BANDS, "slim_building": M.SLIM_BUILDING_BANDS, "full_building": M.FULL_BUILDING_BANDS,
        "grid": M.GRID_BANDS, "slim_grid": M.SLIM_GRID_BANDS, "full_grid": M.FULL_GRID_BANDS,
        "business_grid": M.BUSINESS_GRID_BANDS,
    }
    counts = t.businesses.groupBy("business_account_number").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("business_account_number", "n", *[M.band(n, b).alias(name) for name, b in sets.items()])


@query
def intensity_score(t: Tables) -> DataFrame:
    counts = t.businesses.groupBy("business_account_number").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("naics_description").alias("d")
    )
    n, d = F.col("n"), F.col("d")
    return counts.select(
        "business_account_number", M.intensity(n, 10, d, 5).alias("first_score"), M.intensity(n, 10).alias("slim_score"),
        M.intensity(n, 5, d, 3).alias("full_score"),
    )


@query
def mixed_use_flag(t: Tables) -> DataFrame:
    counts = t.businesses.groupBy("business_account_number").agg(F.count_distinct("naics_description").alias("d"))
    return counts.select("business_account_number", M.mixed_use(F.col("d")).alias("mixed_use"))


@query
def proximity_quality(t: Tables) -> DataFrame:
    d = M.planar_degrees(F.col("longitude"), F.col("latitude"), F.lit(-122.4194), F.lit(37.7749))
    return t.businesses.select("unique_id", F.round(M.proximity_quality(d), 9).alias("quality"))


@query
def category_density_proxy(t: Tables) -> DataFrame:
    return L.stand_in_density(t.centred).select("osm_id", "business_count", "business_intensity", "business_density")


# Filters and lookups --------------------------------------------------------


@query
def bbox_filter(t: Tables) -> DataFrame:
    return L.bbox_filter(t.businesses, BOX).select("unique_id", "longitude", "latitude")


@query
def businesses_in_bbox(t: Tables) -> DataFrame:
    return L.businesses_in_bbox(t.businesses, BOX, naics="7207", neighborhood="BUILDING")


@query
def businesses_near_building(t: Tables) -> DataFrame:
    return L.businesses_near_building(t.businesses, t.centred, BUILDING_ID, radius=0.002)


@query
def not_null_filter(t: Tables) -> DataFrame:
    return L.not_null(t.businesses, "unique_id", "longitude", "latitude", "naics_code").select("unique_id", "naics_code")


@query
def buildings_in_bbox(t: Tables) -> DataFrame:
    return L.buildings_in_bbox(_counted_buildings(t, BOX), BOX)


# Joins ----------------------------------------------------------------------


def _nearest(t: Tables) -> DataFrame:
    return J.nearest_join(t.businesses, t.centred, 100.0)


@query
def nearest_building_join(t: Tables) -> DataFrame:
    return r(_nearest(t), 4, "distance_meters")


@query
def topn_building_join(t: Tables) -> DataFrame:
    out = J.nearest_join(t.businesses, t.centred, 200.0, k=3)
    metres = F.array_join(F.transform("distances_meters", lambda d: F.round(d * 1000).cast("bigint").cast("string")), ",")
    return out.select(
        "business_unique_id", "business_lon", "business_lat", "business_name",
        joined("building_osm_ids").alias("building_osm_ids"), F.array_join("building_types", ",").alias("building_types"),
        joined("building_lons").alias("building_lons"), joined("building_lats").alias("building_lats"),
        metres.alias("distances_mm"), F.col("match_count").cast("bigint").alias("match_count"),
    )


def _pairs(t: Tables) -> DataFrame:
    columns = ["unique_id", "longitude", "latitude", "naics_code", "naics_description"]
    return profile.pair_table(written(t.businesses.select(*columns), "places"), t.centred, digits=9)


def _folded(t: Tables) -> DataFrame:
    return profile.spot_pairs(t.businesses, t.centred)


@query
def radius_join(t: Tables) -> DataFrame:
    return _pairs(t)


@query
def radius_join_meters(t: Tables) -> DataFrame:
    pairs = J.position_pairs(t.kept("unique_id", "longitude", "latitude"), t.centred.select("osm_id", "center_lon", "center_lat"), 50.0, "meters", 4)
    return pairs.select(F.col("osm_id").alias("building_id"), F.col("unique_id").alias("business_id"), "distance_meters")


@query
def attach_attributes(t: Tables) -> DataFrame:
    return J.attributed_pairs(t.stored, t.centred, "dba_name", "neighborhood", "business_start_date")


@query
def point_in_polygon_join(t: Tables) -> DataFrame:
    pairs = P.point_in_polygon_join(
        t.kept("unique_id", "longitude", "latitude"), t.buildings.select("osm_id", "geom_wkt")
    )
    return pairs.select("unique_id", "osm_id")


def _halves(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A table, and a newer batch that overlaps it."""
    columns = ["unique_id", "dba_name", "zipcode"]
    old = t.businesses.where(F.col("unique_id") % 3 != 0).select(*columns)
    new = t.businesses.where(F.col("unique_id") % 3 != 1).select(
        "unique_id", F.concat(F.lit("NEW "), F.col("dba_name")).alias("dba_name"), "zipcode"
    )
    return old, new


@query
def upsert_ignore(t: Tables) -> DataFrame:
    old, new = _halves(t)
    return U.upsert_ignore(old, new, ["unique_id"], F.col("dba_name"))


@query
def upsert_update(t: Tables) -> DataFrame:
    old, new = _halves(t)
    return U.upsert_update(old, new, ["unique_id"], F.col("dba_name"))


# Aggregations ---------------------------------------------------------------


@query
def agg_by_building(t: Tables) -> DataFrame:
    return A.agg_by_building(profile.dated_spot_pairs(t.businesses, t.centred), weight="weight", buildings=t.centred)


@query
def agg_by_building_full(t: Tables) -> DataFrame:
    out = profile.building_profile(t.businesses, t.buildings)
    return r(out, 9, "avg_distance", "min_distance", "max_distance", "proximity_quality")


@query
def agg_by_building_slim(t: Tables) -> DataFrame:
    return A.agg_by_building_slim(_folded(t), "weight", t.centred)


@query
def agg_by_grid(t: Tables) -> DataFrame:
    return A.agg_by_grid(_folded(t), 0.002, weight="weight", buildings=t.centred)


@query
def agg_by_grid_fine(t: Tables) -> DataFrame:
    return A.agg_by_grid(_folded(t), 0.001, M.GRID_BANDS, "avg_businesses_per_building", "weight", t.centred)


@query
def business_grid(t: Tables) -> DataFrame:
    return A.business_grid(t.businesses)


@query
def grid_on_demand(t: Tables) -> DataFrame:
    return Z.grid_on_demand(t.businesses, 12, BOX)


@query
def hex_aggregate(t: Tables) -> DataFrame:
    return r(Z.hex_aggregate(t.businesses, 8), 9, "center_lon", "center_lat")


@query
def cluster_aggregate(t: Tables) -> DataFrame:
    return r(Z.cluster_aggregate(t.businesses, 9), 9, "lon_std", "lat_std", "spatial_variance")


@query
def zoom_pyramid(t: Tables) -> DataFrame:
    return Z.pyramid_summary(Z.zoom_pyramid(t.businesses))


@query
def hex_top(t: Tables) -> DataFrame:
    return r(Z.hex_aggregate(t.businesses, 8, top=200), 9, "center_lon", "center_lat")


@query
def true_hexagons(t: Tables) -> DataFrame:
    return r(Z.true_hexagons(t.businesses, 8), 9, "center_lon", "center_lat")


@query
def zoom_lookup(t: Tables) -> DataFrame:
    """One lookup per kind of feature: hexagons, clusters, buildings."""
    levels, buildings = Z.zoom_pyramid(t.businesses), _counted_buildings(t, BOX)
    shown = [Z.features_at(levels, buildings, zoom, BOX) for zoom in (8, 12, 16)]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query
def zoom_levels(t: Tables) -> DataFrame:
    out = Z.zoom_pyramid(t.businesses)
    return out.select("zoom_level", "cell_x", "cell_y", "business_count", "business_types", "primary_naics", "center_lon", "center_lat")


@query
def business_stats(t: Tables) -> DataFrame:
    return A.business_stats(t.businesses)


@query
def building_stats(t: Tables) -> DataFrame:
    age = X.construction_age({"start_date": F.col("start_date_tag"), "construction_date": F.col("construction_tag")}, F.col("style_tag"))
    tag = F.coalesce("building_tag", F.lit("yes"))
    typed = t.tags.select(
        X.building_type(tag).alias("building_type"), X.building_category(tag).alias("building_category"),
        F.col("street_tag").alias("addr_street"), X.height_m(F.col("height_tag")).alias("height"),
        X.level_count(F.col("levels_tag")).alias("levels"), F.col("style_tag").alias("architectural_style"),
        *[c.alias(n) for n, c in age.items()],
    )
    return A.building_stats(typed)


@query
def category_breakdown(t: Tables) -> DataFrame:
    return A.category_breakdown(t.buildings)


@query
def match_summary(t: Tables) -> DataFrame:
    out = A.match_summary(_nearest(t))
    return r(out, 4, *[c for c in out.columns if c.endswith("_meters")])


@query
def match_types_top10(t: Tables) -> DataFrame:
    return A.match_types_top(_nearest(t))


@query
def density_distribution(t: Tables) -> DataFrame:
    return r(A.density_distribution(profile.building_profile(t.businesses, t.buildings)), 9, "avg_count")


@query
def coverage_stats(t: Tables) -> DataFrame:
    pairs = written(_folded(t), "pairs")
    whole = pairs.withColumn("weight", F.col("weight") * F.col("buildings"))
    profiles = A.agg_by_building_full(pairs, weight="weight", buildings=t.centred)
    return A.coverage_stats(t.stored, t.buildings, t.centred, whole, profiles, weight="weight")


@query
def processing_stats(t: Tables) -> DataFrame:
    return r(A.processing_stats(t.stored, t.buildings, _nearest(t)), 6, "avg_distance", "match_rate")


@query
def column_profile(t: Tables) -> DataFrame:
    return A.column_profile(t.businesses).select("column_name", "null_count")


@query
def description_sample(t: Tables) -> DataFrame:
    return A.description_sample(t.businesses, 10)


# Data quality ---------------------------------------------------------------


@query
def check_completeness(t: Tables) -> DataFrame:
    return Q.check_completeness(t.businesses)


@query
def check_coordinates(t: Tables) -> DataFrame:
    return Q.check_coordinates(t.businesses)


@query
def check_naics(t: Tables) -> DataFrame:
    return Q.check_naics(t.businesses)


@query
def detect_duplicates(t: Tables) -> DataFrame:
    return r(Q.detect_duplicates(t.businesses), 12, "account_duplicate_rate", "name_address_duplicate_rate")


@query
def detect_outliers(t: Tables) -> DataFrame:
    out = Q.detect_outliers(t.stored)
    return r(out, 7, "lat_lower", "lat_upper", "lon_lower", "lon_upper", "lat_mean", "lon_mean")


@query
def check_geometries(t: Tables) -> DataFrame:
    return Q.check_geometries(t.buildings)


@query
def check_addresses(t: Tables) -> DataFrame:
    return Q.check_addresses(t.businesses)


@query
def validation_report(t: Tables) -> DataFrame:
    out = Q.validation_report(t.stored, t.buildings)
    return r(out, 9, *[c for c in out.columns if c != "total_checks"])


@query
def score_accuracy(t: Tables) -> DataFrame:
    return r(Q.score_accuracy(t.businesses), 9, "score")


@query
def score_consistency(t: Tables) -> DataFrame:
    return r(Q.score_consistency(t.stored), 9, "coordinate_consistency", "score")


@query
def score_validity(t: Tables) -> DataFrame:
    return r(Q.score_validity(t.businesses, SCORE_NOW), 9, "score")


@query
def score_uniqueness(t: Tables) -> DataFrame:
    return r(Q.score_uniqueness(t.businesses), 9, "score")


def _scores(t: Tables) -> DataFrame:
    return Q.quality_score(t.stored, SCORE_NOW)


@query
def quality_score(t: Tables) -> DataFrame:
    return r(_scores(t), 9, *Q.WEIGHTS, "overall_score")


@query
def score_checks(t: Tables) -> DataFrame:
    return r(Q.score_checks(t.stored, SCORE_NOW), 9, "score")


@query
def quality_alerts(t: Tables) -> DataFrame:
    return r(Q.quality_alerts(_scores(t)), 9, "current_value").select("type", "severity", "current_value", "threshold")


# Trends over time -----------------------------------------------------------


def _trend(t: Tables) -> DataFrame:
    return Q.quality_trend(t.history, tie=["event_id"])


@query
def quality_trend(t: Tables) -> DataFrame:
    return r(_trend(t), 9, "latest_score", "previous_score", "score_change")


@query
def dimension_trend(t: Tables) -> DataFrame:
    return r(Q.dimension_trend(t.history, dimension="dataset", tie=["event_id"]), 9, "current", "previous", "change")


# Sort, limit, sample, set operators -----------------------------------------


@query
def top_k_cells(t: Tables) -> DataFrame:
    cells = N.heatmap(t.businesses).select("grid_x", "grid_y", "business_count")
    return top_rows(cells, 200, F.desc("business_count"), F.col("grid_x"), F.col("grid_y"))


@query
def sample_points(t: Tables) -> DataFrame:
    located = L.not_null(t.businesses, "longitude", "latitude")
    return Z.sample_points(located, 1000, "unique_id").select("unique_id", "longitude", "latitude", "total_available")


@query
def map_points(t: Tables) -> DataFrame:
    return Z.map_points(t.businesses, BOX, 500).select("unique_id", F.col("point")[0].alias("lon"), F.col("point")[2].alias("size"))


@query
def union_batches(t: Tables) -> DataFrame:
    batches = [t.businesses.where(F.col("neighborhood") == s).select("unique_id", "neighborhood") for s in SEGMENTS]
    return U.union_batches(*batches)


@query
def distinct_pairs(t: Tables) -> DataFrame:
    batch = t.kept("unique_id", "longitude", "latitude")
    return J.distinct_radius_pairs(U.union_batches(batch, batch), t.centred)


# Change detection, freshness, refresh ---------------------------------------


def _versions(t: Tables) -> DataFrame:
    """One dataset version per event type and day."""
    columns = F.when(F.day("version") % 2 == 0, F.array(F.lit("id"), F.lit("name"))).otherwise(
        F.when(F.day("version") % 3 == 0, F.array(F.lit("id"), F.lit("email"))).otherwise(F.array(F.lit("id"), F.lit("name")))
    )
    return (
        t.raw("events").withColumn("version", F.to_date("ts"))
        .groupBy(F.col("event_type").alias("dataset_id"), "version")
        .agg(F.count(F.lit(1)).alias("total_rows"), F.max("ts").alias("last_updated"))
        .withColumn("columns", columns)
    )


@query
def detect_changes(t: Tables) -> DataFrame:
    out = C.detect_changes(_versions(t), row_delta=10)
    return out.withColumns({
        "version": F.col("version").cast("string"), "added": F.array_join("added", ","), "removed": F.array_join("removed", ","),
    })


@query
def schema_diff(t: Tables) -> DataFrame:
    return C.schema_diff(_versions(t)).withColumn("version", F.col("version").cast("string"))


def _freshness(t: Tables) -> DataFrame:
    return C.freshness_check(t.loads, NOW, {**C.FRESHNESS_HOURS, "quality_reports": 24.0})


@query
def freshness_check(t: Tables) -> DataFrame:
    return r(_freshness(t), 6, "age_hours").withColumnRenamed("exists", "table_exists")


@query
def needs_refresh(t: Tables) -> DataFrame:
    out = C.needs_refresh(t.refreshes, dt.datetime(2024, 2, 1), {**C.REFRESH_HOURS, "never_run": 24.0})
    return r(out, 6, "age_hours")


@query
def refresh_summary(t: Tables) -> DataFrame:
    return C.refresh_summary(t.refreshes)


@query
def run_status(t: Tables) -> DataFrame:
    """Every day's events as one pipeline run."""
    return C.run_status(t.refreshes.withColumn("run_id", F.date_format("ts", "yyyyMMdd")))


@query
def monitor_alerts(t: Tables) -> DataFrame:
    return r(C.monitor_alerts(_freshness(t), _trend(t)), 6, "value")


@query
def content_fingerprint(t: Tables) -> DataFrame:
    columns = ["unique_id", "dba_name", "naics_code", "longitude", "latitude"]
    return C.content_fingerprint(t.businesses, columns, "md5")


@query
def content_fingerprint_fast(t: Tables) -> DataFrame:
    """The default digest: blind to the order of rows, not to a value that changes its column."""
    plain = t.businesses.select("unique_id", "naics_code", F.lit(None).cast("string").alias("other"))
    moved = plain.select("unique_id", F.col("other").alias("naics_code"), F.col("naics_code").alias("other"))
    first, again, other = (C.content_fingerprint(df, ["unique_id", "naics_code", "other"]) for df in (plain, plain.orderBy(F.desc("unique_id")), moved))
    return first.select(
        "row_count", (F.col("fingerprint") == again.select("fingerprint").scalar()).alias("order_ignored"),
        (F.col("fingerprint") != other.select("fingerprint").scalar()).alias("move_seen"),
    )


@query
def version_changes(t: Tables) -> DataFrame:
    """Keys added, removed and changed between two stored versions, found by their digest trees."""
    columns = ["unique_id", "dba_name", "naics_code", "longitude"]
    rows, uid = t.businesses.select(*columns), F.col("unique_id")
    old, new = (fresh_path(t.spark, n) for n in ("old-version", "new-version"))
    V.write_version(rows.where(uid % 211 != 0), old, ["unique_id"])
    moved = rows.where(uid % 307 != 0).withColumn("dba_name", F.when(uid % 101 == 0, F.concat(F.lit("NEW "), "dba_name")).otherwise(F.col("dba_name")))
    V.write_version(moved, new, ["unique_id"])
    return V.version_changes(t.spark, old, new, ["unique_id"])


@query
def incremental_ingest(t: Tables) -> DataFrame:
    """Two deliveries of files, the second with newer versions of every third record, some of them moved out of the box."""
    raw = t.raw_registrations()
    inbox, table, marks = (fresh_path(t.spark, n) for n in ("inbox", "ingested", "ingest-checkpoint"))
    options = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    newer = raw.where(F.col("UniqueID").cast("bigint") % 3 == 0).withColumns({
        "DBA Name": F.concat(F.lit("NEW "), F.trim("DBA Name")), "data_as_of": F.lit("2030-01-01"),
        "Business Location": F.when(F.col("UniqueID").cast("bigint") % 15 == 0, "POINT (-100.5 40.5)").otherwise(F.col("Business Location")),
    })
    for delivery in (raw, newer):
        delivery.write.mode("append").options(**options).csv(inbox)
        I.incremental_ingest(t.spark, inbox, table, marks)
    return I.current_businesses(t.spark, table).select("unique_id", "dba_name", "zipcode", "longitude", "latitude", "data_as_of")


def _three_deliveries(t: Tables, after=lambda table, batch: None) -> K.KeyedTable:
    """All records; newer versions of every third, some out of the box; then late older ones and moves, a base folded in between."""
    raw, uid = t.raw_registrations(), F.col("UniqueID").cast("bigint")
    inbox, folder, marks = (fresh_path(t.spark, n) for n in ("inbox", "keyed", "keyed-checkpoint"))
    table = K.registrations_table(t.spark, folder, buckets=16)
    newer = raw.where(uid % 3 == 0).withColumns({
        "DBA Name": F.concat(F.lit("NEW "), F.trim("DBA Name")), "data_as_of": F.lit("2030-01-01"),
        "Business Location": F.when(uid % 15 == 0, "POINT (-100.5 40.5)").otherwise(F.col("Business Location")),
    })
    late = raw.where(uid % 5 == 0).withColumns({"DBA Name": F.lit("LATE"), "data_as_of": F.lit("1980-01-01")})
    moved = raw.where(uid % 70 == 0).withColumns({"data_as_of": F.lit("2031-01-01"), "Business Location": F.lit("POINT (-122.42 37.77)")})
    options = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}
    for batch, delivery in enumerate((raw, newer, late.unionByName(moved))):
        delivery.write.mode("append").options(**options).csv(inbox)
        K.ingest_changes(table, inbox, marks)
        after(table, batch)
        if batch == 0:
            table.fold()
    return table


@query
def keyed_ingest(t: Tables) -> DataFrame:
    """Rows of the keyed table: a base and the changes that the stream's state let through."""
    return _three_deliveries(t).rows().select("unique_id", "dba_name", "zipcode", "longitude", "latitude", "data_as_of")


@query
def ingest_changes(t: Tables) -> DataFrame:
    """What each delivery took back and brought; late rows do neither."""
    table = _three_deliveries(t)
    parts = [
        table.signed_changes(batch).groupBy("sign").agg(F.count(F.lit(1)).alias("row_count"), F.sum(F.col("unique_id").cast("bigint")).alias("id_sum")).withColumn("batch", F.lit(batch))
        for batch in range(3)
    ]
    return U.union_batches(*parts).select("batch", "sign", "row_count", "id_sum")


@query
def live_pyramid(t: Tables) -> DataFrame:
    """The zoom pyramid after three deliveries, each folded in by the cells it touches."""
    pyramid = LivePyramid(t.spark, fresh_path(t.spark, "live-pyramid"))
    _three_deliveries(t, lambda table, batch: pyramid.update(batch, written(table.signed_changes(batch), "signed"), table.rows(batch)))
    out = pyramid.levels(2).drop("cell_size", "aggregation_type")
    return r(out, 9, "spatial_variance")


@query
def incremental_footprints(t: Tables) -> DataFrame:
    """Two deliveries of map files, the newer versions first."""
    inbox, table, marks = (fresh_path(t.spark, n) for n in ("map-inbox", "map-ingested", "map-checkpoint"))
    for version, every in ((2, 3), (1, 1)):
        t.write_elements(inbox, version, every)
        I.incremental_footprints(t.spark, inbox, table, marks)
    return I.current_buildings(t.spark, table).select("osm_id", "building_type", "building_category", "version", "geom_wkt")


# SQL functions --------------------------------------------------------------


@query
def sql_functions(t: Tables) -> DataFrame:
    register_sql_functions(t.spark, t.businesses)
    return t.spark.sql("""
        SELECT unique_id, naics_code, round(calculate_distance(latitude, longitude, 37.7749D, -122.4194D), 4) AS meters,
               point_in_bbox(latitude, longitude, 37.765D, -122.42D, 37.78D, -122.41D) AS in_west_half
        FROM get_businesses_in_bbox(37.765D, -122.42D, 37.78D, -122.40D, neighborhood_filter => 'BUILDING')
    """)


# Declared analytics ---------------------------------------------------------


@query
def multi_filter(t: Tables) -> DataFrame:
    out = L.multi_filter(
        t.businesses, codes=["7207", "7214", "7221", "7220-7229"], neighborhoods=["BUILDING", "MACHINERY"],
        started=(dt.date(1992, 1, 1), dt.date(1997, 12, 31)), box=(-122.43, 37.76, -122.39, 37.79), locations=(5, None),
    )
    return out.select("unique_id", "naics_code", "neighborhood", "business_start_date")


@query
def openings_closings_trend(t: Tables) -> DataFrame:
    out = N.openings_closings_trend(t.businesses, "quarter")
    return out.withColumn("period", F.col("period").cast("timestamp_ntz"))


@query
def heatmap(t: Tables) -> DataFrame:
    return N.heatmap(t.businesses)


@query
def kmeans_districts(t: Tables) -> DataFrame:
    out = N.kmeans_districts(t.kept("unique_id", "longitude", "latitude"))
    return out.agg(
        F.count(F.lit(1)).alias("rows_assigned"), F.count_distinct("district").alias("districts"),
        F.count_if(F.col("distance_m") > F.col("nearest_m") + 1e-6).alias("rows_elsewhere"),
    )


@query
def dbscan_districts_query(t: Tables) -> DataFrame:
    return dbscan_districts(t.kept("unique_id", "longitude", "latitude"), eps=0.0003, min_points=5)


@query
def co_location(t: Tables) -> DataFrame:
    out = N.co_location(t.businesses.select("longitude", "latitude", "naics_code"))
    return r(out, 9, "lift").withColumn("pair_count", F.col("pair_count").cast("bigint"))


@query
def survival_rates(t: Tables) -> DataFrame:
    return N.survival_rates(t.businesses, dt.datetime(1999, 1, 1), (1, 2, 3, 5))


@query
def survival_curve(t: Tables) -> DataFrame:
    ended = F.when(F.col("unique_id") % 3 == 0, F.col("business_end_date") - F.make_dt_interval(F.col("unique_id") % 300)).otherwise(F.col("business_end_date"))
    return r(N.survival_curve(t.businesses.withColumn("business_end_date", ended), dt.datetime(1996, 1, 1)), 9, "survival", "std_error")


@query
def distributions(t: Tables) -> DataFrame:
    return N.distributions(t.businesses)


@query
def export_bundle(t: Tables) -> DataFrame:
    path = fresh_path(t.spark, "bundle")
    return S.export_bundle(
        t.businesses.select("unique_id", "dba_name", "longitude", "latitude"), path, "businesses", "longitude", "latitude"
    )


QUERIES["dbscan_districts"] = QUERIES.pop("dbscan_districts_query")
