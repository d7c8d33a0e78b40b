"""Aggregations per building, grid cell, hexagon and over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..session import written
from .quantiles import exact_quantiles
from .rollup import distinct_with_null, facet_rollup, top_rows

_BUILDING_KEYS = {
    "building_id": "building_id", "building_type": "building_type", "building_category": "building_category",
    "building_center_lon": "center_lon", "building_center_lat": "center_lat",
}


def _by_building(pairs: DataFrame) -> DataFrame:
    """Type, category and centre belong to the building id, so they group along."""
    return pairs.withColumnsRenamed({k: v for k, v in _BUILDING_KEYS.items() if k != v})


def _rolled(pairs: DataFrame, buildings: DataFrame | None, totals: Sequence[str] = (), **profile) -> DataFrame:
    """Rollup per building; with ``buildings``, once per centre in ``pairs`` and handed to all buildings there.

    A building row that repeats counts as often, which ``business_count`` and ``totals`` follow.
    """
    keys = list(_BUILDING_KEYS.values())
    if buildings is None:
        return facet_rollup(_by_building(pairs), keys, "business_count", **profile)
    spots = facet_rollup(_by_building(pairs), ["center_lon", "center_lat"], "business_count", **profile)
    own = buildings.withColumnRenamed("osm_id", "building_id").groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
    joined = own.join(spots, ["center_lon", "center_lat"])
    scaled = {c: F.col(c) * F.col("_copies") for c in ("business_count", *totals)}
    return joined.withColumns(scaled).select(*keys, *[c for c in spots.columns if c not in keys])


def agg_by_building(
    pairs: DataFrame, bands: Sequence = M.BUILDING_BANDS, per_business: int = 10, per_kind: int = 5, weight: str | None = None,
    buildings: DataFrame | None = None,
) -> DataFrame:
    """Counts, kinds, first type and active period per building; ``weight`` and ``buildings`` as in :func:`agg_by_building_full`."""
    out = _rolled(
        pairs, buildings,
        distinct={"unique_business_types": "naics_code", "business_diversity": "naics_description"},
        firsts={"primary_business_type": "naics_description"}, first_by="business_id",
        mins={"earliest_business": F.col("business_start_date")},
        maxs={"latest_business": F.col("business_end_date")}, weight=F.col(weight) if weight else None,
    )
    n, kinds = F.col("business_count"), F.col("business_diversity")
    return out.withColumns({
        "density_category": M.band(n, bands),
        "intensity_score": M.intensity(n, per_business, kinds, per_kind),
        "mixed_use": M.mixed_use(kinds),
    })


def agg_by_building_full(pairs: DataFrame, weight: str | None = None, buildings: DataFrame | None = None) -> DataFrame:
    """Per building: most frequent type, distance profile, score and bands.

    ``weight`` names a column that says how many businesses a row stands for.
    With ``buildings`` (osm_id, type, category, centre), pairs are those of
    distinct centres and need no building columns but the centre.
    """
    w = F.col(weight) if weight else None
    d = F.col("distance_degrees")
    out = _rolled(
        pairs, buildings, ["_distance"],
        distinct={"unique_business_types": "naics_code", "business_diversity": "naics_description"},
        modes={"primary_business_type": "naics_description"},
        sums={"_distance": d * w if weight else d},
        mins={"min_distance": d}, maxs={"max_distance": d}, weight=w,
    )
    n, kinds = F.col("business_count"), F.col("business_diversity")
    return (
        out.withColumn("avg_distance", F.col("_distance") / n)
        .drop("_distance")
        .withColumns({
            "density_category": M.band(n, M.FULL_BUILDING_BANDS),
            "intensity_score": M.intensity(n, 5, kinds, 3),
            "mixed_use": M.mixed_use(kinds),
            "proximity_quality": M.proximity_quality(F.col("avg_distance")),
        })
    )


def agg_by_building_slim(pairs: DataFrame, weight: str | None = None, buildings: DataFrame | None = None) -> DataFrame:
    """Per building: count, kinds, most frequent type, four bands and a count score; ``buildings`` as in :func:`agg_by_building_full`."""
    out = _rolled(
        pairs, buildings,
        distinct={"unique_business_types": "naics_code"},
        modes={"primary_business_type": "naics_description"}, weight=F.col(weight) if weight else None,
    )
    n = F.col("business_count")
    return out.withColumns({
        "density_category": M.band(n, M.SLIM_BUILDING_BANDS), "intensity_score": M.intensity(n, 10),
    })


def centre_sums(lon: str, lat: str, weight: Column | None = None) -> dict[str, Column]:
    """Exact coordinate sums for :func:`with_mean_position`.

    Sums are decimals, so no group is too large for them.
    """
    def exact(c: str) -> Column:
        value = M.fixed_point(F.col(c))
        return (value if weight is None else value * weight).cast("decimal(20,0)")

    return {"_sum_lon": exact(lon), "_sum_lat": exact(lat)}


def with_mean_position(df: DataFrame, count: str, lon: str = "center_lon", lat: str = "center_lat") -> DataFrame:
    def mean(total: str) -> Column:
        return F.col(total).cast("double") / F.col(count) / F.lit(float(M.COORDINATE_SCALE))

    return df.withColumns({lon: mean("_sum_lon"), lat: mean("_sum_lat")}).drop("_sum_lon", "_sum_lat")


def _cells_from_pairs(pairs: DataFrame, size: float, weight: str | None) -> DataFrame:
    lon, lat = "building_center_lon", "building_center_lat"
    per_building = pairs.groupBy("building_id", "building_category", lon, lat, "naics_code").agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_pairs")
    )
    celled = per_building.withColumns({
        "grid_x": M.floor_cell(F.col(lon), size), "grid_y": M.floor_cell(F.col(lat), size),
    })
    return facet_rollup(
        celled, ["grid_x", "grid_y"], "total_businesses",
        distinct={"building_count": "building_id", "business_type_diversity": "naics_code"},
        modes={"dominant_building_type": "building_category"},
        sums=centre_sums(lon, lat, F.col("_pairs")), weight=F.col("_pairs"),
    )


def _cells_from_spots(pairs: DataFrame, buildings: DataFrame, size: float, weight: str | None) -> DataFrame:
    """Codes are counted over distinct centres; buildings and categories over buildings, each with the pairs of its centre."""
    lon, lat = "center_lon", "center_lat"
    cell = {"grid_x": M.floor_cell(F.col(lon), size), "grid_y": M.floor_cell(F.col(lat), size)}
    per_code = written(_by_building(pairs).groupBy(lon, lat, "naics_code").agg(
        (F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_pairs")
    ), "spot-codes")
    per_spot = per_code.groupBy(lon, lat).agg(F.sum("_pairs").alias("_pairs"))
    own = buildings.select(F.col("osm_id").alias("building_id"), "building_category", lon, lat).join(per_spot, [lon, lat]).withColumns(cell)
    cells = facet_rollup(
        own, ["grid_x", "grid_y"], "total_businesses", distinct={"building_count": "building_id"},
        modes={"dominant_building_type": "building_category"}, sums=centre_sums(lon, lat, F.col("_pairs")), weight=F.col("_pairs"),
    )
    kinds = per_code.withColumns(cell).select("grid_x", "grid_y", "naics_code").distinct().groupBy("grid_x", "grid_y").agg(
        F.count(F.lit(1)).alias("business_type_diversity")
    )
    return cells.join(kinds, ["grid_x", "grid_y"]).select(
        "grid_x", "grid_y", "total_businesses", "building_count", "business_type_diversity", "dominant_building_type", "_sum_lon", "_sum_lat"
    )


def agg_by_grid(
    pairs: DataFrame, size: float = 0.002, bands: Sequence = M.FULL_GRID_BANDS, ratio: str = "density_ratio",
    weight: str | None = None, buildings: DataFrame | None = None,
) -> DataFrame:
    """Per floor cell: pairs, buildings, codes, mean centre, dominant category, band.

    Pairs are summed per building and code first, so the profile of a cell is
    rolled up from its buildings and not from every pair; with ``buildings``,
    as in :func:`agg_by_building_full`, per centre and code.
    """
    out = _cells_from_pairs(pairs, size, weight) if buildings is None else _cells_from_spots(pairs, buildings, size, weight)
    n = F.col("total_businesses")
    return with_mean_position(out, "total_businesses").withColumns({
        ratio: n / F.col("building_count"),
        "grid_size": F.lit(float(size)),
        "density_category": M.band(n, bands),
    })


def business_grid(businesses: DataFrame, size: float = 0.002) -> DataFrame:
    """Businesses per rounded cell with kinds, first type and neighbourhood."""
    located = businesses.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
    celled = located.withColumns({
        "grid_x": M.round_cell(F.col("longitude"), size), "grid_y": M.round_cell(F.col("latitude"), size),
    })
    out = facet_rollup(
        celled, ["grid_x", "grid_y"], "business_count",
        distinct={"business_types": "naics_code"},
        firsts={"primary_type": "naics_description", "neighborhood": "neighborhood"}, first_by="unique_id",
        sums=centre_sums("longitude", "latitude"),
    )
    return with_mean_position(out, "business_count").withColumns({
        "grid_size": F.lit(float(size)),
        "density_category": M.band(F.col("business_count"), M.BUSINESS_GRID_BANDS),
    })


def business_stats(businesses: DataFrame) -> DataFrame:
    return businesses.agg(
        F.count(F.lit(1)).alias("total_businesses"),
        distinct_with_null("naics_code").alias("unique_naics_codes"),
        distinct_with_null("neighborhood").alias("unique_neighborhoods"),
        distinct_with_null("supervisor_district").alias("unique_districts"),
        F.min("business_start_date").alias("earliest_start_date"),
        F.max("business_start_date").alias("latest_start_date"),
    )


def building_stats(buildings: DataFrame) -> DataFrame:
    return buildings.agg(
        F.count(F.lit(1)).alias("total_buildings"),
        distinct_with_null("building_type").alias("unique_building_types"),
        distinct_with_null("building_category").alias("unique_building_categories"),
        F.count("addr_street").alias("buildings_with_addresses"),
        F.round(F.avg("height"), 2).alias("avg_height_meters"),
        F.round(F.avg("levels"), 2).alias("avg_levels"),
        F.count("construction_year").alias("buildings_with_age_data"),
        F.round(F.avg("estimated_age_years"), 2).alias("avg_age_years"),
        F.count("architectural_style").alias("buildings_with_style_data"),
    )


def category_breakdown(buildings: DataFrame) -> DataFrame:
    counts = buildings.groupBy("building_category").agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "building_category")


def match_summary(matches: DataFrame) -> DataFrame:
    """Distance profile of nearest matches; the median is exact.

    The matches are written out once, as several passes read them.
    """
    matches = written(matches.select("building_type", "distance_meters"), "matches")
    d = F.col("distance_meters")
    plain = matches.agg(
        F.count(F.lit(1)).alias("total_matches"),
        F.avg(d).alias("avg_distance_meters"), F.min(d).alias("min_distance_meters"),
        F.max(d).alias("max_distance_meters"), distinct_with_null("building_type").alias("unique_building_types"),
    )
    median = exact_quantiles(matches, ["distance_meters"], [0.5]).select(F.col("value").alias("v"))
    return plain.withColumn("median_distance_meters", median.scalar())


def match_types_top(matches: DataFrame, n: int = 10) -> DataFrame:
    counts = matches.groupBy("building_type").agg(F.count(F.lit(1)).alias("business_count"))
    named = counts.withColumn("building_type", F.coalesce("building_type", F.lit("Unknown")))
    return top_rows(named, n, F.desc("business_count"), F.col("building_type"))


def density_distribution(profiles: DataFrame, count: str = "business_count") -> DataFrame:
    return profiles.groupBy("density_category").agg(
        F.count(F.lit(1)).alias("groups"), F.avg(count).alias("avg_count"), F.max(count).alias("max_count")
    )


def coverage_stats(
    businesses: DataFrame, buildings: DataFrame, centred: DataFrame, pairs: DataFrame,
    by_building: DataFrame, radius: float = 0.0005, weight: str | None = None,
) -> DataFrame:
    """One row of totals over the stages of the building profile; ``pairs`` may be folded with a ``weight`` (pairs of businesses and buildings a row stands for)."""
    rows = F.count(F.lit(1))
    folded = F.lit(1) if weight is None else F.col(weight)
    metres = F.lit(M.METRES_PER_DEGREE)
    # each side is one row
    parts = [
        businesses.agg(rows.alias("businesses_loaded")),
        buildings.agg(rows.alias("buildings_loaded")),
        centred.agg(rows.alias("buildings_with_centroids")),
        pairs.agg(
            F.coalesce(F.sum(folded), F.lit(0)).cast("long").alias("spatial_associations"),
            distinct_with_null("naics_code").alias("total_unique_business_types"),
            F.round(F.sum(F.col("distance_degrees") * folded) / F.sum(folded) * metres, 1).alias("avg_association_distance_meters"),
            F.round(F.max("distance_degrees") * metres, 1).alias("max_association_distance_meters"),
        ),
        by_building.agg(
            rows.alias("buildings_with_businesses"),
            F.round(F.avg("business_count"), 2).alias("avg_businesses_per_building"),
            F.max("business_count").alias("max_businesses_per_building"),
            F.count_if("mixed_use").alias("mixed_use_buildings"),
        ),
    ]
    out = one_row(*parts)
    return out.withColumns({
        "centroid_success_rate": F.round(F.col("buildings_with_centroids") / F.col("buildings_loaded") * 100, 2),
        "coverage_rate": F.round(
            F.col("buildings_with_businesses") / F.nullif(F.col("buildings_with_centroids"), F.lit(0)) * 100, 2
        ),
        "proximity_radius_meters": F.lit(round(radius * M.METRES_PER_DEGREE, 1)),
    })


def one_row(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Put one-row frames side by side, the others as scalar subqueries."""
    packed = [p.select(F.struct(*p.columns).alias("s")).scalar().alias(f"_p{i}") for i, p in enumerate(others)]
    return first.select("*", *packed).select(*first.columns, *[f"_p{i}.*" for i in range(len(others))])


def processing_stats(businesses: DataFrame, buildings: DataFrame, matches: DataFrame) -> DataFrame:
    rows = F.count(F.lit(1))
    out = one_row(
        businesses.agg(
            rows.alias("total_records"),
            distinct_with_null("naics_code").alias("unique_naics_codes"),
            distinct_with_null("neighborhood").alias("unique_neighborhoods"),
            F.min("business_start_date").alias("earliest_start"), F.max("business_start_date").alias("latest_start"),
            F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
            F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
        ),
        buildings.agg(rows.alias("total_buildings"), distinct_with_null("building_type").alias("building_types")),
        matches.agg(rows.alias("total_matches"), F.avg("distance_meters").alias("avg_distance")),
    )
    return out.withColumn("match_rate", F.col("total_matches") / F.greatest(F.col("total_records"), F.lit(1)))


def column_profile(df: DataFrame) -> DataFrame:
    """Per column: data type and number of nulls, in one pass."""
    fields = df.schema.fields
    counts = df.agg(*[F.count_if(F.col(f.name).isNull()).alias(f"c{i}") for i, f in enumerate(fields)])
    entries = F.array(*[
        F.struct(
            F.lit(i + 1).alias("position"), F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f"c{i}").alias("null_count"),
        )
        for i, f in enumerate(fields)
    ])
    return counts.select(F.inline(entries))


def description_sample(df: DataFrame, n: int, column: str = "naics_description") -> DataFrame:
    """The first ``n`` distinct values of a column."""
    return top_rows(df.where(F.col(column).isNotNull()).select(column).distinct(), n, F.col(column))


def per_group_cap(df: DataFrame, group: str, n: Column | int, *order: Column) -> DataFrame:
    """First rows of every group by a total order; tasks cut to the cap before the shuffle."""
    window = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n).drop("_rank")
