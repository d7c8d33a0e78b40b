"""Zoom levels: hexagons at 1-8, statistical clusters at 9-12, buildings above; point samples."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import measures as M
from ..session import written
from .aggregates import centre_sums, per_group_cap, with_mean_position
from .rollup import facet_rollup, top_rows

# Fixed values: (first zoom, last zoom, kilobytes per feature).
HEX_ZOOMS = (1, 8, 0.05)
CLUSTER_ZOOMS = (9, 12, 0.5)
BUILDING_ZOOMS = (13, 18, 0.02)


def _located(businesses: DataFrame, box: Sequence[float] | None) -> DataFrame:
    lon, lat = F.col("longitude"), F.col("latitude")
    return businesses.where(lon.isNotNull() & lat.isNotNull() & M.in_box(lon, lat, box))


def _weighted(businesses: DataFrame, box: Sequence[float] | None, levels: int) -> DataFrame:
    """Located rows with a weight, folded by position and kind if several levels need them.

    Registrations share address points: after folding, a row is repeated per
    zoom level only once per address and kind. One level alone is served by
    map-side combining as it is.
    """
    located = _located(businesses, box)
    if levels == 1:
        start = F.col("business_start_date")
        return located.select(
            "longitude", "latitude", "naics_code", "naics_description", F.lit(1).alias("weight"), "unique_id",
            start.alias("first_start"), start.alias("last_start"),
        )
    return located.groupBy("longitude", "latitude", "naics_code", "naics_description").agg(
        F.count(F.lit(1)).alias("weight"), F.min("unique_id").alias("unique_id"),
        F.min("business_start_date").alias("first_start"), F.max("business_start_date").alias("last_start"),
    )


def _per_zoom(
    businesses: DataFrame, box: Sequence[float] | None, sizes: dict[int, float], size: str
) -> DataFrame:
    levels = F.array(*[F.struct(F.lit(z).alias("zoom_level"), F.lit(s).alias(size)) for z, s in sizes.items()])
    return _weighted(businesses, box, len(sizes)).select("*", F.inline(levels))


def hex_cells(businesses: DataFrame, zooms: Iterable[int], box: Sequence[float] | None = None) -> DataFrame:
    """Count, kinds, first type, hexagon centre and mean point per (zoom, q, r)."""
    sized = _per_zoom(businesses, box, {z: M.hex_size(z) for z in zooms}, "hex_size")
    celled = sized.withColumns({
        "hex_q": M.hex_q(F.col("longitude"), F.col("latitude"), F.col("hex_size")),
        "hex_r": M.hex_r(F.col("latitude"), F.col("hex_size")),
    })
    weight = F.col("weight")
    out = facet_rollup(
        celled, ["zoom_level", "hex_size", "hex_q", "hex_r"], "business_count",
        distinct={"business_types": "naics_code"},
        firsts={"primary_naics": "naics_description"}, first_by="unique_id",
        sums=centre_sums("longitude", "latitude", weight), weight=weight,
    )
    return with_mean_position(out, "business_count", "avg_lon", "avg_lat").withColumns({
        "center_lon": M.hex_center_lon(F.col("hex_q"), F.col("hex_size")),
        "center_lat": M.hex_center_lat(F.col("hex_r"), F.col("hex_size")),
    })


def hex_aggregate(
    businesses: DataFrame, zoom: int, box: Sequence[float] | None = None, top: int | None = None
) -> DataFrame:
    """The hexagons of one zoom level; with ``top`` only that many of the largest."""
    cells = hex_cells(businesses, [zoom], box)
    return cells if top is None else top_rows(cells, top, F.desc("business_count"), F.col("hex_q"), F.col("hex_r"))


def true_hexagons(businesses: DataFrame, zoom: int, box: Sequence[float] | None = None) -> DataFrame:
    """Businesses per true hexagon of a zoom level, with its centre, its parent and what its six neighbours hold.

    Beside :func:`hex_cells`, whose ids round two axes on their own. Cells are
    counted first; neighbours are found by an equality join of counted cells.
    """
    size, coarser = M.hex_size(zoom), M.hex_size(max(zoom - 1, HEX_ZOOMS[0]))
    cell = M.true_hex(F.col("longitude"), F.col("latitude"), size)
    counted = written(_located(businesses, box).groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("business_count")).select(
        F.col("cell.q").alias("hex_q"), F.col("cell.r").alias("hex_r"), "business_count",
    ), "hexagons")
    around = counted.select(F.inline(M.hex_ring(F.col("hex_q"), F.col("hex_r"))), "business_count").groupBy(F.col("q").alias("hex_q"), F.col("r").alias("hex_r")).agg(
        F.sum("business_count").alias("neighbour_count"), F.count(F.lit(1)).alias("neighbours")
    )
    q, r = F.col("hex_q"), F.col("hex_r")
    lon, lat = M.true_hex_center(q, r, size)
    parent = M.true_hex_parent(q, r, size, coarser)
    return counted.join(around, ["hex_q", "hex_r"], "left").select(
        F.lit(zoom).alias("zoom_level"), "hex_q", "hex_r", lon.alias("center_lon"), lat.alias("center_lat"), "business_count",
        F.coalesce("neighbour_count", F.lit(0)).alias("neighbour_count"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"),
        parent["q"].alias("parent_q"), parent["r"].alias("parent_r"),
    )


def cluster_cells(businesses: DataFrame, zooms: Iterable[int], box: Sequence[float] | None = None) -> DataFrame:
    """Count, kinds, spread and period per (zoom, rounded cell)."""
    sized = _per_zoom(businesses, box, {z: M.cluster_size(z) for z in zooms}, "grid_size")
    celled = sized.withColumns({
        "grid_x": M.round_cell(F.col("longitude"), F.col("grid_size")),
        "grid_y": M.round_cell(F.col("latitude"), F.col("grid_size")),
    })
    # Offsets from the cell centre in ten-millionths of a degree: small whole
    # numbers, so sums of squares stay exact for any group size.
    offset = {
        axis: M.fixed_point(F.col(c)) - M.fixed_point(F.col(g) * F.col("grid_size"))
        for axis, c, g in (("lon", "longitude", "grid_x"), ("lat", "latitude", "grid_y"))
    }
    weight = F.col("weight")
    out = facet_rollup(
        celled, ["zoom_level", "grid_size", "grid_x", "grid_y"], "business_count",
        distinct={"business_types": "naics_code"},
        modes={"dominant_naics": "naics_code"},
        firsts={"primary_naics": "naics_description"}, first_by="unique_id",
        sums={
            **centre_sums("longitude", "latitude", weight),
            **{f"_o_{axis}": o * weight for axis, o in offset.items()},
            **{f"_q_{axis}": o * o * weight for axis, o in offset.items()},
        },
        mins={"oldest_business": F.col("first_start")},
        maxs={"newest_business": F.col("last_start")},
        weight=weight,
    )
    n = F.col("business_count").cast("double")

    def deviation(axis: str) -> Column:
        total, squares = F.col(f"_o_{axis}").cast("double"), F.col(f"_q_{axis}").cast("double")
        variance = (squares - total * total / n) / (n - 1)
        return F.when(n > 1, F.sqrt(F.greatest(variance, F.lit(0.0))) / F.lit(float(M.COORDINATE_SCALE)))

    spread = out.withColumns({"lon_std": deviation("lon"), "lat_std": deviation("lat")})
    spread = spread.withColumn(
        "spatial_variance", F.coalesce("lon_std", F.lit(0.0)) + F.coalesce("lat_std", F.lit(0.0))
    )
    return with_mean_position(spread, "business_count").drop("_o_lon", "_o_lat", "_q_lon", "_q_lat")


def cluster_aggregate(
    businesses: DataFrame, zoom: int, box: Sequence[float] | None = None, top: int | None = None
) -> DataFrame:
    """The clusters of one zoom level; with ``top`` only that many of the largest."""
    cells = cluster_cells(businesses, [zoom], box)
    return cells if top is None else top_rows(cells, top, F.desc("business_count"), F.col("grid_x"), F.col("grid_y"))


def grid_on_demand(businesses: DataFrame, zoom: int = 12, box: Sequence[float] | None = None) -> DataFrame:
    """Rounded cells whose size follows the zoom level, uncapped."""
    size = M.on_demand_grid_size(zoom)
    celled = _located(businesses, box).withColumns({
        "grid_x": M.round_cell(F.col("longitude"), size), "grid_y": M.round_cell(F.col("latitude"), size),
    })
    out = facet_rollup(
        celled, ["grid_x", "grid_y"], "business_count",
        distinct={"business_types": "naics_code"},
        firsts={"primary_type": "naics_description"}, first_by="unique_id",
        sums=centre_sums("longitude", "latitude"),
    )
    return with_mean_position(out, "business_count")


_LEVEL_COLUMNS = (
    "zoom_level", "aggregation_type", "cell_size", "cell_x", "cell_y", "business_count", "business_types",
    "primary_naics", "center_lon", "center_lat", "dominant_naics", "spatial_variance",
    "oldest_business", "newest_business",
)


def zoom_pyramid(
    businesses: DataFrame, zooms: Iterable[int] = range(1, 13), box: Sequence[float] | None = None,
    top: int | None = None,
) -> DataFrame:
    """All aggregated levels in one frame keyed by ``zoom_level``; with ``top`` the largest cells of each level only.

    Each family of levels is one aggregation over (zoom, cell).
    """
    zooms = list(zooms)
    hexes = [z for z in zooms if HEX_ZOOMS[0] <= z <= HEX_ZOOMS[1]]
    clusters = [z for z in zooms if CLUSTER_ZOOMS[0] <= z <= CLUSTER_ZOOMS[1]]
    parts = []
    if hexes:
        parts.append(hex_cells(businesses, hexes, box).select(
            "zoom_level", F.lit("hexagonal").alias("aggregation_type"), F.col("hex_size").alias("cell_size"),
            F.col("hex_q").alias("cell_x"), F.col("hex_r").alias("cell_y"), "business_count", "business_types",
            "primary_naics", F.col("avg_lon").alias("center_lon"), F.col("avg_lat").alias("center_lat"),
            F.lit(None).cast("string").alias("dominant_naics"), F.lit(None).cast("double").alias("spatial_variance"),
            F.lit(None).cast("timestamp").alias("oldest_business"),
            F.lit(None).cast("timestamp").alias("newest_business"),
        ))
    if clusters:
        parts.append(cluster_cells(businesses, clusters, box).withColumn(
            "aggregation_type", F.lit("statistical")
        ).withColumnsRenamed({"grid_size": "cell_size", "grid_x": "cell_x", "grid_y": "cell_y"}).select(*_LEVEL_COLUMNS))
    if not parts:
        raise ValueError("zoom levels 1 to 12 are aggregated; features_at serves buildings above")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    if top is None:
        return out
    return per_group_cap(out, "zoom_level", top, F.desc("business_count"), F.col("cell_x"), F.col("cell_y"))


def features_at(
    levels: DataFrame, buildings: DataFrame, zoom: int, box: Sequence[float] | None = None, top: int | None = None
) -> DataFrame:
    """What a map shows at one zoom level: hexagons up to 8, clusters up to 12, buildings up to 18.

    ``levels`` is a stored pyramid, whose partition of the level is the only one
    read; ``buildings`` has osm_id, center_lon, center_lat and business_count.
    """
    if not HEX_ZOOMS[0] <= zoom <= BUILDING_ZOOMS[1]:
        raise ValueError(f"zoom levels are {HEX_ZOOMS[0]} to {BUILDING_ZOOMS[1]}")
    if zoom <= CLUSTER_ZOOMS[1]:
        kind = "hexagonal" if zoom <= HEX_ZOOMS[1] else "statistical"
        found = levels.where(F.col("zoom_level") == zoom).select(
            F.lit(kind).alias("feature_type"), F.concat_ws(":", "cell_x", "cell_y").alias("feature_id"), "center_lon", "center_lat", "business_count"
        )
    else:
        found = buildings.select(
            F.lit("building").alias("feature_type"), F.col("osm_id").cast("string").alias("feature_id"), "center_lon", "center_lat", "business_count"
        )
    found = found.where(M.in_box(F.col("center_lon"), F.col("center_lat"), box)).withColumn("zoom_level", F.lit(zoom))
    return found if top is None else top_rows(found, top, F.desc("business_count"), F.col("feature_id"))


def pyramid_summary(levels: DataFrame) -> DataFrame:
    """Features and estimated size per zoom level."""
    per_feature = F.when(F.col("zoom_level") <= HEX_ZOOMS[1], HEX_ZOOMS[2]).otherwise(CLUSTER_ZOOMS[2])
    return (
        levels.groupBy("zoom_level", "aggregation_type")
        .agg(F.count(F.lit(1)).alias("features"), F.sum("business_count").alias("businesses"))
        .withColumn("size_kb", F.round(F.col("features") * per_feature, 4))
    )


def sample_points(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows in a repeatable pseudo-random choice, with ``total_available``.

    Rows are ordered by a digest of (key, seed). Two counts of its leading
    digits, of 65,536 steps each, find where the sample is full; then the table
    is read once more for the rows before that point, and of the rows in the
    last step, one in four billion of the table, the first ones fill the sample.
    """
    keyed = df.withColumn("_digest", F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))))
    narrow, prefix, before, total = keyed.select("_digest"), "", 0, None
    for _ in range(2):
        step = F.substring("_digest", len(prefix) + 1, 4)
        counts = narrow.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy("step").collect()  # at most 65 536 rows
        total = sum(r["n"] for r in counts) if total is None else total
        for r in counts:
            if before + r["n"] >= n:
                prefix += r["step"]
                break
            before += r["n"]
        else:  # fewer rows than asked for
            return df.withColumn("total_available", F.lit(total).cast("bigint"))
        narrow = narrow.where(F.col("_digest").startswith(prefix))
    rows = keyed.where(F.substring("_digest", 1, len(prefix)) <= prefix)
    whole = rows.where(~F.col("_digest").startswith(prefix))
    edge = top_rows(rows.where(F.col("_digest").startswith(prefix)), n - before, F.col("_digest"), F.col(key))
    return whole.unionByName(edge).drop("_digest").withColumn("total_available", F.lit(total).cast("bigint"))


def pack_points(businesses: DataFrame, reference_year: int = 2024) -> DataFrame:
    """``[lon, lat, size, r, g, b, a]`` per business, kept with its id."""
    age = M.age_proxy(F.col("business_start_date"), reference_year)
    colour = M.class_colour(M.code_class(F.col("naics_code")))
    head = F.array(F.col("longitude"), F.col("latitude"), M.point_size(age).cast("double"))
    return businesses.select("unique_id", F.concat(head, colour).alias("point"))


def map_points(
    businesses: DataFrame, box: Sequence[float] | None, max_points: int, seed: int = 42
) -> DataFrame:
    """Packed points of a box, at most ``max_points`` of them."""
    return pack_points(sample_points(_located(businesses, box), max_points, "unique_id", seed))
