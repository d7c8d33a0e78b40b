"""Distances, grid and hexagon cells, density bands and scores."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_000.0
SF_BOX = (-122.6, 37.7, -122.3, 37.9)
GRID_LEVELS = (0.01, 0.001, 0.0001)

# Fixed values: (least count, label), highest first; the last label is for the rest.
BUILDING_BANDS = ((10, "very_high"), (5, "high"), (2, "medium"), (1, "low"), (None, "none"))
SLIM_BUILDING_BANDS = ((10, "very_high"), (5, "high"), (2, "medium"), (None, "low"))
FULL_BUILDING_BANDS = ((20, "very_high"), (10, "high"), (5, "medium"), (2, "low"), (None, "minimal"))
GRID_BANDS = ((50, "very_high"), (25, "high"), (10, "medium"), (1, "low"), (None, "none"))
SLIM_GRID_BANDS = ((50, "very_high"), (20, "high"), (5, "medium"), (None, "low"))
FULL_GRID_BANDS = ((100, "very_high"), (50, "high"), (20, "medium"), (5, "low"), (None, "minimal"))
BUSINESS_GRID_BANDS = ((20, "very_high"), (10, "high"), (5, "medium"), (1, "low"), (None, "none"))

# Colour class -> red, green, blue, alpha.
CLASS_COLOURS = (
    (255, 237, 160, 200),
    (254, 178, 76, 200),
    (252, 78, 42, 200),
    (227, 26, 28, 200),
    (177, 0, 38, 200),
    (128, 0, 38, 200),
    (102, 166, 30, 200),
    (35, 139, 69, 200),
    (0, 109, 119, 200),
    (65, 105, 225, 200),
)

# Coordinates are summed as whole ten-millionths of a degree (about 1 cm), so a
# mean does not depend on the order in which partitions are merged.
COORDINATE_SCALE = 10_000_000


def moment(now: dt.datetime) -> Column:
    """A wall-clock literal that does not shift with the session time zone."""
    return F.to_timestamp_ntz(F.lit(now.isoformat(sep=" ")), F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]"))


def fixed_point(coordinate: Column) -> Column:
    return F.round(coordinate * F.lit(float(COORDINATE_SCALE))).cast("bigint")


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    s1 = F.sin(F.radians(lat2 - lat1) / 2)
    s2 = F.sin(F.radians(lon2 - lon1) / 2)
    a = s1 * s1 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s2 * s2
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.when(a > 1, F.lit(1.0)).otherwise(a)))


def planar_degrees(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    dx, dy = lon1 - lon2, lat1 - lat2
    return F.sqrt(dx * dx + dy * dy)


def in_box(lon: Column, lat: Column, box: Sequence[float] | None) -> Column:
    """Closed box test; no box lets every row pass."""
    if box is None:
        return F.lit(True)
    min_lon, min_lat, max_lon, max_lat = (float(v) for v in box)
    return lon.between(min_lon, max_lon) & lat.between(min_lat, max_lat)


def floor_cell(coordinate: Column, size: float | Column) -> Column:
    size = F.lit(float(size)) if not isinstance(size, Column) else size
    return F.floor(coordinate / size).cast("bigint")


def round_cell(coordinate: Column, size: float | Column) -> Column:
    """Nearest cell index, halves to even."""
    size = F.lit(float(size)) if not isinstance(size, Column) else size
    return F.rint(coordinate / size).cast("bigint")


def hex_size(zoom: int) -> float:
    return 0.1 / 2 ** (zoom - 1)


def cluster_size(zoom: int) -> float:
    return 0.001 * (15 - zoom) / 10


def on_demand_grid_size(zoom: int) -> float:
    return 0.001 * (15 - zoom)


def hex_q(lon: Column, lat: Column, size: Column) -> Column:
    """Axis-wise rounded axial coordinate (not exact hexagon rounding)."""
    x, y = lon / size, lat / size
    return F.rint(F.lit(math.sqrt(3) / 3) * x - F.lit(1 / 3) * y).cast("bigint")


def hex_r(lat: Column, size: Column) -> Column:
    return F.rint(F.lit(2 / 3) * (lat / size)).cast("bigint")


def true_hex(lon: Column, lat: Column, size: float | Column) -> Column:
    """Axial coordinates ``struct<q,r>`` of the hexagon (pointy top, side ``size``) whose centre is nearest.

    All three cube axes are rounded, and the one moved most follows from the others.
    """
    size = F.lit(float(size)) if not isinstance(size, Column) else size
    x, y = lon / size, lat / size
    q, r = F.lit(math.sqrt(3) / 3) * x - y / 3, y * 2 / 3
    s = -q - r
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    follows_q, follows_r = (dq > dr) & (dq > ds), dr > ds
    return F.struct(
        F.when(follows_q, -rr - rs).otherwise(rq).cast("bigint").alias("q"),
        F.when(~follows_q & follows_r, -rq - rs).otherwise(rr).cast("bigint").alias("r"),
    )


def true_hex_center(q: Column, r: Column, size: float | Column) -> tuple[Column, Column]:
    """Longitude and latitude of a hexagon's centre."""
    size = F.lit(float(size)) if not isinstance(size, Column) else size
    return size * F.lit(math.sqrt(3)) * (q + r / 2), size * 3 * r / 2


def hex_ring(q: Column, r: Column, distance: int = 1) -> Column:
    """The ``6 * distance`` hexagons that many steps away, as ``array<struct<q,r>>``."""
    around, at = [], (-distance, distance)
    for dq, dr in ((1, 0), (1, -1), (0, -1), (-1, 0), (-1, 1), (0, 1)):
        for _ in range(distance):
            around.append(F.struct((q + at[0]).alias("q"), (r + at[1]).alias("r")))
            at = (at[0] + dq, at[1] + dr)
    return F.array(*around)


def true_hex_parent(q: Column, r: Column, size: float | Column, parent_size: float | Column) -> Column:
    """The coarser hexagon that holds a hexagon's centre; hexagons don't nest, but every one has one parent."""
    return true_hex(*true_hex_center(q, r, size), parent_size)


def hex_center_lon(q: Column, size: Column) -> Column:
    return q * size * F.lit(math.sqrt(3))


def hex_center_lat(r: Column, size: Column) -> Column:
    return r * size * F.lit(3.0) / F.lit(2.0)


def band(count: Column, bands: Sequence[tuple[int | None, str]]) -> Column:
    """Label of the first band whose threshold the count reaches."""
    *steps, (_, rest) = bands
    chain = F
    for least, label in steps:
        chain = chain.when(count >= least, F.lit(label))
    return chain.otherwise(F.lit(rest))


def clip_score(value: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), value)).cast("bigint")


def intensity(count: Column, per_business: int, diversity: Column | None = None, per_kind: int = 0) -> Column:
    value = count * per_business
    return clip_score(value if diversity is None else value + diversity * per_kind)


def mixed_use(diversity: Column) -> Column:
    return diversity >= 3


def proximity_quality(avg_distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + avg_distance * 1000)


def code_class(code: Column, classes: int = 10) -> Column:
    """Stable class 0..classes-1 of a code, from the head of its md5; null stays null."""
    head = F.conv(F.substring(F.md5(code), 1, 8), 16, 10).cast("bigint")
    return F.pmod(head, F.lit(classes))


def age_proxy(start: Column, reference_year: int = 2024, missing: int = 5) -> Column:
    return F.coalesce(F.lit(reference_year) - F.year(start), F.lit(missing))


def point_size(age: Column) -> Column:
    return F.when(age <= 5, 4).when(age <= 10, 3).otherwise(2)


def class_colour(code_cls: Column) -> Column:
    """RGBA array of a class; a null class takes the last colour."""
    last = len(CLASS_COLOURS) - 1
    table = F.array(*[F.array(*[F.lit(float(v)) for v in rgba]) for rgba in CLASS_COLOURS])
    return table[F.coalesce(code_cls, F.lit(last)).cast("int")]


def stand_in_count(osm_id: Column, category: Column) -> Column:
    """Placeholder business count of a building, from its id and category only."""
    return (
        F.when(category == "commercial", osm_id % 15 + 5)
        .when(category == "residential", osm_id % 8 + 1)
        .otherwise(osm_id % 3)
        .cast("int")
    )


def category_intensity(category: Column) -> Column:
    return F.when(category == "commercial", "high").when(category == "residential", "medium").otherwise("low")
