"""Polygon text as Spark SQL expressions: no UDF, no geometry library.

Polygons with holes and multipolygons are read as lists of rings; bad text and
shapes of zero area give null. The parsed value is handed on through a
generator (``inline``), which the optimizer does not merge with the
projections above it, so each text is parsed once per row however many
columns and filters use the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBERS = r"[0-9eE.,+\-\s]+"
_POLYGON_TEXT = rf"^\s*(?:POLYGON\s*\((?:\s*\({_NUMBERS}\)\s*,?)+\)|MULTIPOLYGON\s*\((?:\s*\((?:\s*\({_NUMBERS}\)\s*,?)+\)\s*,?)+\))\s*$"
_RING_TEXT = r"(\(?)\s*\(([^()]+)\)"  # an outer ring comes right after another bracket, a hole after a comma


def once(df: DataFrame, **values: Column) -> DataFrame:
    """Append columns that are computed exactly once per row."""
    packed = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select("*", F.inline(F.array(packed)).alias(*values))


def polygon_rings(wkt: Column) -> Column:
    """Rings of a polygon or multipolygon text as ``array<struct<hole,points:array<struct<x,y>>>>``; null for other text."""

    def vertex(part: Column) -> Column:
        part = F.trim(part)
        return F.struct(
            F.substring_index(part, " ", 1).try_cast("double").alias("x"),
            F.substring_index(part, " ", -1).try_cast("double").alias("y"),
        )

    opened, bodies = (F.regexp_extract_all(wkt, F.lit(_RING_TEXT), F.lit(i)) for i in (1, 2))
    rings = F.zip_with(opened, bodies, lambda o, body: F.struct((o == "").alias("hole"), F.transform(F.split(body, ","), vertex).alias("points")))
    return F.when(wkt.rlike(_POLYGON_TEXT), rings)


def ring_points(wkt: Column) -> Column:
    """Vertices of the first ring."""
    return F.get(polygon_rings(wkt), F.lit(0))["points"]


def rings_centroid(rings: Column, digits: int = 7) -> Column:
    """Area centroid ``struct<lon,lat>``; null for an empty or zero-area shape.

    Outer rings count with their area and holes against it, whichever way they
    run. Moments are taken relative to the first vertex, which keeps the small
    differences exact enough for city-sized polygons.
    """
    origin = F.get(F.get(rings, F.lit(0))["points"], F.lit(0))
    x0, y0, zero = origin["x"], origin["y"], F.lit(0.0)
    start = F.struct(F.lit(None).cast("double").alias("px"), F.lit(None).cast("double").alias("py"), zero.alias("area2"), zero.alias("mx"), zero.alias("my"))

    def step(acc: Column, v: Column) -> Column:
        dx, dy = v["x"] - x0, v["y"] - y0
        cross = F.when(acc["px"].isNull(), zero).otherwise(acc["px"] * dy - dx * acc["py"])
        return F.struct(
            dx.alias("px"), dy.alias("py"), (acc["area2"] + cross).alias("area2"),
            (acc["mx"] + (F.coalesce(acc["px"], zero) + dx) * cross).alias("mx"), (acc["my"] + (F.coalesce(acc["py"], zero) + dy) * cross).alias("my"),
        )

    def moments(ring: Column) -> Column:
        return F.struct(ring["hole"].alias("hole"), F.aggregate(ring["points"], start, step).alias("m"))

    def add(acc: Column, ring: Column) -> Column:
        m, sign = ring["m"], F.signum(ring["m"]["area2"]) * F.when(ring["hole"], -1.0).otherwise(1.0)
        return F.struct(*[(acc[k] + sign * m[k]).alias(k) for k in ("area2", "mx", "my")])

    def finish(acc: Column) -> Column:
        scale = F.lit(3.0) * acc["area2"]
        return F.when(
            acc["area2"] != 0.0,
            F.struct(F.round(x0 + acc["mx"] / scale, digits).alias("lon"), F.round(y0 + acc["my"] / scale, digits).alias("lat")),
        )

    return F.aggregate(F.transform(rings, moments), F.struct(zero.alias("area2"), zero.alias("mx"), zero.alias("my")), add, finish)


def with_centroid(
    df: DataFrame,
    wkt: str = "geom_wkt",
    lon: str = "center_lon",
    lat: str = "center_lat",
    digits: int = 7,
    keep_all: bool = False,
) -> DataFrame:
    """Append the centroid; rows without one are dropped unless ``keep_all``."""
    parsed = once(df, _rings=polygon_rings(F.col(wkt)))
    centre = once(parsed, _centre=rings_centroid(F.col("_rings"), digits))
    out = centre.select(*df.columns, F.col("_centre.lon").alias(lon), F.col("_centre.lat").alias(lat))
    return out if keep_all else out.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())


def all_points(rings: Column) -> Column:
    return F.flatten(F.transform(rings, lambda r: r["points"]))


def with_vertex_mean(
    df: DataFrame, wkt: str = "geom_wkt", lon: str = "mean_lon", lat: str = "mean_lat", digits: int = 7
) -> DataFrame:
    """Append the plain mean of all vertices of all rings, the closing ones included."""

    def mean(axis: str) -> Column:
        total = F.aggregate(F.col("_points"), F.lit(0.0), lambda acc, v: acc + v[axis])
        return F.round(total / F.size("_points"), digits)

    pointed = once(df, _points=all_points(polygon_rings(F.col(wkt)))).where(F.col("_points").isNotNull())
    return pointed.select(*df.columns, mean("x").alias(lon), mean("y").alias(lat))


def with_first_vertex(
    df: DataFrame, wkt: str = "geom_wkt", lon: str = "first_lon", lat: str = "first_lat"
) -> DataFrame:
    """Append the first vertex as a quick position; text without one is dropped."""
    head = r"^\s*(?:MULTI)?POLYGON\s*\(+\s*([^\s,()]+)\s+([^\s,()]+)"
    out = df.select(
        "*",
        F.nullif(F.regexp_extract(wkt, head, 1), F.lit("")).try_cast("double").alias(lon),
        F.nullif(F.regexp_extract(wkt, head, 2), F.lit("")).try_cast("double").alias(lat),
    )
    return out.where(F.col(lon).isNotNull() & F.col(lat).isNotNull())


def polygon_wkt(points: Column) -> Column:
    """``array<struct<lon,lat>>`` to polygon text; the ring is closed if open.

    Fewer than four points make no polygon: null.
    """
    first, last = points[0], F.element_at(points, -1)
    same = (first["lon"] == last["lon"]) & (first["lat"] == last["lat"])
    closed = F.when(same, points).otherwise(F.concat(points, F.array(first)))
    pairs = F.transform(closed, lambda p: F.concat_ws(" ", p["lon"].cast("string"), p["lat"].cast("string")))
    text = F.concat(F.lit("POLYGON (("), F.array_join(pairs, ", "), F.lit("))"))
    return F.when(F.size(points) >= 4, text)


def bounding_box(points: Column) -> dict[str, Column]:
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {
        "min_x": F.array_min(xs), "max_x": F.array_max(xs),
        "min_y": F.array_min(ys), "max_y": F.array_max(ys),
    }


def rings_contain(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd test of a point against closed rings (half-open edges); a hole's edges count like any other."""

    def crossings(ring: Column) -> Column:
        points = ring["points"]

        def crossing(i: Column) -> Column:
            a, b = points[i - 1], points[i]
            spans = (a["y"] > y) != (b["y"] > y)
            at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
            return F.when(spans, F.when(x < at, 1).otherwise(0)).otherwise(0)

        edges = F.sequence(F.lit(1), F.size(points) - 1)
        return F.aggregate(F.transform(edges, crossing), F.lit(0), lambda acc, c: acc + c)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda acc, c: acc + c) % 2 == 1
