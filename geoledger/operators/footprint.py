"""Points in polygons, and polygon simplification."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import once, polygon_rings
from ..session import written
from .cover import cell_width, covers, polygon_cover
from .near import HOT_ROWS, cell_join

def point_in_polygon_join(
    points: DataFrame,
    footprints: DataFrame,
    lon: str = "longitude",
    lat: str = "latitude",
    wkt: str = "geom_wkt",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Pairs of a point and a footprint that contains it.

    Footprints become cells (:mod:`.cover`): in a cell wholly inside, every
    point is a pair without a test; in one on the rim, a point meets only the
    edges that cross the cell. No row of the join holds more than that, however
    long an outline is. A point is looked up on the levels in use, at most one
    for each STEP levels from BOTTOM_LEVEL to TOP_LEVEL. Points that share a
    position, and footprints that share an outline, are tested as one.
    """
    x, y = F.col(lon), F.col(lat)
    located = points.where(x.isNotNull() & y.isNotNull())
    # equal outlines and equal positions are tested once; the name of an outline is written, so it stays the same
    outlines = written(footprints.select(wkt).where(F.col(wkt).isNotNull()).distinct().withColumn("_outline", F.monotonically_increasing_id()), "outlines")
    places = written(located.select(lon, lat).distinct(), "places")
    # written out, as it is read for the levels, for the hot cells and for the join
    cells = written(polygon_cover(outlines, wkt), "cover")
    levels = cells.agg(F.collect_set("_lv").alias("l")).scalar()
    leveled = places.withColumn("_lv", F.explode(levels)).withColumns({
        "_cx": F.floor(x / cell_width(F.col("_lv"))).cast("bigint"), "_cy": F.floor(y / cell_width(F.col("_lv"))).cast("bigint"),
    })
    hits = written(cell_join(leveled, cells, ["_lv", "_cy", "_cx"], covers(x, y), hot_rows).select(lon, lat, "_outline"), "hits")
    # rows come back to the hits by equality; written, so the sizes are known for both joins
    met = written(footprints.join(outlines.join(hits.select("_outline").distinct(), "_outline", "left_semi"), wkt).drop(wkt), "footprints")
    pairs = located.join(hits, [lon, lat]).join(met, "_outline")
    return pairs.select(*points.columns, *[c for c in footprints.columns if c != wkt])


#: Up to this many points a span is first looked at in plain numbers, as array calls cost more than the sums.
SHORT_SPAN = 16


def _farthest(points: list[list[float]], lo: int, hi: int, tolerance: float) -> int | None:
    """The point of a short span farthest from its chord, ``lo`` if all are within ``tolerance``; None where rounding could decide."""
    (x0, y0), (x1, y1) = points[lo], points[hi]
    cx, cy = x1 - x0, y1 - y0
    square = cx * cx + cy * cy
    worst, best, second, reach = lo, -1.0, -1.0, abs(cx) + abs(cy)
    for i in range(lo + 1, hi):
        dx, dy = points[i][0] - x0, points[i][1] - y0
        reach = max(reach, abs(dx) + abs(dy))
        if square > 0:
            t = min(max((dx * cx + dy * cy) / square, 0.0), 1.0)
            dx, dy = dx - t * cx, dy - t * cy
        gap = math.hypot(dx, dy)
        if gap > best:
            worst, best, second = i, gap, best
        elif gap > second:
            second = gap
    slack = 1e-9 * reach  # far above what rounding moves a gap by
    if not math.isfinite(reach) or square < 1e-200 or abs(best - tolerance) <= slack:
        return None
    if best < tolerance:
        return lo
    return worst if best - second > slack else None


def thin_spans(xy: np.ndarray, keep: np.ndarray, spans: list[tuple[int, int]], tolerance: float) -> None:
    """Mark in ``keep`` what Douglas-Peucker keeps between the two ends of every span."""
    points = None
    while spans:
        lo, hi = spans.pop()
        if hi - lo < 2:
            continue
        if hi - lo <= SHORT_SPAN:
            points = xy.tolist() if points is None else points
            far = _farthest(points, lo, hi, tolerance)
            if far is not None:
                if far > lo:
                    keep[far] = True
                    spans += [(lo, far), (far, hi)]
                continue
        chord, rel = xy[hi] - xy[lo], xy[lo + 1 : hi] - xy[lo]
        length = float(np.hypot(*chord))
        if length > 0:
            t = np.clip(rel @ chord / length**2, 0.0, 1.0)
            gap = np.hypot(*(rel - t[:, None] * chord).T)
        else:
            gap = np.hypot(*rel.T)
        worst = int(np.argmax(gap))
        if gap[worst] > tolerance:
            mid = lo + 1 + worst
            keep[mid] = True
            spans += [(lo, mid), (mid, hi)]


def _kept_vertices(xy: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices Douglas-Peucker keeps of a closed ring, cut at the vertex farthest from the start."""
    if len(xy) < 5:
        return np.ones(len(xy), dtype=bool)
    far = int(np.argmax(np.hypot(*(xy - xy[0]).T)))
    keep = np.zeros(len(xy), dtype=bool)
    keep[[0, far, -1]] = True
    thin_spans(xy, keep, [(0, far), (far, len(xy) - 1)], tolerance)
    return keep if keep.sum() >= 4 else np.ones(len(xy), dtype=bool)


def rings_text(rings: str) -> Column:
    """Polygon or multipolygon text of a column of rings; null where there are none."""

    def text(ring: Column) -> Column:
        pairs = F.transform(ring["points"], lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
        return F.concat(F.when(ring["hole"], ", (").otherwise("), (("), F.array_join(pairs, ", "), F.lit(")"))

    body = F.concat(F.substring(F.array_join(F.transform(rings, text), ""), 4, 2**30), F.lit(")"))  # "((..), (..)), ((..))"
    parts = F.size(F.filter(rings, lambda r: ~r["hole"]))
    return F.when(parts > 1, F.concat(F.lit("MULTIPOLYGON ("), body, F.lit(")"))).when(parts > 0, F.concat(F.lit("POLYGON "), body))


def vertex_count(rings: str) -> Column:
    return F.aggregate(F.transform(rings, lambda r: F.size(r["points"])), F.lit(0), lambda a, n: a + n)


def simplify_footprints(footprints: DataFrame, wkt: str = "geom_wkt", tolerance: float = 1e-5) -> DataFrame:
    """Every row with simplified polygon text and the vertex counts before and after.

    All rings of a polygon or multipolygon are thinned, each for itself; one
    that would keep fewer than four points, and text that is no polygon, stay as
    they are (no counts for the latter). Spark parses the text and writes it
    again; only rings of five points and more go to Python, as flat arrays, and
    come back as the vertices to keep.
    """

    @F.pandas_udf("array<array<boolean>>")
    def kept(xs: pd.Series, ys: pd.Series) -> pd.Series:
        def one(x, y):
            return None if x is None else [_kept_vertices(np.column_stack([a, b]), tolerance) for a, b in zip(x, y)]

        return pd.Series([one(x, y) for x, y in zip(xs, ys)], dtype=object)

    rings = once(footprints, _rings=polygon_rings(F.col(wkt)))
    whole = F.forall("_rings", lambda r: F.forall(r["points"], lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    rings = once(rings, _good=F.when(whole, F.col("_rings")))
    dense = F.exists("_good", lambda r: F.size(r["points"]) >= 5)
    asked = F.when(dense, F.col("_good"))

    def axis(name: str) -> Column:
        return F.transform(asked, lambda r: F.transform(r["points"], lambda p: p[name]))

    thin = once(rings.withColumn("_kept", kept(axis("x"), axis("y"))), _thin=F.zip_with(
        F.col("_good"), F.coalesce("_kept", F.transform("_good", lambda r: F.transform(r["points"], lambda p: F.lit(True)))),
        lambda r, k: F.struct(r["hole"].alias("hole"), F.filter(r["points"], lambda p, i: F.get(k, i)).alias("points")),
    ))

    return thin.select(
        *[c for c in footprints.columns if c != wkt], F.coalesce(rings_text("_thin"), F.col(wkt)).alias(wkt),
        vertex_count("_good").alias("vertices_before"), vertex_count("_thin").alias("vertices_after"),
    )
