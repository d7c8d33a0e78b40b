"""Polygons as cells: wholly inside, or on the rim with only the edges that cross them.

The grid has levels, each cell four by four of the next lower level's. A
polygon of few edges is one rim cell of any size, cut to at most 2 x 2 cells of
the level of its box. A larger one is cut down where many edges meet, so a cell
carries EDGES edges at most (more only below the finest level).

A point is inside a polygon if a ray to its right crosses an odd number of
edges; an edge spans a height if it reaches from at or below it to above it.
In a rim cell only the listed edges can be on either side of a point, and the
number of other edges to its right changes parity only where a listed edge
ends right of the cell. So the parity at the cell's lower right corner, without
the listed edges, and the ends of the listed edges give the same answer as the
whole polygon, by the same arithmetic and for every point of the cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import once, polygon_rings

# Cells of level 0 are BASE_CELL degrees wide; every level doubles the width. Only every STEP-th level is used.
BASE_CELL = 0.0005
STEP = 2
BOTTOM_LEVEL, TOP_LEVEL = -10, 20
EDGES = 64
#: Cells are widened by this share of their width, so a point that a division puts into a cell lies in it.
MARGIN = 1e-6

_CELL = [
    T.StructField("_lv", T.IntegerType()), T.StructField("_cy", T.LongType()), T.StructField("_cx", T.LongType()), T.StructField("_inside", T.BooleanType()),
    T.StructField("_odd", T.IntegerType()), T.StructField("_right", T.DoubleType()), T.StructField("_bottom", T.DoubleType()),
    T.StructField("_edges", T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("ax", "ay", "bx", "by")]))),
]
CELL_COLUMNS = tuple(f.name for f in _CELL)


def cell_width(level: Column) -> Column:
    return F.lit(BASE_CELL) * F.pow(F.lit(2.0), level)


def ring_edges(rings: Column) -> Column:
    """Edges of all rings as ``array<struct<ax,ay,bx,by>>``; an open ring is closed, one of fewer than four points has none."""

    def edges(ring: Column) -> Column:
        first = F.get(ring["points"], F.lit(0))
        p = F.when(first == F.element_at(ring["points"], -1), ring["points"]).otherwise(F.concat(ring["points"], F.array(first)))
        return F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.struct(
            a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"),
        ))

    return F.flatten(F.transform(F.filter(rings, lambda r: F.size(r["points"]) >= 4), edges))


def _spans_right(e: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which edges (rows) lie right of which points (columns) at their height: the test of a point, edge by edge."""
    ax, ay, bx, by = (e[c][:, None] for c in ("ax", "ay", "bx", "by"))
    spans = (ay > y) != (by > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (bx - ax) * (y - ay) / (by - ay) + ax
    return spans & (x < at)


def _parity(e: dict[str, np.ndarray], odd: int, right: float, bottom: float, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether points of a cell are inside, from its listed edges."""
    count = _spans_right(e, x, y).sum(axis=0)
    for cx, cy in (("ax", "ay"), ("bx", "by")):
        count = count + ((e[cx] > right)[:, None] & (e[cy] > bottom)[:, None] & (e[cy][:, None] <= y)).sum(axis=0)
    return (count + odd) % 2 == 1


def _meets(e: dict[str, np.ndarray], x0: float, x1: float, y0: float, y1: float) -> np.ndarray:
    """Edges that may cross a box: their own box does, and its corners are not all on one side of their line."""
    low_x, high_x = np.minimum(e["ax"], e["bx"]), np.maximum(e["ax"], e["bx"])
    low_y, high_y = np.minimum(e["ay"], e["by"]), np.maximum(e["ay"], e["by"])
    near = (high_x >= x0) & (low_x <= x1) & (high_y >= y0) & (low_y <= y1)
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    sides = [dx * (y - e["ay"]) - dy * (x - e["ax"]) for x in (x0, x1) for y in (y0, y1)]
    slack = 1e-12 * (np.abs(dx) + np.abs(dy)) * (np.abs(dx) + np.abs(dy) + (x1 - x0) + (y1 - y0)) + 1e-300
    return near & (np.min(sides, axis=0) <= slack) & (np.max(sides, axis=0) >= -slack)


def polygon_cells(e: dict[str, np.ndarray]) -> Iterator[tuple[int, int, int, bool, int, float, float, np.ndarray]]:
    """Cells of one polygon: (level, row, column, wholly inside, parity, right, bottom, listed edges)."""
    low_x, high_x = min(e["ax"].min(), e["bx"].min()), max(e["ax"].max(), e["bx"].max())
    low_y, high_y = min(e["ay"].min(), e["by"].min()), max(e["ay"].max(), e["by"].max())
    level = 0
    while BASE_CELL * 2.0**level < max(high_x - low_x, high_y - low_y) and level < TOP_LEVEL:
        level += STEP
    width = BASE_CELL * 2.0**level
    every = np.arange(len(e["ax"]))
    todo = []  # level, row, column, edges to look at, the parity of the parent's corner and its corner
    for cy in range(int(np.floor(low_y / width)), int(np.floor(high_y / width)) + 1):
        for cx in range(int(np.floor(low_x / width)), int(np.floor(high_x / width)) + 1):
            todo.append((level, cy, cx, every, 0, np.inf, -np.inf))
    while todo:
        level, cy, cx, above, odd, right, bottom = todo.pop()
        width = BASE_CELL * 2.0**level
        m = MARGIN * width
        x1, y0 = (cx + 1) * width + m, cy * width - m
        known = {c: v[above] for c, v in e.items()}
        corner = np.array([x1]), np.array([y0])
        inside = bool(_parity(known, odd, right, bottom, *corner)[0])
        listed = above[_meets(known, cx * width - 2 * m, x1 + m, y0 - m, (cy + 1) * width + 2 * m)]
        if not len(listed):
            if inside:
                yield level, cy, cx, True, 0, x1, y0, listed
            continue
        # the other edges' parity at the corner: all there are, less the listed ones to its right
        own = {c: v[listed] for c, v in e.items()}
        rest = (int(inside) + int(_spans_right(own, *corner).sum())) % 2
        if len(listed) <= EDGES or level - STEP < BOTTOM_LEVEL:
            yield level, cy, cx, False, rest, x1, y0, listed
            continue
        n = 1 << STEP
        todo += [(level - STEP, cy * n + j, cx * n + i, listed, rest, x1, y0) for j in range(n) for i in range(n)]


def _large_cells(large: DataFrame, kept: list[str]) -> DataFrame:
    """Cells of polygons of many edges; a task holds one polygon's edges at a time."""
    schema = T.StructType([large.schema[c] for c in kept] + _CELL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("_edges")
            for i in range(batch.num_rows):
                edges = lists[i].values
                e = {c: edges.field(c).to_numpy(zero_copy_only=False) for c in ("ax", "ay", "bx", "by")}
                made = list(polygon_cells(e))
                for lo in range(0, len(made), 4096):
                    level, cy, cx, inside, odd, right, bottom, listed = zip(*made[lo : lo + 4096])
                    rows = pa.array(np.full(len(level), i))
                    flat = np.concatenate(listed)
                    ends = np.cumsum([0, *map(len, listed)]).astype(np.int32)
                    arrays = [
                        pa.array(level, pa.int32()), pa.array(cy, pa.int64()), pa.array(cx, pa.int64()), pa.array(inside, pa.bool_()), pa.array(odd, pa.int32()),
                        pa.array(right, pa.float64()), pa.array(bottom, pa.float64()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(e[c][flat]) for c in e], names=list(e))),
                    ]
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).take(rows) for c in kept], *arrays], names=[*kept, *CELL_COLUMNS])

    return large.select(*kept, "_edges").mapInArrow(run, schema)


def polygon_cover(footprints: DataFrame, wkt: str = "geom_wkt") -> DataFrame:
    """A row per polygon and cell that it covers or crosses, with the footprint's other columns.

    Adds ``_lv``, ``_cy``, ``_cx`` (level, row and column of the cell),
    ``_inside`` (no test is needed), ``_edges`` (those that cross the cell) and
    ``_odd``, ``_right``, ``_bottom`` for :func:`covers`. Text that is no
    polygon, or has a vertex without a number, has no cells.
    """
    kept = [c for c in footprints.columns if c != wkt]
    edged = once(once(footprints, _rings=polygon_rings(F.col(wkt))), _edges=ring_edges(F.col("_rings"))).select(*kept, "_edges")
    good = F.forall("_edges", lambda e: e["ax"].isNotNull() & e["ay"].isNotNull() & e["bx"].isNotNull() & e["by"].isNotNull())
    edged = edged.where((F.size("_edges") > 0) & good)
    few = F.size("_edges") <= EDGES

    xs, ys = F.transform("_edges", lambda e: e["ax"]), F.transform("_edges", lambda e: e["ay"])  # every vertex begins an edge
    boxed = once(edged.where(few), _x0=F.array_min(xs), _x1=F.array_max(xs), _y0=F.array_min(ys), _y1=F.array_max(ys))
    extent = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(BASE_CELL))
    level = F.least(F.lit(TOP_LEVEL), F.lit(STEP) * F.ceil(F.log2(extent / BASE_CELL) / STEP)).cast("int")
    leveled = once(boxed, _lv=level)

    def cells(low: str, high: str) -> Column:
        width = cell_width(F.col("_lv"))
        return F.sequence(F.floor(F.col(low) / width).cast("bigint"), F.floor(F.col(high) / width).cast("bigint"))

    small = leveled.withColumn("_cx", F.explode(cells("_x0", "_x1"))).withColumn("_cy", F.explode(cells("_y0", "_y1"))).select(
        *kept, "_lv", "_cy", "_cx", F.lit(False).alias("_inside"), F.lit(0).alias("_odd"),
        F.lit(float("inf")).alias("_right"), F.lit(float("-inf")).alias("_bottom"), "_edges",
    )
    return small.unionByName(_large_cells(edged.where(~few), kept))


def covers(x: Column, y: Column) -> Column:
    """Whether the polygon of a cover row contains a point of its cell."""

    def hits(e: Column) -> Column:
        spans = (e["ay"] > y) != (e["by"] > y)
        at = (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
        ends = [F.when((e[cx] > F.col("_right")) & (e[cy] > F.col("_bottom")) & (e[cy] <= y), 1).otherwise(0) for cx, cy in (("ax", "ay"), ("bx", "by"))]
        return F.when(spans, F.when(x < at, 1).otherwise(0)).otherwise(0) + ends[0] + ends[1]

    return F.col("_inside") | (F.aggregate("_edges", F.col("_odd"), lambda n, e: n + hits(e)) % 2 == 1)
