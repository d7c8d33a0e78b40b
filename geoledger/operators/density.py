"""Density-based clustering (DBSCAN) as grid joins and connected components.

Positions are whole ten-millionths of a degree, so all distance tests are
exact. The grid cell is so small that two points of one cell are always
neighbours; a cell with ``min_points`` points therefore needs no distance test
and is one node of the graph. Only thinly filled cells count neighbours one by
one, and two cells are linked through their facing edges only, so dense places
never produce all their pairs.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..session import written
from .components import connected
from .near import cell_join

TILE = 64  # cells per side
_REACH = 2  # cells of side eps / sqrt(2): a neighbour is at most two cells away


def _square(x1: str, y1: str, x2: str, y2: str) -> Column:
    dx, dy = F.col(x1) - F.col(x2), F.col(y1) - F.col(y2)
    return dx * dx + dy * dy


def _around(df: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    cells = F.array(*[
        F.struct((F.col("cx") + dx).alias("_nx"), (F.col("cy") + dy).alias("_ny")) for dx, dy in offsets
    ])
    return df.select("*", F.inline(cells)).withColumnsRenamed({"cx": "_x0", "cy": "_y0"}).withColumnsRenamed(
        {"_nx": "cx", "_ny": "cy"}
    )


_ALL = [(dx, dy) for dx in range(-_REACH, _REACH + 1) for dy in range(-_REACH, _REACH + 1)]


def dbscan_districts(
    points: DataFrame, eps: float = 0.0003, min_points: int = 5, key: str = "unique_id",
    lon: str = "longitude", lat: str = "latitude",
) -> DataFrame:
    """(key, cluster_id, is_core) per located point; noise has a null cluster.

    ``min_points`` counts the point itself. A cluster is named by the smallest
    key among its core points; a border point in reach of several clusters
    takes the one with the smallest name.
    """
    reach = int(round(eps * M.COORDINATE_SCALE))
    side = int(reach / math.sqrt(2))
    if side < 1:
        raise ValueError("eps is below the coordinate resolution")
    limit = reach * reach
    located = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(
        key, M.fixed_point(F.col(lon)).alias("px"), M.fixed_point(F.col(lat)).alias("py")
    )
    positions = written(
        located.groupBy("px", "py").agg(
            F.count(F.lit(1)).alias("w"), F.min(key).alias("first_key")
        ).withColumns({
            "cx": F.floor(F.col("px") / side).cast("bigint"), "cy": F.floor(F.col("py") / side).cast("bigint"),
        }),
        "positions",
    )
    filled = positions.groupBy("cx", "cy").agg(F.sum("w").alias("cell_w"))
    thin_cells = filled.where(F.col("cell_w") < min_points).select("cx", "cy")
    thin = positions.join(thin_cells, ["cx", "cy"])
    dense = positions.join(thin_cells, ["cx", "cy"], "left_anti")
    # fewer than min_points positions per thin cell look around, so the pairs
    # grow with the number of positions and not with its square
    seekers = _around(thin, _ALL).withColumnsRenamed({"px": "sx", "py": "sy", "first_key": "key"}).drop("w")
    near = cell_join(
        positions.select("px", "py", "w", "cx", "cy"), seekers, ["cx", "cy"], _square("px", "py", "sx", "sy") <= limit
    )
    crowd = near.groupBy("sx", "sy", "_x0", "_y0", F.col("key").alias("first_key")).agg(F.sum("w").alias("n"))
    sparse_core = crowd.where(F.col("n") >= min_points).withColumnsRenamed(
        {"sx": "px", "sy": "py", "_x0": "cx", "_y0": "cy"}
    )
    columns = ["px", "py", "cx", "cy", "first_key"]
    in_cell = Window.partitionBy("cx", "cy")
    core = written(
        dense.select(*columns).unionByName(sparse_core.select(*columns)).withColumn("node", F.min("first_key").over(in_cell)),
        "core",
    )
    labels = _components(core.select("node").distinct(), _cell_links(core, limit))
    labelled = written(core.join(labels, "node").select("px", "py", "cx", "cy", "label"), "labelled")
    loose = thin.join(labelled.select("px", "py"), ["px", "py"], "left_anti")
    seekers = _around(loose, _ALL).withColumnsRenamed({"px": "sx", "py": "sy"})
    border = (
        cell_join(labelled, seekers, ["cx", "cy"], _square("px", "py", "sx", "sy") <= limit)
        .groupBy(F.col("sx").alias("px"), F.col("sy").alias("py"))
        .agg(F.min("label").alias("label"))
    )
    placed = labelled.select("px", "py", "label", F.lit(True).alias("is_core")).unionByName(
        border.withColumn("is_core", F.lit(False))
    )
    return located.join(placed, ["px", "py"], "left").select(
        key, F.col("label").alias("cluster_id"), F.coalesce("is_core", F.lit(False)).alias("is_core")
    )


def _cell_links(core: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) of neighbouring cells that hold core points in reach of each other, with the tile of either cell.

    For a cell to the right only the rightmost point of every row here and the
    leftmost point of every row there can be closest; likewise by columns for a
    cell straight above. That bounds the points of a cell by its side length.
    """
    rows = core.groupBy("cx", "cy", "node", "py").agg(F.min("px").alias("low"), F.max("px").alias("high"))
    columns = core.groupBy("cx", "cy", "node", "px").agg(F.min("py").alias("low"), F.max("py").alias("high"))
    right = [(dx, dy) for dx, dy in _ALL if dx > 0]
    above = [(0, dy) for dy in range(1, _REACH + 1)]

    def tile(x: str, y: str) -> Column:
        return F.struct(F.floor(F.col(x) / TILE).alias("x"), F.floor(F.col(y) / TILE).alias("y"))

    def links_of(lines: DataFrame, at: str, offsets: list[tuple[int, int]]) -> DataFrame:
        # the joined cell is the neighbour's; both sides carry the name of their own cell
        here = _around(lines.select("cx", "cy", F.col("high").alias("a_edge"), F.col(at).alias("a_line"),
                                     F.col("node").alias("a")), offsets).withColumn("a_tile", tile("_x0", "_y0")).drop("_x0", "_y0")
        there = lines.select("cx", "cy", F.col("low").alias("b_edge"), F.col(at).alias("b_line"), F.col("node").alias("b"), tile("cx", "cy").alias("b_tile"))
        found = cell_join(there, here, ["cx", "cy"], _square("a_edge", "a_line", "b_edge", "b_line") <= limit)
        return found.select("a", "b", "a_tile", "b_tile").distinct()

    return links_of(rows, "py", right).unionByName(links_of(columns, "px", above))


def _tile_roots(links: pd.DataFrame) -> pd.DataFrame:
    """(node, root) of the cells of one tile, joined by the links inside it; at most TILE * TILE cells."""
    root: dict = {}

    def find(n):
        while root.setdefault(n, n) != n:
            root[n] = n = root[root[n]]
        return n

    for a, b in zip(links["a"].tolist(), links["b"].tolist()):
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return pd.DataFrame([(n, find(n)) for n in root], columns=["node", "root"])


def _components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Smallest node name per connected component.

    Tiles of TILE x TILE cells are solved first, each in one group of bounded
    size; what is left are the links between tiles, between far fewer nodes.
    """
    every = written(links, "links")
    name = nodes.schema["node"].dataType.simpleString()
    inner = every.where("a_tile = b_tile").groupBy("a_tile").applyInPandas(lambda part: _tile_roots(part), f"node {name}, root {name}")
    local = written(nodes.join(inner, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "tile-roots")
    ends = [local.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")) for c in ("a", "b")]
    outer = every.where("a_tile <> b_tile").select("a", "b").join(ends[0], "a").join(ends[1], "b")
    far = connected(outer.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")), "tile-links")
    return local.join(far.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left").select("node", F.coalesce("far", "root").alias("label"))
