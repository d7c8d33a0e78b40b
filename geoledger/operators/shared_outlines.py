"""Polygon simplification that keeps walls shared: neighbours stay neighbours, without gaps or overlaps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import once, polygon_rings
from ..session import written
from .footprint import rings_text, thin_spans, vertex_count

THINNED = "kept array<array<boolean>>, arc_ring array<int>, arc_at array<int>, arc_key array<string>, whole array<boolean>"


def junctions(edges: DataFrame) -> DataFrame:
    """(x, y) of corners with more than two different neighbours over all rings; ``edges`` are (x, y, nx, ny), in any direction."""
    both = edges.unionByName(edges.select(F.col("nx").alias("x"), F.col("ny").alias("y"), F.col("x").alias("nx"), F.col("y").alias("ny")))
    return both.where("x <> nx or y <> ny").distinct().groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("x", "y")


def thin_ring(xy: np.ndarray, cuts: list[int], forced: set[int], tolerance: float) -> tuple[np.ndarray, list[tuple[int, str]], bool]:
    """Corners kept of a closed ring (its closing point left out), its arcs (place of the start, name), and whether it had to stay whole.

    Arcs run from cut to cut, and are thinned in the direction whose points sort
    first, so both rings of a wall keep the same. A ring without cuts is one arc
    from its smallest corner. An arc's name is its first edge: between junctions
    no other arc has it.
    """
    n = len(xy) - 1
    ring = xy[:n]
    cuts = cuts or [min(range(n), key=lambda i: tuple(ring[i]))]
    keep, arcs = np.zeros(n, bool), []
    for a, b in zip(cuts, [*cuts[1:], cuts[0] + n]):
        at = np.arange(a, b + 1) % n
        points = ring[at].tolist()
        if points > points[::-1]:
            at, points = at[::-1], points[::-1]
        arcs.append((a, repr((points[0], points[1]))))
        arc, kept = ring[at], np.zeros(len(at), bool)
        kept[[0, -1]] = True
        if a in forced:
            kept[:] = True
        elif len(at) > 2 and points[0] == points[-1]:
            far = int(np.argmax(np.hypot(*(arc - arc[0]).T)))
            kept[far] = True
            thin_spans(arc, kept, [(0, far), (far, len(at) - 1)], tolerance)
        else:
            thin_spans(arc, kept, [(0, len(at) - 1)], tolerance)
        keep[at[kept]] = True
    collapsed = int(keep.sum()) < 3
    return (np.ones(n, bool) if collapsed else keep), arcs, collapsed


def simplify_shared(footprints: DataFrame, wkt: str = "geom_wkt", tolerance: float = 1e-5) -> DataFrame:
    """Every row with simplified polygon text and the vertex counts before and after; an edge that two rings share stays shared.

    A corner with more than two neighbours over all rings is a junction and
    stays. Between junctions rings share an arc whole or not at all, so each arc
    is thinned by itself and alike in every ring. A ring that would keep fewer
    than three corners stays whole, and so do its arcs in all other rings. Rings
    that are not closed, and text that is no polygon, stay as they are (no counts
    for the latter). Only corners and junctions are shuffled; a ring meets just its own
    junctions, and corners that crowd together are folded before they move.
    """

    @F.pandas_udf(THINNED)
    def thinned(xs: pd.Series, ys: pd.Series, cuts: pd.Series, forced: pd.Series) -> pd.DataFrame:
        out = []
        for x, y, cut, force in zip(xs, ys, cuts, forced):
            if x is None:
                out.append((None, [], [], [], []))
                continue
            places, stay = ({(p["ring"], p["at"]) for p in (q if q is not None else ())} for q in (cut, force))
            kept, arcs = [], []
            for r, (a, b) in enumerate(zip(x, y)):
                xy = np.column_stack([a, b]) + 0.0  # no negative zero
                if len(xy) < 4 or (xy[0] != xy[-1]).any():
                    kept.append([True] * len(xy))
                    continue
                keep, own, whole = thin_ring(xy, sorted(i for s, i in places if s == r), {i for s, i in stay if s == r}, tolerance)
                kept.append(keep.tolist())
                arcs += [(r, i, name, whole) for i, name in own]
            out.append((kept, *map(list, zip(*arcs))) if arcs else (kept, [], [], [], []))
        return pd.DataFrame(out, columns=["kept", "arc_ring", "arc_at", "arc_key", "whole"])

    rings = once(footprints, _rings=polygon_rings(F.col(wkt)))
    valid = F.forall("_rings", lambda r: F.forall(r["points"], lambda p: p["x"].isNotNull() & p["y"].isNotNull()))
    base = written(once(rings, _good=F.when(valid, F.col("_rings"))).drop("_rings").withColumn("_row", F.monotonically_increasing_id()), "outlines")
    each = base.select("_row", F.posexplode("_good").alias("ring", "r"))
    edges = each.select("_row", "ring", F.posexplode(F.arrays_zip(
        F.slice(F.col("r.points"), 1, F.greatest(F.size("r.points") - 1, F.lit(0))).alias("p"), F.slice(F.col("r.points"), 2, F.size("r.points")).alias("q"),
    )).alias("at", "e")).select("_row", "ring", "at", F.col("e.p.x").alias("x"), F.col("e.p.y").alias("y"), F.col("e.q.x").alias("nx"), F.col("e.q.y").alias("ny"))
    meeting = written(junctions(edges.select("x", "y", "nx", "ny")), "junctions")
    cuts = edges.select("_row", "ring", "at", "x", "y").join(meeting, ["x", "y"], "left_semi").groupBy("_row").agg(F.collect_list(F.struct("ring", "at")).alias("_cuts"))

    def axis(name: str) -> Column:
        return F.transform("_good", lambda r: F.transform(r["points"], lambda p: p[name]))

    places = "array<struct<ring:int,at:int>>"
    first = base.join(cuts, "_row", "left").withColumn("_thin", thinned(axis("x"), axis("y"), "_cuts", F.lit(None).cast(places)))
    done = written(first, "thinned")
    arcs = done.select("_row", F.inline(F.arrays_zip("_thin.arc_ring", "_thin.arc_at", "_thin.arc_key", "_thin.whole"))).toDF("_row", "ring", "at", "key", "whole")
    stay = written(arcs.where("whole").select("key").distinct(), "whole-arcs")
    if not stay.isEmpty():  # arcs kept whole for one ring are kept whole for all; that adds corners, so no other ring collapses
        forced = written(arcs.join(stay, "key", "left_semi").groupBy("_row").agg(F.collect_set(F.struct("ring", "at")).alias("_forced")), "forced")
        again = done.join(forced, "_row").withColumn("_thin", thinned(axis("x"), axis("y"), "_cuts", "_forced")).drop("_forced")
        done = done.join(forced, "_row", "left_anti").unionByName(again)

    def closed(r: Column, k: Column) -> Column:
        points = F.filter(r["points"], lambda p, i: F.coalesce(F.get(k, i), F.lit(False)))
        return F.struct(r["hole"].alias("hole"), F.when(F.size(k) == F.size(r["points"]), points).otherwise(F.concat(points, F.slice(points, 1, 1))).alias("points"))

    out = once(done, _out=F.zip_with("_good", "_thin.kept", closed))
    return out.select(
        *[c for c in footprints.columns if c != wkt], F.coalesce(rings_text("_out"), F.col(wkt)).alias(wkt),
        vertex_count("_good").alias("vertices_before"), vertex_count("_out").alias("vertices_after"),
    )
