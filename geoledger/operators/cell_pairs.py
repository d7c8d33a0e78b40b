"""Unordered pairs of grid cells that decide a distance count: wholly in reach, or few enough rows to test.

Cells of level 0 are one radius wide, every level halves the width. A pair of
cells ends when it is wholly in reach or out of reach, or when it has few pairs
of rows; else it is taken apart into pairs of its children. So a crowded place
is counted cell by cell, and only its rim, at the radius, row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

LEVELS = 12
#: Pairs of rows that are tested rather than taken apart further.
TEST_WORK = 256
#: Share of a finest cell by which a division may put a row into the wrong one.
_SLACK = 1e-5


def with_finest_cell(rows: DataFrame, radius: float, x: str = "longitude", y: str = "latitude") -> DataFrame:
    """Adds ``_fx``, ``_fy``; coarser cells follow by shifting, so every row lies in its cell's parent."""
    width = float(radius) / (1 << LEVELS)
    return rows.withColumns({"_fx": F.floor(F.col(x) / F.lit(width)).cast("bigint"), "_fy": F.floor(F.col(y) / F.lit(width)).cast("bigint")})


def cell_at(level: int) -> list[Column]:
    return [F.lit(level).alias("level"), F.shiftright("_fx", LEVELS - level).alias("cx"), F.shiftright("_fy", LEVELS - level).alias("cy")]


def _reach(level: int) -> tuple[Column, Column]:
    """Whether the pair (ax, ay), (bx, by) is wholly in reach, and whether it is out of reach."""
    dx, dy = F.abs(F.col("bx") - F.col("ax")).cast("double"), F.abs(F.col("by") - F.col("ay")).cast("double")
    zero, radius = F.lit(0.0), float(1 << level)
    far = F.sqrt((dx + 1) * (dx + 1) + (dy + 1) * (dy + 1)) + _SLACK <= radius
    gap_x, gap_y = F.greatest(dx - 1, zero), F.greatest(dy - 1, zero)
    return far, F.sqrt(gap_x * gap_x + gap_y * gap_y) - _SLACK > radius


def cell_pairs(rows: DataFrame, test_work: int = TEST_WORK) -> tuple[DataFrame, DataFrame]:
    """(whole, tests): pairs (level, ax, ay, bx, by) that together hold every pair of ``rows`` in reach once.

    ``rows`` have a finest cell. ``a`` comes before ``b`` in order, or is the
    same cell. ``tests`` have the numbers of rows ``na`` and ``nb``; the product
    is at most ``test_work``, but for cells of the last level.
    """
    cells = written(rows.groupBy("_fx", "_fy").agg(F.count(F.lit(1)).alias("n")), "finest-cells")

    def counts(level: int) -> DataFrame:
        return cells.groupBy(*cell_at(level)).agg(F.sum("n").alias("n")).drop("level")

    def sized(pairs: DataFrame, level: int) -> DataFrame:
        own = counts(level)
        a = own.select(F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("n").alias("na"))
        b = own.select(F.col("cx").alias("bx"), F.col("cy").alias("by"), F.col("n").alias("nb"))
        return pairs.join(a, ["ax", "ay"]).join(b, ["bx", "by"])

    half = F.array(*[F.struct((F.col("ax") + dx).alias("bx"), (F.col("ay") + dy).alias("by")) for dx, dy in ((0, 0), (0, 1), (1, -1), (1, 0), (1, 1))])
    frontier = counts(0).select(F.col("cx").alias("ax"), F.col("cy").alias("ay")).select("ax", "ay", F.inline(half))
    whole, tests = [], []
    columns = ["level", "ax", "ay", "bx", "by"]
    for level in range(LEVELS + 1):
        inside, outside = _reach(level)
        few = F.col("na") * F.col("nb") <= test_work if level < LEVELS else F.lit(True)
        what = F.when(inside, "whole").when(few, "test").otherwise("split")
        judged = written(sized(frontier.where(~outside), level).withColumns({"level": F.lit(level), "what": what}), "cell-pairs")
        whole.append(judged.where("what = 'whole'").select(*columns))
        tests.append(judged.where("what = 'test'").select(*columns, "na", "nb"))
        split = judged.where("what = 'split'")
        if split.isEmpty():
            break
        child = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(("i", "j", "k", "l"), (i, j, k, m))]) for i in (0, 1) for j in (0, 1) for k in (0, 1) for m in (0, 1)])
        made = split.select("ax", "ay", "bx", "by", F.inline(child)).select(
            F.struct((F.col("ax") * 2 + F.col("i")).alias("x"), (F.col("ay") * 2 + F.col("j")).alias("y")).alias("a"),
            F.struct((F.col("bx") * 2 + F.col("k")).alias("x"), (F.col("by") * 2 + F.col("l")).alias("y")).alias("b"),
            ((F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by"))).alias("same"),
        ).where(~F.col("same") | (F.col("a") <= F.col("b")))  # of a cell with itself, each pair of children once
        low, high = F.least("a", "b"), F.greatest("a", "b")
        frontier = made.select(low["x"].alias("ax"), low["y"].alias("ay"), high["x"].alias("bx"), high["y"].alias("by"))

    def every(parts: list[DataFrame]) -> DataFrame:
        first, *others = parts
        for other in others:
            first = first.unionByName(other)
        return first

    return every(whole), every(tests)
