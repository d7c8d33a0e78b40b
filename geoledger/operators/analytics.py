"""Trends, heat maps, survival, distributions and co-location of businesses."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures as M
from ..session import written
from .cell_pairs import TEST_WORK, cell_at, cell_pairs, with_finest_cell
from .near import collapse_positions

_PLANE_RADIUS_M = 111_195.0


def openings_closings_trend(
    businesses: DataFrame, grain: str = "month", by: Sequence[str] = ("neighborhood",)
) -> DataFrame:
    """Openings, closings, net and running total per period (month, quarter, year) and group."""
    dates = F.array(*[
        F.struct(F.date_trunc(grain, c).alias("period"), F.lit(opens).alias("_opens"))
        for c, opens in (("business_start_date", True), ("business_end_date", False))
    ])
    both = businesses.select(*by, F.inline(dates)).where(F.col("period").isNotNull()).groupBy(*by, "period").agg(
        F.count_if("_opens").alias("openings"), F.count_if(~F.col("_opens")).alias("closings")
    )
    running = Window.partitionBy(*by).orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("net", F.col("openings") - F.col("closings")).withColumn(
        "active_total", F.sum("net").over(running)
    )


def heatmap(businesses: DataFrame, size: float = 0.001) -> DataFrame:
    """Businesses per floor cell and the share of the fullest cell."""
    cells = (
        businesses.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull())
        .groupBy(
            M.floor_cell(F.col("longitude"), size).alias("grid_x"),
            M.floor_cell(F.col("latitude"), size).alias("grid_y"),
        )
        .agg(F.count(F.lit(1)).alias("business_count"))
    )
    fullest = cells.agg(F.max("business_count").alias("m")).scalar()
    return cells.withColumn("intensity", F.col("business_count") / fullest)


def survival_rates(businesses: DataFrame, now: dt.datetime, years: Sequence[int] = (1, 2, 3, 5)) -> DataFrame:
    """Per year of start: share still open after k years, of those that could be seen that long."""
    start, end = F.col("business_start_date"), F.col("business_end_date")
    aggs = []
    for k in years:
        mark = start + F.make_ym_interval(F.lit(k), F.lit(0))
        seen = mark <= M.moment(now)
        aggs += [
            F.count_if(seen).alias(f"a{k}"),
            F.count_if(seen & (end.isNull() | (end >= mark))).alias(f"s{k}"),
        ]
    cohorts = businesses.where(start.isNotNull()).groupBy(F.year(start).alias("cohort")).agg(*aggs)
    entries = F.array(*[
        F.struct(F.lit(k).alias("years"), F.col(f"a{k}").alias("at_risk"), F.col(f"s{k}").alias("surviving"))
        for k in years
    ])
    out = cohorts.select("cohort", F.inline(entries)).where(F.col("at_risk") > 0)
    return out.withColumn("survival_rate", F.col("surviving") / F.col("at_risk"))


def survival_curve(businesses: DataFrame, now: dt.datetime, kind: str = "naics_description") -> DataFrame:
    """Product-limit estimate per year of start and kind: a row per age in days at which businesses closed.

    All businesses count: one still open, or closed after ``now``, is at risk up
    to its age at ``now`` and then leaves without an event. ``at_risk`` have
    reached the age; ``survival`` is the product over the ages so far of the
    share that got past each, and ``std_error`` is Greenwood's (null once nobody
    is left). Rows are counted per age first, so sums run over ages, not rows.
    """
    start, end, today = F.col("business_start_date"), F.col("business_end_date"), M.moment(now)
    closed = end.isNotNull() & (end <= today)
    age = F.datediff(F.when(closed, end).otherwise(today), start)
    ages = businesses.where(start <= today).select(F.year(start).alias("cohort"), F.col(kind).alias("kind"), age.alias("age_days"), closed.alias("closed")).where(
        F.col("age_days") >= 0
    ).groupBy("cohort", "kind", "age_days").agg(F.count_if("closed").alias("closings"), F.count_if(~F.col("closed")).alias("censored"))
    group = Window.partitionBy("cohort", "kind")
    older = group.orderBy(F.desc("age_days")).rowsBetween(Window.unboundedPreceding, 0)
    so_far = group.orderBy("age_days").rowsBetween(Window.unboundedPreceding, 0)
    n, d = F.col("at_risk"), F.col("closings")
    gone = F.max(n == d).over(so_far)
    share = F.when(n > d, F.log(1 - d / n)).otherwise(0.0)
    spread = F.when(n > d, d / (n * (n - d).cast("double"))).otherwise(0.0)
    at_risk = ages.withColumn("at_risk", F.sum(F.col("closings") + F.col("censored")).over(older)).where(d > 0)
    curve = at_risk.withColumn("survival", F.when(gone, 0.0).otherwise(F.exp(F.sum(share).over(so_far))))
    return curve.withColumn("std_error", F.when(F.col("survival") > 0, F.col("survival") * F.sqrt(F.sum(spread).over(so_far)))).select(
        "cohort", "kind", "age_days", "at_risk", "closings", "survival", "std_error",
    )


def distributions(businesses: DataFrame, area: str = "neighborhood", kind: str = "naics_description") -> DataFrame:
    """Count per area and industry with the share inside the area."""
    counts = businesses.groupBy(area, kind).agg(F.count(F.lit(1)).alias("business_count"))
    share = F.col("business_count") / F.sum("business_count").over(Window.partitionBy(area))
    return counts.withColumn("area_share", share)


def _kind_pairs(located: DataFrame, radius: float, test_work: int) -> DataFrame:
    """(kind_1, kind_2, pairs): weighted pairs of rows in reach, parts of the sum, without rows with themselves."""
    whole, tests = cell_pairs(located, test_work)
    used = [r["level"] for r in whole.select("level").unionByName(tests.select("level")).distinct().collect()]  # at most LEVELS + 1
    if not used:
        return located.select("kind", F.col("kind").alias("kind_2"), F.lit(0).cast("decimal(38,0)").alias("pairs")).limit(0).toDF("kind_1", "kind_2", "pairs")
    wide = "decimal(38,0)"
    w = F.col("w").cast("decimal(19,0)")
    celled = located.select("*", F.inline(F.array(*[F.struct(*cell_at(level)) for level in sorted(used)])))

    def side(df: DataFrame, cell: str, **columns: str) -> DataFrame:
        return df.select("level", F.col("cx").alias(f"{cell}x"), F.col("cy").alias(f"{cell}y"), *[F.col(c).alias(n) for c, n in columns.items()])

    # cells wholly in reach: what all their partners hold of a kind, times what the cell holds of its kinds
    counts = celled.groupBy("level", "cx", "cy", "kind").agg(F.sum(w).cast("decimal(25,0)").alias("n"), F.sum(w * w).cast(wide).alias("q"))
    apart = F.struct("ax", "ay") < F.struct(F.col("bx"), F.col("by"))
    others = whole.where(apart).join(side(counts, "b", kind="kind_2", n="m"), ["level", "bx", "by"]).groupBy("level", "ax", "ay", "kind_2").agg(F.sum("m").cast("decimal(25,0)").alias("m"))
    product = F.col("n").cast(wide) * F.col("m").cast("decimal(25,0)")
    between = others.join(side(counts, "a", kind="kind_1", n="n"), ["level", "ax", "ay"]).select("kind_1", "kind_2", product.cast(wide).alias("pairs"))
    own = whole.where(~apart).drop("bx", "by")
    mixed = own.join(side(counts, "a", kind="kind_1", n="n", q="q"), ["level", "ax", "ay"]).join(side(counts, "a", kind="kind_2", n="m"), ["level", "ax", "ay"]).where(F.col("kind_1") <= F.col("kind_2"))
    within = mixed.select("kind_1", "kind_2", F.when(F.col("kind_1") < F.col("kind_2"), product).otherwise(((product - F.col("q")) * F.lit("0.5").cast("decimal(2,1)"))).cast(wide).alias("pairs"))
    # the others row by row
    rows = {"longitude": "x", "latitude": "y", "kind": "kind", "w": "w"}
    left, right = (side(celled, c, **{k: f"{v}_{i}" for k, v in rows.items()}) for c, i in (("a", 1), ("b", 2)))
    met = tests.drop("na", "nb").join(left, ["level", "ax", "ay"]).join(right, ["level", "bx", "by"])
    dx, dy = F.col("x_1") - F.col("x_2"), F.col("y_1") - F.col("y_2")
    once_each = apart | (F.struct("x_1", "y_1", "kind_1") < F.struct(F.col("x_2"), F.col("y_2"), F.col("kind_2")))
    near = met.where((dx * dx + dy * dy <= F.lit(float(radius) ** 2)) & once_each)
    tested = near.select("kind_1", "kind_2", (F.col("w_1").cast("decimal(19,0)") * F.col("w_2").cast("decimal(19,0)")).cast(wide).alias("pairs"))
    return between.unionByName(within).unionByName(tested)


def co_location(businesses: DataFrame, radius: float = 0.0003, kind: str = "naics_code", test_work: int = TEST_WORK) -> DataFrame:
    """Pairs of kinds found within ``radius`` degrees of each other, with lift.

    Rows at the same position and of the same kind are counted first. Pairs of
    cells wholly in reach multiply their counts per kind; only pairs of cells
    across the radius are tested row by row, each direction once, and these are
    taken apart until they hold few rows (:mod:`.cell_pairs`). ``lift`` compares
    the share of a kind pair with what independent kinds would give.
    """
    folded = collapse_positions(businesses.where(F.col(kind).isNotNull()), kind)
    located = written(with_finest_cell(folded.select("longitude", "latitude", F.col(kind).alias("kind"), F.col("weight").alias("w")), radius), "kinds")
    between = _kind_pairs(located, radius, test_work).select(
        F.least("kind_1", "kind_2").alias("kind_1"), F.greatest("kind_1", "kind_2").alias("kind_2"), "pairs",
    )
    same = located.where(F.col("w") > 1).select(
        F.col("kind").alias("kind_1"), F.col("kind").alias("kind_2"), F.expr("cast(cast(w as decimal(19,0)) * cast(w - 1 as decimal(18,0)) * 0.5BD as decimal(38,0))").alias("pairs"),
    )
    counted = written(between.unionByName(same).groupBy("kind_1", "kind_2").agg(F.sum("pairs").alias("pair_count")), "kind-pairs")
    total = counted.agg(F.sum(F.col("pair_count").cast("double")).alias("t")).scalar()
    sizes = located.groupBy("kind").agg(F.sum("w").alias("n"))
    rows = sizes.agg(F.sum("n").alias("t")).scalar()
    p1 = sizes.select(F.col("kind").alias("kind_1"), F.col("n").alias("n1"))
    p2 = sizes.select(F.col("kind").alias("kind_2"), F.col("n").alias("n2"))
    chance = (F.col("n1") / rows) * (F.col("n2") / rows) * F.when(F.col("kind_1") == F.col("kind_2"), 1.0).otherwise(2.0)
    return (
        counted.join(p1, "kind_1").join(p2, "kind_2")
        .withColumn("lift", F.col("pair_count").cast("double") / (chance * total))
        .select("kind_1", "kind_2", "pair_count", "lift")
    )


def kmeans_districts(
    businesses: DataFrame, k: int = 8, seed: int = 42, max_iter: int = 20, key: str = "unique_id",
    origin: tuple[float, float] = (-122.4194, 37.7749),
) -> DataFrame:
    """K-means districts over local metres east and north of ``origin``.

    ``distance_m`` is the way to the own district's centre, ``nearest_m`` to the
    nearest one: they are the same but for rounding.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    lon0, lat0 = origin
    metres = businesses.where(F.col("longitude").isNotNull() & F.col("latitude").isNotNull()).select(
        key, "longitude", "latitude",
        ((F.col("longitude") - lon0) * _PLANE_RADIUS_M * F.cos(F.radians(F.lit(lat0)))).alias("east"),
        ((F.col("latitude") - lat0) * _PLANE_RADIUS_M).alias("north"),
    )
    vectors = VectorAssembler(inputCols=["east", "north"], outputCol="features").transform(metres)
    model = KMeans(k=k, seed=seed, maxIter=max_iter, predictionCol="district").fit(vectors)
    centres = F.array(*[F.struct(F.lit(float(e)).alias("east"), F.lit(float(n)).alias("north")) for e, n in model.clusterCenters()])

    def gap(c):
        return (F.col("east") - c["east"]) * (F.col("east") - c["east"]) + (F.col("north") - c["north"]) * (F.col("north") - c["north"])

    gaps = F.transform(centres, gap)
    return model.transform(vectors).select(
        key, "longitude", "latitude", "district",
        F.sqrt(F.get(gaps, F.col("district"))).alias("distance_m"), F.sqrt(F.array_min(gaps)).alias("nearest_m"),
    )
