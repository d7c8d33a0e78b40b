"""Distance joins as bucketed equi-joins.

Both sides are put on a grid whose cell is at least one search radius wide, the
target side is repeated over the 3 x 3 neighbouring cells, and the join is an
equality on the cell with the exact distance as a residual condition. A cell
with too many pairs to test is cut into a grid of (point share, target share)
blocks of bounded work, so no task gets a whole hot cell.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import once
from ..functions.measures import EARTH_RADIUS_M, fixed_point, haversine_m
from ..session import written

METRES_PER_ARC_DEGREE = EARTH_RADIUS_M * math.pi / 180

# Cell edge relative to the radius: the slack keeps a neighbour within one cell
# even if a division rounds a coordinate over an edge.
_SLACK = 1.001

# A block of a cell tests at most about HOT_ROWS ** 2 pairs; a cell with more is
# cut, whichever side its rows are on and however large the tables are.
HOT_ROWS = 7_000

# Pairs that one task of a join tests, and the most tasks it is dealt over. The
# sides of a join can be a few MB where its pairs are billions, so tasks are
# numbered by pairs; bytes would leave them all to one or two.
TASK_PAIRS = 25_000_000
MOST_TASKS = 4_096

# Rows of one position that go through a join as one, about; more are cut into several.
FOLD = 500


def _present(lon: str, lat: str) -> Column:
    return F.col(lon).isNotNull() & F.col(lat).isNotNull()


def _row_step(radius: float, metric: str) -> float:
    return _SLACK * (radius if metric == "degrees" else radius / METRES_PER_ARC_DEGREE)


def _columns(row: Column, lon: Column, step: float, metric: str) -> list[Column]:
    """The cell columns left of, at and right of a longitude in a row of cells.

    On the sphere the width grows with the latitude; it is taken at the outer
    edge of the neighbouring row, so one cell is enough on either side. Columns
    are numbered around the globe, and rows near a pole are one cell wide.
    """
    if metric == "degrees":
        own = F.floor(lon / F.lit(step)).cast("bigint")
        return [own - 1, own, own + 1]
    edge = (F.abs(row) + 2) * F.lit(step)
    around = F.when(edge < 89.0, F.floor(F.lit(360.0) * F.cos(F.radians(F.least(edge, F.lit(89.0)))) / F.lit(step))).otherwise(1)
    count = F.greatest(around, F.lit(1)).cast("bigint")
    own = F.floor((lon + 180.0) * count / 360.0).cast("bigint")
    return [F.pmod(own + d, count) for d in (-1, 0, 1)]


def _own_cell(df: DataFrame, lon: str, lat: str, radius: float, metric: str) -> DataFrame:
    step = _row_step(radius, metric)
    row = F.floor(F.col(lat) / F.lit(step)).cast("bigint")
    return df.where(_present(lon, lat)).withColumns({"_cy": row, "_cx": _columns(row, F.col(lon), step, metric)[1]})


def _nine_cells(df: DataFrame, lon: str, lat: str, radius: float, metric: str) -> DataFrame:
    step = _row_step(radius, metric)
    base = F.floor(F.col(lat) / F.lit(step)).cast("bigint")
    cells = [
        F.struct((base + dy).alias("_cy"), column.alias("_cx"))
        for dy in (-1, 0, 1) for column in _columns(base + dy, F.col(lon), step, metric)
    ]
    every = F.array(*cells)  # a row of fewer than three cells names some twice
    return df.where(_present(lon, lat)).select("*", F.inline(every if metric == "degrees" else F.array_distinct(every)))


_PAIRS = "cast(_p as double) * _t"


def _cell_counts(points: DataFrame, targets: DataFrame, cells: Sequence[str], weights: tuple[Column, Column]) -> DataFrame:
    """Rows of either side, or what they stand for, in the cells that have both."""
    p = points.groupBy(*cells).agg(F.sum(weights[0]).alias("_p"))
    t = targets.groupBy(*cells).agg(F.sum(weights[1]).alias("_t"))
    return p.join(t, list(cells))


def _shares(counts: DataFrame, cells: Sequence[str], hot_rows: int) -> DataFrame:
    work = F.lit(float(hot_rows) ** 2)
    ts = F.ceil(F.col("_t") / F.lit(hot_rows))
    ps = F.ceil(F.col("_p").cast("double") * F.ceil(F.col("_t") / ts) / work)
    return counts.where(F.expr(_PAIRS) > work).select(*cells, ps.cast("int").alias("_ps"), ts.cast("int").alias("_ts"))


def _hot_cells(points: DataFrame, targets: DataFrame, cells: Sequence[str], hot_rows: int) -> DataFrame:
    """Cells with more than hot_rows ** 2 pairs to test, and into how many shares either side is cut."""
    return _shares(_cell_counts(points, targets, cells, (F.lit(1), F.lit(1))), cells, hot_rows)


def cell_join(
    points: DataFrame,
    targets: DataFrame,
    cells: Sequence[str],
    condition: Column,
    hot_rows: int = HOT_ROWS,
    weights: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Equi-join on ``cells`` plus ``condition`` with hot cells cut into blocks.

    A point takes one point share and is repeated over the target shares of its
    cell; a target takes one target share and is repeated over the point shares.
    Every pair meets in exactly one block. Blocks are dealt over tasks by the
    pairs to test. ``weights`` says how many rows a row of either side stands for.
    """
    counts = written(_cell_counts(points, targets, cells, weights or (F.lit(1), F.lit(1))), "cell-counts")
    # written, so its true size tells the planner whether to copy or to shuffle it
    hot = written(_shares(counts, cells, hot_rows), "hot-cells")
    tasks = math.ceil((counts.agg(F.sum(F.expr(_PAIRS))).first()[0] or 0) / TASK_PAIRS)

    def blocks(df: DataFrame, own: str, own_block: str, other: str, other_block: str) -> DataFrame:
        # The task number spreads exact copies of a row; files and hash
        # partitions keep it the same when a task is run again.
        spread = F.xxhash64(*df.columns) + F.spark_partition_id()
        return (
            df.join(hot, list(cells), "left")
            .withColumn(own_block, F.when(F.col(own) > 1, F.pmod(spread, F.col(own))).otherwise(F.lit(0)).cast("int"))
            .withColumn(other_block, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1)))
            .drop("_ps", "_ts")
        )

    left = blocks(points, "_ps", "_pb", "_ts", "_tb")
    right = blocks(targets, "_ts", "_tb", "_ps", "_pb")
    keys = [*cells, "_pb", "_tb"]
    if tasks > 1:  # a number below the default would be dealt anew, and then by bytes
        tasks = min(MOST_TASKS, max(tasks, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        left, right = left.repartition(tasks, *keys).hint("merge"), right.repartition(tasks, *keys)
    joined = left.join(right, keys).where(condition)
    return joined.drop(*keys)


def _near_pairs(
    points: DataFrame,
    targets: DataFrame,
    radius: float,
    metric: str,
    point_at: tuple[str, str],
    target_at: tuple[str, str],
    distance: str,
    hot_rows: int,
    repeat: str = "targets",
    weights: tuple[Column, Column] | None = None,
) -> DataFrame:
    (plon, plat), (tlon, tlat) = point_at, target_at
    r = float(radius)
    dx, dy = F.col(plon) - F.col(tlon), F.col(plat) - F.col(tlat)
    if metric == "degrees":
        square = dx * dx + dy * dy
        within, value = square <= F.lit(r * r), F.sqrt(square)
    elif metric == "meters":
        points = points.withColumn("_pc", F.cos(F.radians(F.col(plat))))
        targets = targets.withColumn("_tc", F.cos(F.radians(F.col(tlat))))
        value = haversine_m(F.col(plat), F.col(plon), F.col(tlat), F.col(tlon))
        # Without sines first: half angles instead of their sines are at most
        # 1 % too large below 0.3 radians, so no pair in reach is lost.
        hx, hy = F.radians(dx) / 2, F.radians(dy) / 2
        bound = F.lit(1.01 * math.sin(min(r / (2 * EARTH_RADIUS_M), math.pi / 2)) ** 2)
        within = (hy * hy + F.col("_pc") * F.col("_tc") * hx * hx <= bound) | (F.abs(hx) > 0.15) | (F.abs(hy) > 0.15)
    else:
        raise ValueError(f"unknown metric {metric!r}")
    place, around = (_own_cell, _nine_cells) if repeat == "targets" else (_nine_cells, _own_cell)
    pairs = cell_join(
        place(points, plon, plat, r, metric),
        around(targets, tlon, tlat, r, metric),
        ["_cy", "_cx"],
        within,
        hot_rows,
        weights,
    )
    if metric == "degrees":
        return pairs.withColumn(distance, value)
    return once(pairs.drop("_pc", "_tc"), **{distance: value}).where(F.col(distance) <= F.lit(r))


def radius_join(
    businesses: DataFrame,
    buildings: DataFrame,
    radius: float = 0.0005,
    metric: str = "degrees",
    business_at: tuple[str, str] = ("longitude", "latitude"),
    building_at: tuple[str, str] = ("center_lon", "center_lat"),
    distance: str | None = None,
    hot_rows: int = HOT_ROWS,
    repeat: str = "buildings",
) -> DataFrame:
    """All (business, building) pairs within ``radius``, all columns of both sides.

    ``repeat`` names the side that is repeated over neighbouring cells: the one
    with fewer rows, "buildings" or "businesses". Both sides are read twice, so
    write out a side that is costly to compute.
    """
    name = distance or ("distance_degrees" if metric == "degrees" else "distance_meters")
    side = {"buildings": "targets", "businesses": "points"}[repeat]
    return _near_pairs(businesses, buildings, radius, metric, business_at, building_at, name, hot_rows, side)


def _by_position(df: DataFrame, lon: str, lat: str, name: str, fold: int) -> DataFrame:
    """Rows of a position as arrays ``name`` of about ``fold`` rows at most.

    Rows of a crowded position are dealt by their number in the task, which
    parts exact copies, too.
    """
    rows = df.where(_present(lon, lat)).withColumn("_at", F.xxhash64(F.monotonically_increasing_id()))
    crowded = df.groupBy(lon, lat).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > fold)
    cuts = written(crowded.select(lon, lat, F.ceil(F.col("_n") / F.lit(fold)).alias("_cut")), "crowded-positions")
    dealt = rows.join(cuts, [lon, lat], "left").withColumn("_part", F.coalesce(F.pmod("_at", "_cut"), F.lit(0)))
    rest = [c for c in df.columns if c not in (lon, lat)]
    return dealt.groupBy(lon, lat, "_part").agg(F.collect_list(F.struct(*rest)).alias(name)).drop("_part")


def position_pairs(
    businesses: DataFrame,
    buildings: DataFrame,
    radius: float = 0.0005,
    metric: str = "degrees",
    digits: int | None = None,
    hot_rows: int = HOT_ROWS,
    fold: int = FOLD,
) -> DataFrame:
    """The rows of :func:`radius_join`, met by position; the distance rounded to ``digits``, if given.

    For sides whose rows share positions, and results that are pairs: rows of
    one position are tested and measured as one, and expanded in the task that
    found them. So there is one distance per pair of positions, and pairs
    leave a task in runs of equal positions, which columnar files store small.
    """
    name = "distance_degrees" if metric == "degrees" else "distance_meters"
    left = written(_by_position(businesses, "longitude", "latitude", "_businesses", fold), "positions")
    right = written(_by_position(buildings, "center_lon", "center_lat", "_buildings", fold), "centre-positions")
    weights = F.size("_businesses"), F.size("_buildings")
    near = _near_pairs(left, right, radius, metric, ("longitude", "latitude"), ("center_lon", "center_lat"), name, hot_rows, weights=weights)
    if digits is not None:
        near = near.withColumn(name, F.round(name, digits))
    every = near.select("*", F.inline("_buildings")).drop("_buildings").select("*", F.inline("_businesses")).drop("_businesses")
    return every.select(*businesses.columns, *buildings.columns, name)


def associations(pairs: DataFrame) -> DataFrame:
    """Pairs in the column layout that the aggregations read."""
    return pairs.select(
        F.col("osm_id").alias("building_id"), "building_type", "building_category",
        F.col("center_lon").alias("building_center_lon"), F.col("center_lat").alias("building_center_lat"),
        F.col("unique_id").alias("business_id"), "naics_code", "naics_description",
        "distance_degrees",
    )


#: Targets of a cell, one search radius wide, for each of the k wanted, from which on a quarter of the radius is tried first.
DENSE = 8
#: Times the radius may be quartered for a start.
FINEST = 5


def _with_start(places: DataFrame, targets: DataFrame, radius: float, k: int) -> DataFrame:
    """Places with ``_start``: how often the radius is quartered for their first search, by the targets in their cell.

    A quarter of the radius holds a sixteenth of the targets, so every step asks for sixteen times as many.
    """
    cells = _own_cell(targets, "building_lon", "building_lat", radius, "meters").groupBy("_cy", "_cx").agg(F.count(F.lit(1)).alias("_t"))
    steps = F.floor(F.log(F.col("_t") / F.lit(float(DENSE * k))) / F.lit(math.log(16.0)) + 1)
    dense = cells.where(F.col("_t") >= DENSE * k).select("_cy", "_cx", F.least(steps, F.lit(FINEST)).cast("int").alias("_start"))
    placed = _own_cell(places, "business_lon", "business_lat", radius, "meters").join(written(dense, "dense-cells"), ["_cy", "_cx"], "left")
    return placed.drop("_cy", "_cx").withColumn("_start", F.coalesce("_start", F.lit(0)))


def nearest_join(
    businesses: DataFrame,
    buildings: DataFrame,
    max_distance_m: float = 100.0,
    k: int = 1,
    key: str = "unique_id",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The ``k`` nearest buildings of every business within ``max_distance_m``.

    Every business row is matched for itself, also where ``key`` repeats; ties
    go to the smaller building id. With k = 1 there is one flat row per match,
    with k > 1 aligned arrays.

    Positions are searched, not rows. Where many buildings are near, a search
    begins with a small part of the radius: k matches within it are the nearest
    ones, and only positions with fewer look four times as far, up to the
    whole radius. So a crowded place tests about as many pairs as a thin one.
    Of the buildings that share a centre only the first k can be among them.
    """
    head, at = ["business_unique_id", "business_lon", "business_lat", "business_name"], ["business_lon", "business_lat"]
    named = businesses.select(
        F.col(key).alias("business_unique_id"), F.col("longitude").alias("business_lon"),
        F.col("latitude").alias("business_lat"), F.col("dba_name").alias("business_name"),
    ).where(_present(*at))
    there = Window.partitionBy("building_lon", "building_lat").orderBy("building_osm_id", "building_type")
    right = written(buildings.select(
        F.col("osm_id").alias("building_osm_id"), "building_type",
        F.col("center_lon").alias("building_lon"), F.col("center_lat").alias("building_lat"),
    ).distinct().withColumn("_rank", F.row_number().over(there)).where(F.col("_rank") <= k).drop("_rank"), "targets")
    places = written(_with_start(named.select(*at).distinct(), right, max_distance_m, k), "places")
    by_distance = Window.partitionBy(*at).orderBy("distance_meters", "building_osm_id", "building_type", "building_lon", "building_lat")

    def within(some: DataFrame, radius: float) -> DataFrame:
        pairs = _near_pairs(some.select(*at), right, radius, "meters", tuple(at), ("building_lon", "building_lat"), "distance_meters", hot_rows)
        # A row_number limit is applied per task before the shuffle as well.
        return pairs.withColumn("_rank", F.row_number().over(by_distance)).where(F.col("_rank") <= k)

    starts = sorted((r["_start"] for r in places.select("_start").distinct().collect()), reverse=True)  # at most FINEST + 1
    found, rest = [], None
    for step in range(max(starts, default=0), 0, -1):
        some = places.where(F.col("_start") == step).select(*at)
        some = some if rest is None else some.unionByName(rest)
        matches = written(within(some, max_distance_m / 4**step), "matches")
        settled = matches.where(F.col("_rank") == k).select(*at)
        found.append(matches.join(settled, at, "left_semi") if k > 1 else matches)
        rest = written(some.join(settled, at, "left_anti"), "places")
    last = places.where("_start = 0").select(*at)
    ranked = within(last if rest is None else last.unionByName(rest), max_distance_m)
    for matches in found:
        ranked = ranked.unionByName(matches)

    if k == 1:
        return named.join(ranked.drop("_rank"), at).select(
            *head, "building_osm_id", "building_type", "building_lon", "building_lat", "distance_meters"
        )
    match = F.struct("_rank", "building_osm_id", "building_type", "building_lon", "building_lat", "distance_meters")
    grouped = ranked.groupBy(*at).agg(
        F.sort_array(F.collect_list(match)).alias("_m")  # at most k matches
    )
    fields = {
        "building_osm_ids": "building_osm_id", "building_types": "building_type",
        "building_lons": "building_lon", "building_lats": "building_lat",
        "distances_meters": "distance_meters",
    }
    return named.join(grouped, at).select(
        *head, *[F.col(f"_m.{field}").alias(out) for out, field in fields.items()],
        F.size("_m").alias("match_count"),
    )


def attributed_pairs(businesses: DataFrame, buildings: DataFrame, *columns: str, radius: float = 0.0005) -> DataFrame:
    """(business_id, building_id) within ``radius`` with business columns, looked up by id before the distance join.

    The same rows as :func:`attach_attributes` of the pairs, but pairs, which
    can outnumber both sides by far, are not shuffled.
    """
    places = businesses.where(_present("longitude", "latitude")).select(F.col("unique_id").alias("business_id"), "longitude", "latitude")
    # shuffled by id, not copied to all tasks: files of a few MB can be millions of rows
    known = written(attach_attributes(places, businesses.hint("merge"), *columns), "places")
    pairs = position_pairs(known, buildings.select("osm_id", "center_lon", "center_lat"), radius)
    return pairs.select("business_id", F.col("osm_id").alias("building_id"), *columns)


def distinct_radius_pairs(businesses: DataFrame, buildings: DataFrame, radius: float = 0.0005) -> DataFrame:
    """Distinct (business_id, building_id) within ``radius``.

    Repeated rows go before the join. After it only ids that lie at several
    places can repeat a pair, so just their pairs are shuffled.
    """
    def parted(df: DataFrame, key: str, *at: str) -> tuple[DataFrame, DataFrame]:
        rows = df.where(_present(*at)).select(key, *at).distinct()
        spread = Window.partitionBy(key)
        counted = written(rows.withColumn("_places", F.count(F.lit(1)).over(spread)), "pair-side")
        return counted.where("_places = 1").drop("_places"), counted.where("_places > 1").drop("_places")

    def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
        return position_pairs(left, right, radius).select(F.col("unique_id").alias("business_id"), F.col("osm_id").alias("building_id"))

    left, left_spread = parted(businesses, "unique_id", "longitude", "latitude")
    right, right_spread = parted(buildings, "osm_id", "center_lon", "center_lat")
    out = pairs(left, right)
    if not left_spread.isEmpty():
        out = out.unionByName(pairs(left_spread, right.unionByName(right_spread)).distinct())
    if not right_spread.isEmpty():
        out = out.unionByName(pairs(left, right_spread).distinct())
    return out


def attach_attributes(pairs: DataFrame, businesses: DataFrame, *columns: str) -> DataFrame:
    """Left join of business columns back to pairs on the business id."""
    extra = businesses.select(F.col("unique_id").alias("business_id"), *columns)
    return pairs.join(extra, "business_id", "left")


def collapse_positions(businesses: DataFrame, *carried: str) -> DataFrame:
    """One weighted row per position and carried columns.

    Many registrations share one address point. Joining distinct positions and
    carrying the number of rows gives the same aggregates for less work, and a
    position that repeats without end no longer makes a hot cell.
    """
    return (
        businesses.where(_present("longitude", "latitude"))
        .groupBy("longitude", "latitude", *carried)
        .agg(F.count(F.lit(1)).alias("weight"))
    )


def position_key(lon: Column, lat: Column) -> Column:
    """A position as text with seven decimals, for keys and reports."""
    return F.concat_ws(",", fixed_point(lon).cast("string"), fixed_point(lat).cast("string"))
