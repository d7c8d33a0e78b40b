"""Group profiles: distinct counts, modes and sums in two combined shuffles.

A plain ``groupBy(key)`` with several distinct counts and modes keeps sets and
maps per key in memory, and a key with a third of all rows would end in one
task. Here GROUPING SETS first count per (key, value) - combined on the map
side and spread over the values - and a second, again map-side combined,
aggregation reads distinct counts and modes off these counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_with_null(col: Column | str) -> Column:
    """Number of distinct values where null counts as one value."""
    col = F.col(col) if isinstance(col, str) else col
    return F.count_distinct(col) + F.coalesce(F.max(col.isNull().cast("int")), F.lit(0))


def facet_rollup(
    df: DataFrame,
    keys: Sequence[str],
    count: str,
    distinct: Mapping[str, str] | None = None,
    modes: Mapping[str, str] | None = None,
    firsts: Mapping[str, str] | None = None,
    first_by: str | None = None,
    sums: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
    weight: Column | None = None,
) -> DataFrame:
    """One row per ``keys`` with ``count`` rows (or summed ``weight``) and profiles.

    distinct  output -> column: distinct values, null counted as one
    modes     output -> column: most frequent non-null value, smallest on a tie
    firsts    output -> column: value carried by the smallest ``first_by``
    sums, mins, maxs  output -> expression over the input rows (``sums`` are
              taken as given, so weigh them by ``weight`` if one is used)
    """
    distinct, modes, firsts = distinct or {}, modes or {}, firsts or {}
    sums, mins, maxs = sums or {}, mins or {}, maxs or {}
    facets = list(dict.fromkeys([*distinct.values(), *modes.values(), *firsts.values()]))
    rows = F.sum(weight) if weight is not None else F.count(F.lit(1))
    measures = [
        *[F.sum(e).alias(f"_s_{o}") for o, e in sums.items()],
        *[F.min(e).alias(f"_l_{o}") for o, e in mins.items()],
        *[F.max(e).alias(f"_u_{o}") for o, e in maxs.items()],
    ]
    if firsts:
        measures.append(F.min(first_by).alias("_order"))
    sets = [[*keys, facet] for facet in facets] or [list(keys)]
    # Bit i of the grouping id is 0 for the one facet that is grouped by.
    full = 2 ** len(facets) - 1
    gid = {facet: full - 2 ** (len(facets) - 1 - i) for i, facet in enumerate(facets)}
    counted = df.groupingSets(sets, *keys, *facets).agg(
        rows.alias("_n"), *measures, F.grouping_id().alias("_gid")
    )
    lead = F.col("_gid") == (gid[facets[0]] if facets else 0)

    def in_set(facet: str) -> Column:
        return F.col("_gid") == gid[facet]

    def top(facet: str, order: Column, present: Column) -> Column:
        pick = F.min(F.when(in_set(facet) & present, F.struct(order.alias("o"), F.col(facet).alias("v"))))
        return pick["v"]

    out = [F.sum(F.when(lead, F.col("_n"))).alias(count)]
    out += [F.count_if(in_set(f)).alias(o) for o, f in distinct.items()]
    out += [top(f, -F.col("_n"), F.col(f).isNotNull()).alias(o) for o, f in modes.items()]
    out += [top(f, F.col("_order"), F.lit(True)).alias(o) for o, f in firsts.items()]
    out += [F.sum(F.when(lead, F.col(f"_s_{o}"))).alias(o) for o in sums]
    out += [F.min(F.when(lead, F.col(f"_l_{o}"))).alias(o) for o in mins]
    out += [F.max(F.when(lead, F.col(f"_u_{o}"))).alias(o) for o in maxs]
    return counted.groupBy(*keys).agg(*out)


def top_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """First ``n`` rows of a total order (each task hands on at most n rows)."""
    return df.orderBy(*order).limit(n)
