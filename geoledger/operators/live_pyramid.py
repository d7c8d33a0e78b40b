"""A stored zoom pyramid that follows changed rows instead of being built again.

Per cell the store keeps aggregates that can take rows back: a count per code
and per start date, exact coordinate sums, and the row with the smallest id.
Only that last one can't be taken back; a cell that loses it looks it up among
the current rows, which for a cell of n rows happens to one removal in n.
Cells are dealt to shards by hash; an update reads and writes the shards of the
cells it touches.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import measures as M
from ..session import written
from .aggregates import centre_sums, with_mean_position
from .pyramid import CLUSTER_ZOOMS, HEX_ZOOMS, _LEVEL_COLUMNS

SHARDS = 64
_CELL = ["zoom_level", "cell_x", "cell_y"]
_FACET = [*_CELL, "kind", "code", "day"]
_SUMS = ("_sum_lon", "_sum_lat", "_o_lon", "_o_lat", "_q_lon", "_q_lat")


def _is_hex() -> Column:
    return F.col("zoom_level") <= HEX_ZOOMS[1]


def _celled(rows: DataFrame, box: Sequence[float] | None, lowest: int = HEX_ZOOMS[0]) -> DataFrame:
    """Located rows once per zoom level from ``lowest`` on, with size and cell."""
    lon, lat = F.col("longitude"), F.col("latitude")
    sizes = {**{z: M.hex_size(z) for z in range(HEX_ZOOMS[0], HEX_ZOOMS[1] + 1)}, **{z: M.cluster_size(z) for z in range(CLUSTER_ZOOMS[0], CLUSTER_ZOOMS[1] + 1)}}
    levels = F.array(*[F.struct(F.lit(z).alias("zoom_level"), F.lit(s).alias("cell_size")) for z, s in sizes.items() if z >= lowest])
    size = F.col("cell_size")
    return rows.where(lon.isNotNull() & lat.isNotNull() & M.in_box(lon, lat, box)).select("*", F.inline(levels)).withColumns({
        "cell_x": F.when(_is_hex(), M.hex_q(lon, lat, size)).otherwise(M.round_cell(lon, size)),
        "cell_y": F.when(_is_hex(), M.hex_r(lat, size)).otherwise(M.round_cell(lat, size)),
    })


def signed_facets(rows: DataFrame, box: Sequence[float] | None) -> DataFrame:
    """Signed rows as changes of the stored aggregates: totals, counts per code, and per start date from CLUSTER_ZOOMS on.

    Rows of a position are folded before they go to the cells of all levels, and
    counts are kept apart from totals: only a total carries sums and first rows.
    ``rows`` are read three times, so write them out if they are costly.
    """
    at, sign = ["longitude", "latitude"], F.col("sign")
    who = F.struct(F.col("unique_id").alias("id"), F.col("naics_description").alias("says"))
    day = F.col("business_start_date").cast("timestamp_ntz")
    weight = F.sum(sign).cast("long").alias("_w")
    places = rows.groupBy(*at).agg(weight, F.min(F.when(sign > 0, who)).alias("added"), F.min(F.when(sign < 0, F.col("unique_id"))).alias("removed"))
    offsets = {
        axis: F.when(~_is_hex(), M.fixed_point(F.col(c)) - M.fixed_point(F.col(g) * F.col("cell_size"))).otherwise(0)
        for axis, c, g in (("lon", "longitude", "cell_x"), ("lat", "latitude", "cell_y"))
    }
    w = F.col("_w")
    sums = {
        **centre_sums("longitude", "latitude", w),
        **{f"_o_{a}": (o * w).cast("decimal(20,0)") for a, o in offsets.items()}, **{f"_q_{a}": (o * o * w).cast("decimal(20,0)") for a, o in offsets.items()},
    }
    no_code, no_day = F.lit(None).cast(rows.schema["naics_code"].dataType), F.lit(None).cast("timestamp_ntz")
    n = F.sum("_w").cast("long").alias("n")
    total = _celled(places, box).groupBy(*_CELL).agg(
        n, *[F.sum(v).cast("decimal(38,0)").alias(k) for k, v in sums.items()], F.min("added").alias("added"), F.min("removed").alias("removed"),
    ).withColumns({"kind": F.lit("total"), "code": no_code, "day": no_day})
    codes = _celled(rows.groupBy(*at, F.col("naics_code").alias("code")).agg(weight), box)
    days = _celled(rows.groupBy(*at, day.alias("day")).agg(weight), box, CLUSTER_ZOOMS[0])
    code = codes.groupBy(*_CELL, "code").agg(n).withColumns({"kind": F.lit("code"), "day": no_day})
    dated = days.groupBy(*_CELL, "day").agg(n).withColumns({"kind": F.lit("day"), "code": no_code})
    return total.unionByName(code.unionByName(dated), allowMissingColumns=True).select(*_FACET, "n", *_SUMS, "added", "removed")


class LivePyramid:
    """The store: ``facets/v=N/shard=S`` files, and for each version where every shard's newest file lies."""

    def __init__(self, spark: SparkSession, folder: str, box: Sequence[float] | None = M.SF_BOX, shards: int = SHARDS) -> None:
        self.spark, self.folder, self.box, self.shards = spark, folder, box, shards

    def _where(self, version: int) -> dict[int, int]:
        """Shard to the version that wrote it; at most ``shards`` numbers."""
        return {} if version < 0 else {r["shard"]: r["v"] for r in self.spark.read.parquet(f"{self.folder}/manifest/{version}").collect()}

    def _facets(self, where: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.folder}/facets/v={v}/shard={s}" for s, v in sorted(where.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def update(self, version: int, changes: DataFrame, current: DataFrame) -> int:
        """Take in signed rows as the next ``version`` and return how many shards were read.

        ``current`` are the rows after the change; they are looked at only for
        cells whose first row was taken away. Running a version again gives the
        same store.
        """
        shard = F.pmod(F.xxhash64(*_CELL), F.lit(self.shards)).cast("int")
        delta = written(signed_facets(changes, self.box).withColumn("shard", shard), "pyramid-changes")
        touched = [r["shard"] for r in delta.select("shard").distinct().collect()]  # at most ``shards`` numbers
        where = self._where(version - 1)
        before = self._facets({s: where[s] for s in touched if s in where})
        nothing = F.lit(None).cast(delta.schema["added"].dataType)
        fresh = delta.withColumn("first", nothing)
        if before is not None:
            old = before.withColumns({"added": nothing, "removed": F.lit(None).cast(delta.schema["removed"].dataType), "shard": shard})
            fresh = fresh.unionByName(old)
        # one shuffle by shard serves the sums and the files; counts are summed apart from totals, which alone carry first rows
        fresh = fresh.repartition(self.shards, "shard")
        gone = F.col("removed") == F.col("first.id")
        back = F.col("added").isNotNull() & (F.col("added.id") <= F.col("first.id"))
        totals = written(fresh.where("kind = 'total'").groupBy(*_FACET, "shard").agg(
            F.sum("n").alias("n"), *[F.sum(s).cast("decimal(38,0)").alias(s) for s in _SUMS],
            F.min("first").alias("first"), F.min("added").alias("added"), F.min("removed").alias("removed"),
        ).where("n > 0").withColumn("lost", F.coalesce(gone & ~back, F.lit(False))).withColumn(
            "first", F.when(gone, F.col("added")).otherwise(F.least("first", "added")),
        ).drop("added", "removed"), "pyramid-totals")
        counts = fresh.where("kind <> 'total'").groupBy(*_FACET, "shard").agg(F.sum("n").alias("n")).where("n > 0")
        lost = totals.where("lost").select(*_CELL)
        if not lost.isEmpty():
            found = _celled(current, self.box).join(lost, _CELL, "left_semi").groupBy(*_CELL).agg(
                F.min(F.struct(F.col("unique_id").alias("id"), F.col("naics_description").alias("says"))).alias("_found")
            )
            totals = totals.join(found, _CELL, "left").withColumn("first", F.when(F.col("lost"), F.col("_found")).otherwise(F.col("first"))).drop("_found")
        path = f"{self.folder}/facets/v={version}"
        merged = totals.drop("lost").unionByName(counts, allowMissingColumns=True)
        merged.write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(path)
        written_now = {r["shard"] for r in self.spark.read.parquet(path).select("shard").distinct().collect()} if touched else set()
        now = {**{s: v for s, v in where.items() if s not in touched}, **{s: version for s in written_now}}
        places = self.spark.createDataFrame(list(now.items()), "shard int, v int")
        places.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/{version}")
        return len(set(touched) & set(where))

    def levels(self, version: int) -> DataFrame:
        """The pyramid in the columns of :func:`.pyramid.zoom_pyramid`."""
        facets = self._facets(self._where(version))
        if facets is None:
            raise ValueError(f"version {version} has no cells")
        total, code, day = (facets.where(F.col("kind") == k) for k in ("total", "code", "day"))
        top = F.min(F.when(F.col("code").isNotNull(), F.struct((-F.col("n")).alias("rank"), F.col("code").alias("code"))))
        types = code.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("business_types"), top.alias("top"))
        dates = day.groupBy(*_CELL).agg(F.min("day").alias("oldest_business"), F.max("day").alias("newest_business"))
        # a cell has one total, a code (or none) of each of its rows, and dates from CLUSTER_ZOOMS on
        cells = total.select(*_CELL, F.col("n").alias("business_count"), *_SUMS, "first").join(types, _CELL, "left").join(dates, _CELL, "left")
        n = F.col("business_count").cast("double")

        def deviation(axis: str) -> Column:
            total_, squares = F.col(f"_o_{axis}").cast("double"), F.col(f"_q_{axis}").cast("double")
            return F.when(n > 1, F.sqrt(F.greatest((squares - total_ * total_ / n) / (n - 1), F.lit(0.0))) / F.lit(float(M.COORDINATE_SCALE)))

        spread = F.coalesce(deviation("lon"), F.lit(0.0)) + F.coalesce(deviation("lat"), F.lit(0.0))
        size = F.when(_is_hex(), F.lit(M.hex_size(1)) / F.pow(F.lit(2.0), F.col("zoom_level") - 1)).otherwise(F.lit(0.001) * (15 - F.col("zoom_level")) / 10)
        return with_mean_position(cells, "business_count").select(
            "zoom_level", F.when(_is_hex(), "hexagonal").otherwise("statistical").alias("aggregation_type"), size.alias("cell_size"), "cell_x", "cell_y",
            "business_count", "business_types", F.col("first.says").alias("primary_naics"), "center_lon", "center_lat",
            F.when(~_is_hex(), F.col("top.code")).alias("dominant_naics"), F.when(~_is_hex(), spread).alias("spatial_variance"), "oldest_business", "newest_business",
        ).select(*_LEVEL_COLUMNS)
