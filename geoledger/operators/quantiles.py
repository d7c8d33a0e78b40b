"""Exact quantiles without sorting the table or gathering it in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

BUCKETS = 65_536
SKETCH = 4096
SHARDS = 256  # sketches that are merged per column in the end, however many tasks there are


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Rows (column, probability, value) with linear interpolation between neighbours.

    A bounded sketch, merged in two levels, brackets every wanted rank within a few ten-thousandths of
    the rows, wherever far outliers lie. A histogram over the bracket (BUCKETS
    rows, and one for all that is below or above) tells which bucket holds the
    rank, and only the distinct values of that bucket are counted and ranked.
    The sketch only decides how much is left to rank: the result is exact even
    if a rank should fall outside its bracket. The table is read three times,
    all columns together.
    """
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns])
    long = df.select(F.inline(entries)).where(F.col("x").isNotNull())
    margin = 0.003  # several times the error of a sketch of this size
    marks = F.array(*[F.lit(m) for p in probabilities for m in (max(0.0, p - margin), min(1.0, p + margin))])
    shard = F.pmod(F.spark_partition_id(), F.lit(SHARDS))
    parts = long.withColumn("shard", shard).groupBy("column", "shard").agg(
        F.count("x").alias("n"), F.kll_sketch_agg_double("x", F.lit(SKETCH)).alias("s")
    )
    # written, as a sketch drawn again would give other brackets; a row per column
    sketch = written(parts.groupBy("column").agg(
        F.sum("n").alias("total"), F.kll_sketch_get_quantile_double(F.kll_merge_agg_double("s", F.lit(SKETCH)), marks).alias("marks")
    ), "brackets")
    brackets = F.array(*[
        F.struct(F.lit(float(p)).alias("probability"), F.col("marks")[2 * i].alias("lo"), F.col("marks")[2 * i + 1].alias("hi"))
        for i, p in enumerate(probabilities)
    ])
    ranges = F.broadcast(sketch.select("column", "total", F.inline(brackets)))  # one row per column and probability
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    inner = F.when(hi > lo, F.least(F.lit(BUCKETS - 1), F.floor((x - lo) / (hi - lo) * BUCKETS))).otherwise(0)
    bucket = F.when(x < lo, -1).when(x > hi, BUCKETS).otherwise(inner).cast("int")
    placed = long.join(ranges, "column").select("column", "probability", bucket.alias("bucket"), "x", "total")
    histogram = placed.groupBy("column", "probability", "bucket", "total").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("column", "probability").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = histogram.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    h = (F.col("total") - 1) * F.col("probability")
    homes = (
        starts.withColumn("h", h)
        .select("*", F.explode(F.array(F.floor("h"), F.ceil("h"))).alias("k"))
        .where((F.col("k") >= F.col("start")) & (F.col("k") < F.col("start") + F.col("n")))
        .groupBy("column", "probability", "bucket", "start", "h")
        .agg(F.min("k").alias("k1"), F.max("k").alias("k2"))
    )  # at most two buckets per column and probability
    keys = ["column", "probability", "bucket"]
    values = placed.join(F.broadcast(homes), keys).groupBy(*keys, "start", "h", "k1", "k2", "x").agg(
        F.count(F.lit(1)).alias("n")
    )
    inside = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("start") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    ranked = values.withColumn("first", first)

    def holds(k: str) -> Column:
        return (F.col(k) >= F.col("first")) & (F.col(k) < F.col("first") + F.col("n"))

    hits = ranked.where(holds("k1") | holds("k2"))
    return hits.groupBy("column", "probability", "h").agg(F.min("x").alias("low"), F.max("x").alias("high")).select(
        "column", "probability",
        (F.col("low") + (F.col("high") - F.col("low")) * (F.col("h") - F.floor("h"))).alias("value"),
    )
