"""Versions of a keyed table with a tree of digests: what changed between two of them, reading only where they differ.

A row's place is the hash of its key; the first DEPTH steps of BITS bits name
its leaf. A node's digest adds up those of its rows, so every level is a sum of
the one below. Two versions are compared from the root down, and only branches
that differ are opened; of the rows, only differing leaves are read.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BITS = 4
DEPTH = 3
_NODES = "node int, n long, d1 decimal(38,0), d2 decimal(38,0), level int"


def _digests(columns: Sequence[str]) -> list[Column]:
    """Two hashes of a row, nulls told apart, as numbers whose sums can't overflow."""
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    return [F.xxhash64(F.lit(salt), nulls, *columns).cast("decimal(38,0)") for salt in (1, 2)]


def _node(level: int) -> Column:
    """The node of a leaf number at a level; 0 is the root."""
    return F.shiftrightunsigned("leaf", BITS * (DEPTH - level))


def write_version(df: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str] | None = None) -> None:
    """Write ``df`` under ``path``: ``rows`` by branch and sorted by leaf, and ``nodes``, the digests of all levels.

    ``columns`` are those that count as content (all, if none are named); keys
    always do. A key may repeat, and may be null.
    """
    content = list(dict.fromkeys([*keys, *(columns or df.columns)]))
    nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in keys])
    leaf = F.shiftrightunsigned(F.xxhash64(nulls, *keys), 64 - BITS * DEPTH).cast("int")
    placed = df.withColumn("leaf", leaf).withColumn("branch", F.shiftrightunsigned("leaf", BITS * (DEPTH - 1)))
    df.sparkSession.createDataFrame([(placed.schema.json(),)], "schema string").write.text(f"{path}/schema")
    placed.repartitionByRange("leaf").sortWithinPartitions("branch", "leaf").write.partitionBy("branch").option("compression", "zstd").parquet(f"{path}/rows")
    first, second = _digests(content)
    leaves = _rows(df.sparkSession, path).groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(first).alias("d1"), F.sum(second).alias("d2"))  # at most 2 ** (BITS * DEPTH) rows
    every = F.array(*[F.struct(F.lit(level).alias("level"), _node(level).alias("node")) for level in range(DEPTH + 1)])
    nodes = leaves.select("n", "d1", "d2", F.inline(every)).groupBy("level", "node").agg(F.sum("n").alias("n"), F.sum("d1").alias("d1"), F.sum("d2").alias("d2"))
    nodes.coalesce(1).write.partitionBy("level").option("compression", "zstd").parquet(f"{path}/nodes")


def differing_leaves(spark: SparkSession, old: str, new: str) -> list[int]:
    """Leaves whose content differs, found from the root down; children of equal nodes are not looked at."""
    nodes = None
    for path in (old, new):
        side = spark.read.schema(_NODES).parquet(f"{path}/nodes")
        nodes = side if nodes is None else nodes.unionByName(side)
    open_nodes, what = [0], F.struct("n", "d1", "d2")
    for level in range(DEPTH + 1):
        met = nodes.where((F.col("level") == level) & F.col("node").isin(open_nodes)).groupBy("node").agg(
            F.count(F.lit(1)).alias("sides"), F.min(what).alias("low"), F.max(what).alias("high"),
        )
        found = sorted(r["node"] for r in met.where("sides < 2 or low <> high").select("node").collect())  # at most 2 ** (BITS * level) numbers
        if not found or level == DEPTH:
            return found
        open_nodes = [n << BITS | i for n in found for i in range(1 << BITS)]
    return []


def _rows(spark: SparkSession, path: str) -> DataFrame:
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()[0]))
    return spark.read.schema(schema).parquet(f"{path}/rows")


def _rows_in(spark: SparkSession, path: str, leaves: Sequence[int]) -> DataFrame:
    branches = sorted({n >> (BITS * (DEPTH - 1)) for n in leaves})
    return _rows(spark, path).where(F.col("branch").isin(branches) & F.col("leaf").isin(list(leaves)))


def version_changes(spark: SparkSession, old: str, new: str, keys: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(keys, change) of every key that was added, removed or changed from ``old`` to ``new``.

    A key that repeats is changed if its rows are not the same ones as often.
    """
    leaves = differing_leaves(spark, old, new)
    sides = []
    for path, side in ((old, "old"), (new, "new")):
        rows = _rows_in(spark, path, leaves)
        first, second = _digests(list(dict.fromkeys([*keys, *(columns or [c for c in rows.columns if c not in ("leaf", "branch")])])))
        sides.append(rows.groupBy(*keys).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(first).alias("d1"), F.sum(second).alias("d2")).alias(side)))
    a, b = sides[0].alias("a"), sides[1].alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    met = a.join(b, same, "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))
    there = F.col("new").isNotNull()
    return met.select(
        *[F.when(there, F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys],
        F.when(F.col("old").isNull(), "added").when(~there, "removed").otherwise("changed").alias("change"),
    )
