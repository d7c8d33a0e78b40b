"""Newest version of every key of a stream, its changes, and a table that follows them.

The table is the state: a batch is settled against the stored versions by a
shuffle on the key, which sorts and spills, so no executor holds rows or keys
in memory as Spark's state store would. Rows of a batch are ranked on the map
side first, so a key that repeats without end costs one row per task. A batch
stores the keys whose newest version arrived in it; late, older rows change
nothing. The table is a base snapshot by buckets of the key plus the changes
since, so reading it ranks only changes, and the rows a batch replaces come
from the buckets it touches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.upsert import latest_per_key
from ..sources.registrations import CSV_OPTIONS, RAW_SCHEMA, clean_registrations, without_null_tokens
from .ingest import VERSION

BUCKETS = 64

#: Stored changes whose keys may be copied to all tasks; more are shuffled, as the size of files says little of that of keys in memory.
COPIED = 100_000


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def newest_changes(rows: DataFrame, key: str, version: Column, *more: Column) -> DataFrame:
    """A stream of rows with what :meth:`KeyedTable.follow` settles them by, as ``_version``; rows stay as they are.

    Newest of a ``key`` is the largest ``version`` (null is oldest), then
    ``more``, then the later batch, then content.
    """
    return rows.withColumn("_version", F.struct(version.alias("version"), *[c.alias(f"more{i}") for i, c in enumerate(more)]))


class KeyedTable:
    """A folder with the newest row of every key: ``changes`` by batch, and ``base`` snapshots by the batch they go up to."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder, schema, key, buckets

    def _stored(self, kind: str, partition: str, *more: StructField) -> DataFrame:
        fields = StructType([*self.schema.fields, *more, StructField(partition, LongType()), StructField("_bucket", IntegerType())])
        path = f"{self.folder}/{kind}"
        return self.spark.read.schema(fields).parquet(path) if _exists(self.spark, path) else self.spark.createDataFrame([], fields)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").option("compression", "zstd").parquet(path)

    def _versions(self, upto: int, version: StructField) -> DataFrame:
        """Key and version of all that is stored up to a batch; a key may have several, its newest among them."""
        base = self._base_at(upto)
        kept = self._stored("base", "upto", version).where(F.col("upto") == base)
        columns = [self.key, version.name, "_bucket"]
        return kept.select(*columns).unionByName(self._since(base, upto, version).select(*columns))

    def follow(self, changed: DataFrame, checkpoint: str) -> None:
        """Run a stream of :func:`newest_changes` over what is new, then stop. A batch that runs again overwrites what it wrote.

        A batch meets the versions stored before it, so running it again finds
        the same ones.
        """
        names, version = self.schema.fieldNames(), changed.schema["_version"]

        def store(batch: DataFrame, batch_id: int) -> None:
            arrived = self._bucketed(batch.select(*names, version.name)).withColumn("_new", F.lit(True))
            known = self._versions(batch_id - 1, version).withColumn("_new", F.lit(False))
            order = [F.desc(version.name), F.desc("_new"), F.xxhash64(*names), *[F.desc(c) for c in names]]
            settled = latest_per_key(arrived.unionByName(known, allowMissingColumns=True), ["_bucket", self.key], *order)
            self._write(settled.where("_new").drop("_new"), f"{self.folder}/changes/batch_id={batch_id}")

        changed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def _since(self, after: int, upto: int | None, *more: StructField) -> DataFrame:
        stored = self._stored("changes", "batch_id", *more).where(F.col("batch_id") > after)
        return stored if upto is None else stored.where(F.col("batch_id") <= upto)

    def changes(self, after: int = -1, upto: int | None = None, *more: StructField) -> DataFrame:
        """Newest change per key of the batches after ``after`` up to ``upto``, with ``batch_id``."""
        return latest_per_key(self._since(after, upto, *more), [self.key], F.desc("batch_id"))

    def last_batch(self) -> int:
        return self._stored("changes", "batch_id").agg(F.coalesce(F.max("batch_id"), F.lit(-1))).first()[0]

    def _base_at(self, upto: int | None) -> int:
        bases = self._stored("base", "upto").select("upto")
        return (bases if upto is None else bases.where(F.col("upto") <= upto)).agg(F.coalesce(F.max("upto"), F.lit(-1))).first()[0]

    def _rows(self, upto: int | None = None, *more: StructField) -> DataFrame:
        base = self._base_at(upto)
        changed = self.changes(base, upto, *more).drop("batch_id")
        kept = self._stored("base", "upto", *more).where(F.col("upto") == base).drop("upto")
        replaced = changed.select(self.key, "_bucket")
        if self._since(base, upto).count() > COPIED:
            replaced = replaced.hint("merge")
        same = [F.col("_b._bucket") == F.col("_c._bucket"), F.col(f"_b.{self.key}").eqNullSafe(F.col(f"_c.{self.key}"))]
        return kept.alias("_b").join(replaced.alias("_c"), same, "left_anti").unionByName(changed)

    def rows(self, upto: int | None = None) -> DataFrame:
        """The newest row of every key, as of batch ``upto`` (all batches, if none)."""
        return self._rows(upto).drop("_bucket")

    def fold(self) -> None:
        """Write the rows of now as the next base; changes up to it are read no more."""
        last = self.last_batch()
        if last > self._base_at(None):
            version = self.spark.read.parquet(f"{self.folder}/changes").schema["_version"]
            self._write(self._rows(last, version), f"{self.folder}/base/upto={last}")

    def signed_changes(self, batch: int) -> DataFrame:
        """What a batch took back (``sign`` -1) and brought (``sign`` 1), rows that stay the same left out.

        The old rows are looked up in the buckets that the batch touches: the
        bucket is part of the join, so Spark prunes the other folders.
        """
        new = self._stored("changes", "batch_id").where(F.col("batch_id") == batch).drop("batch_id")  # one row a key, as the stream groups by it
        names = self.schema.fieldNames()
        pairs = new.select(F.struct(*names).alias("new"), F.col(self.key).alias("_key"), "_bucket").join(
            self._rows(batch - 1).select(F.struct(*names).alias("old"), F.col(self.key).alias("_old_key"), F.col("_bucket").alias("_old_bucket")).hint("merge"),
            (F.col("_bucket") == F.col("_old_bucket")) & F.col("_key").eqNullSafe(F.col("_old_key")), "left",
        ).where(~F.col("new").eqNullSafe(F.col("old")))
        sides = F.array(F.struct(F.lit(-1).alias("sign"), F.col("old").alias("row")), F.struct(F.lit(1).alias("sign"), F.col("new").alias("row")))
        return pairs.select(F.inline(sides)).where("row is not null").select("row.*", "sign")


def registrations_table(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> KeyedTable:
    schema = clean_registrations(spark.createDataFrame([], RAW_SCHEMA), None, keep=[VERSION]).schema
    return KeyedTable(spark, folder, schema, "unique_id", buckets)


def ingest_changes(table: KeyedTable, in_dir: str, checkpoint: str) -> None:
    """Take up the registration files not seen so far: clean them, settle them by key and record, store what changed."""
    raw = table.spark.readStream.schema(RAW_SCHEMA).options(**{**CSV_OPTIONS, "enforceSchema": "true"}).csv(in_dir)
    rows = clean_registrations(without_null_tokens(raw), None, keep=[VERSION])
    table.follow(newest_changes(rows, table.key, F.col(VERSION)), checkpoint)
