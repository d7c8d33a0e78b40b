"""New registration and map files folded into tables by file streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import measures as M
from ..operators.upsert import latest_per_key
from ..sources.footprints import DOCUMENT, buildings_from_elements
from ..sources.registrations import CSV_OPTIONS, RAW_SCHEMA, clean_registrations, without_null_tokens

VERSION = "data_as_of"  # raw column that dates a record


def _store_batches(stream: DataFrame, table_dir: str, checkpoint: str) -> None:
    """Take up all files not seen so far, then stop.

    Every micro-batch is written to its own ``batch_id`` partition; a batch that
    is run again after a failure overwrites that partition, so no row is lost or
    doubled.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{table_dir}/batch_id={batch_id}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _settled(spark: SparkSession, table_dir: str, fields: StructType, key: str, *newest: Column) -> DataFrame:
    """The version of every key that holds: by ``newest``, then by batch (a compacted base is oldest), then by content."""
    rows = spark.read.schema(StructType([*fields, StructField("batch_id", StringType())])).parquet(table_dir)
    order = [*newest, F.col("batch_id").try_cast("bigint").desc_nulls_last(), F.xxhash64(*fields.fieldNames())]
    return latest_per_key(rows, [key], *order).drop("batch_id")


def incremental_ingest(spark: SparkSession, in_dir: str, table_dir: str, checkpoint: str) -> None:
    """Clean the registration files not seen so far and add their rows to the table.

    All rows are kept, wherever they lie: :func:`current_businesses` settles
    which version of a record holds, whatever order the files came in, and only
    then looks at places.
    """
    raw = spark.readStream.schema(RAW_SCHEMA).options(**{**CSV_OPTIONS, "enforceSchema": "true"}).csv(in_dir)
    _store_batches(clean_registrations(without_null_tokens(raw), None, keep=[VERSION]), table_dir, checkpoint)


def _all_businesses(spark: SparkSession, table_dir: str) -> DataFrame:
    fields = clean_registrations(spark.createDataFrame([], RAW_SCHEMA), keep=[VERSION]).schema
    return _settled(spark, table_dir, fields, "unique_id", F.desc(VERSION))


def current_businesses(spark: SparkSession, table_dir: str, box=M.SF_BOX) -> DataFrame:
    """The latest version of every registration, if it lies in ``box`` (None: anywhere or nowhere)."""
    return _all_businesses(spark, table_dir).where(M.in_box(F.col("longitude"), F.col("latitude"), box))


def compact(spark: SparkSession, table_dir: str, new_dir: str) -> None:
    """Write the current rows as the base of a fresh table folder, under a name no batch number can take."""
    _all_businesses(spark, table_dir).write.option("compression", "zstd").parquet(f"{new_dir}/batch_id=base")


def incremental_footprints(spark: SparkSession, in_dir: str, table_dir: str, checkpoint: str, reference_year: int = 2024) -> None:
    """Add the footprints of the map files not seen so far (one document per line) to the table."""
    elements = spark.readStream.schema(DOCUMENT).json(in_dir).select(F.inline("elements"))
    _store_batches(buildings_from_elements(elements, reference_year), table_dir, checkpoint)


def current_buildings(spark: SparkSession, table_dir: str) -> DataFrame:
    """The latest version of every footprint: by version number, then by the time it was modified."""
    fields = buildings_from_elements(spark.createDataFrame([], DOCUMENT).select(F.inline("elements"))).schema
    return _settled(spark, table_dir, fields, "osm_id", F.desc("version"), F.desc("last_modified"))
