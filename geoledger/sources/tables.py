"""Parquet tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession


def scan(spark: SparkSession, path: str, *columns: str, **renamed: str) -> DataFrame:
    """Parquet read of named columns; ``renamed`` maps new names to columns."""
    df = spark.read.parquet(path)
    if not columns and not renamed:
        return df
    return df.select(*columns, *[df[old].alias(new) for new, old in renamed.items()])


def spread(df: DataFrame, rows_per_task: int = 10_000) -> DataFrame:
    """Rows dealt evenly over tasks of about ``rows_per_task``, for work that costs far more than reading.

    A row group of a file is read by one task, and thin rows go by the million
    into one, so a small file would leave all the work that follows to few tasks.
    """
    tasks = math.ceil(df.count() / rows_per_task)
    return df.repartition(tasks) if tasks > 1 else df
