"""Session defaults and the shared folder for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_SCRATCH: list[list[str]] = []


def build_session(app: str = "geoledger", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is tested under; ``conf`` wins."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.openCostInBytes": "1m",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_folder(spark: SparkSession, path: str) -> None:
    """Folder for intermediate tables of a session that does not name one in ``spark.checkpoint.dir``."""
    _FOLDERS[spark.sparkContext.applicationId] = path


def has_folder(spark: SparkSession) -> bool:
    return bool(spark.conf.get("spark.checkpoint.dir", None)) or spark.sparkContext.applicationId in _FOLDERS


def local_folder(spark: SparkSession) -> None:
    """For entry points: a session on one machine that names no folder gets one of its own; on a cluster nothing is assumed."""
    if not has_folder(spark) and spark.sparkContext.master.split("[")[0] == "local":
        use_folder(spark, tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or what :func:`use_folder` was told."""
    named = spark.conf.get("spark.checkpoint.dir", None) or _FOLDERS.get(spark.sparkContext.applicationId)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A not yet used path under the shared folder."""
    path = f"{shared_dir(spark)}/geoledger/{label}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove the intermediate tables made inside the block when it ends; write its results before that."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in _SCRATCH.pop():
            at = hadoop(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage with files that outlive any executor, and gives the
    optimizer true sizes for what follows.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
