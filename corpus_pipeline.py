"""A corpus from raw documents to tokens: five stages, each a training-data operator over all its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages
the rows are written as Parquet to the shared folder and read again, so a lost
executor costs one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoledger.llm import chunk_bpe, importance, queries, simhash_bk, spaced_seeds, surrogates
from geoledger.llm.common import table
from geoledger.session import fresh_path, local_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """A key per distinct (doc_id, text), as the operators name rows."""
    return docs.withColumn("row_key", F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the importance sample; its size follows from the labels, so what the classifier rejects goes."""
    rejected = importance.resample(docs, table(spark, sf_dir, "labels", "doc_id", "quality")).where("not kept").select("row_key").distinct()
    return _keyed(docs).join(rejected, "row_key", "left_anti").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document per group of texts whose five-word shingles are alike at 0.8 or more: the smallest doc_id, once."""
    groups = simhash_bk.near_groups(docs)
    dropped = groups.where("row_key <> best_key").select("row_key").distinct()
    kept = _keyed(docs).join(dropped, "row_key", "left_anti")
    if groups.groupBy("row_key").count().where("count > 1").isEmpty():
        return kept.select(*docs.columns)
    return kept.dropDuplicates(["row_key"]).select(*docs.columns)  # rows that repeat (doc_id, text)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without an overlap with a benchmark item."""
    leaked = spaced_seeds.overlaps(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).select("row_key").distinct()
    return _keyed(docs).join(leaked, "row_key", "left_anti").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data; n_chars counts the new text."""
    changed = surrogates.replaced(docs, queries.SURROGATE_KEY)
    return changed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their tokens: n_tokens, the ids' digest and that of the text they decode to."""
    encoded = chunk_bpe.encode_and_decode(docs.select(*COLUMNS), queries.vocabulary())
    return chunk_bpe.digests(encoded)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(run: Stage) -> Stage:
    def prepared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        local_folder(spark)
        return run(spark, docs, sf_dir)

    return prepared


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", _stage(quality_classifier)),
    ("SimHash near-dedup", _stage(near_dedup)),
    ("benchmark decontamination", _stage(decontamination)),
    ("PII", _stage(pii)),
    ("BPE encoding and decoding", _stage(bpe)),
]

#: Fingerprints, seeds, keyed surrogates and BPE have no SQL; the tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    local_folder(spark)
    docs = table(spark, sf_dir, "documents", *COLUMNS)
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name.split()[0].lower()}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
