"""Quality classification by importance resampling.

Two generative models of hashed n-grams, one of target text (documents labelled
good) and one of all raw text, give each document the log of its importance
weight: how much likelier the target model is to have written it. A sample of
k documents without replacement is drawn with those weights by adding Gumbel
noise to the logs and taking the k largest sums.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import SpanHasher, mixed, runs, text_slices, with_columns

BUCKETS = 1 << 16
LENGTH = 100  # n-grams a document's log weight is scaled to
PRIOR = 20  # n-grams of weight zero added to every document, so a few words decide little
STEP = 0.25
#: Bytes of text taken at once; n-grams hold some fifty bytes for each.
GRAM_SLICE = 1 << 19


def _kinds() -> np.ndarray:
    kinds = np.full(256, 2, np.uint8)
    kinds[[9, 10, 11, 12, 13, 32]] = 0
    kinds[128:] = 1
    for a, b in ("09", "az", "AZ"):
        kinds[ord(a) : ord(b) + 1] = 1
    return kinds


TOKEN_BYTES = _kinds()


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every unigram and bigram: runs of letters and digits, or of other signs, as written."""
    starts, ends, rows = runs(TOKEN_BYTES[data], bounds)
    one = SpanHasher(data)(starts, ends)
    same = rows[1:] == rows[:-1]
    two = mixed(one[:-1] * np.uint64(3) + one[1:])[same]
    bucket = (np.concatenate([one, two]) % np.uint64(BUCKETS)).astype(np.int64)
    return bucket, np.concatenate([rows, rows[1:][same]])


def labelled_sample(labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, good): at most about ``most`` labelled ids, those of smallest hash; the worst label of an id counts."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("good"))
    share = min(1.0, most / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def kth_largest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column without nulls, by counts of its leading bits, 16 more at a time.

    At most 65,536 counts come to the driver per step; nothing is sorted.
    """
    rows, prefix = df, None
    if k <= 0:
        return None
    for shift in (48, 32, 16, 0):
        counts = rows.groupBy(F.shiftright(column, shift).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("p")).collect()
        for r in counts:
            if k <= r["n"]:
                prefix = r["p"]
                break
            k -= r["n"]
        else:
            return None
        rows = df.where(F.shiftright(column, shift) == prefix)
    return prefix


def weights(docs: DataFrame, labels: DataFrame, most_labels: int = 100_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_key, good, n_grams, log_weight) per row; ``good`` is its label in the sample or null.

    The raw model counts all rows, the target model those labelled good among
    at most about ``most_labels`` labelled ids, a table small enough to hand to
    all tasks. Each task adds up its counts, one row per bucket, which are summed
    by bucket. The log weight is the mean log ratio over a document's n-grams,
    PRIOR neutral ones included, scaled to LENGTH n-grams, so that long documents
    don't outweigh the noise only by being long. Null and empty texts weigh 0.
    """
    sample = written(labelled_sample(labels, most_labels), "labelled")
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    known = source.join(F.broadcast(sample), "doc_id", "left")  # bounded by most_labels

    def count(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part, data, bounds in text_slices(batch, "text", GRAM_SLICE):
                bucket, row = grams(data, bounds)
                good = np.array([g == 1 for g in part.column("good").to_pylist()], bool)
                raw += np.bincount(bucket, minlength=BUCKETS)
                target += np.bincount(bucket[good[row]], minlength=BUCKETS)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    counts = known.select("text", "good").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()  # a row per bucket
    ratio = np.zeros(BUCKETS)
    if counts["target"].sum():
        raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
        raw[counts["bucket"]] += counts["raw"].to_numpy()
        target[counts["bucket"]] += counts["target"].to_numpy()
        ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    model = docs.sparkSession.sparkContext.broadcast(ratio)

    def weigh(_texts, data, bounds):
        bucket, row = grams(data, bounds)
        n = np.bincount(row, minlength=len(bounds) - 1)
        total = np.bincount(row, weights=model.value[bucket], minlength=len(bounds) - 1)
        return pa.array(n), pa.array(LENGTH * total / (n + PRIOR))

    keyed = known.withColumn("row_key", F.xxhash64("doc_id", "text"))
    return with_columns(keyed, "text", "n_grams long, log_weight double", weigh, GRAM_SLICE).drop("text")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7, most_labels: int = 100_000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, row_key, n_grams, log_weight, score, kept) per row; kept are the k largest scores, log weight plus Gumbel noise.

    Without ``k`` its value comes from the labels: the number of documents whose
    log weight is at least the one that best parts good from bad labelled rows.
    Without labels of both kinds all rows are kept. The noise is drawn from
    the seed and a hash of the row, so a rerun draws the same sample. Rows tied
    at the k-th score (to nine decimals), such as repeated ones, are all kept.
    """
    rows = written(weights(docs, labels, most_labels, doc_id, text), "weights")
    unit = (F.shiftrightunsigned(F.xxhash64("row_key", F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    scored = rows.withColumn("score", F.col("log_weight") - F.log(-F.log(unit)))
    if k is None:
        cut = parting_weight(rows)
        k = rows.count() if cut is None else rows.where(F.col("log_weight") >= cut).count()
    ranked = scored.withColumn("rank", F.round(F.col("score") * 1e9).cast("long"))
    floor = kth_largest(ranked, "rank", min(k, rows.count()))
    kept = F.lit(False) if floor is None else F.col("rank") >= floor
    return ranked.withColumn("kept", kept).select("doc_id", "row_key", "n_grams", "log_weight", "score", "kept")


def parting_weight(rows: DataFrame) -> float | None:
    """Log weight at which the share of good labelled rows kept most exceeds that of bad ones, in steps of STEP; None without both kinds."""
    spot = F.greatest(F.lit(-4000.0), F.least(F.lit(4000.0), F.col("log_weight") / STEP))
    table = rows.where("good is not null").groupBy(F.floor(spot).alias("b")).agg(
        F.sum((F.col("good") == 1).cast("long")).alias("good"), F.sum((F.col("good") != 1).cast("long")).alias("bad")
    ).orderBy("b").collect()  # at most 8,001 rows
    good, bad = np.array([r["good"] for r in table], float), np.array([r["bad"] for r in table], float)
    if not good.sum() or not bad.sum():
        return None
    gain = np.cumsum(bad) / bad.sum() - np.cumsum(good) / good.sum()  # if all up to here are dropped
    best = int(np.argmax(gain >= gain.max() - 0.002))
    return None if gain.max() <= 0 else (table[best]["b"] + 1) * STEP
