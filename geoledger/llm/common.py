"""Helpers shared by the operators: table reads, Arrow text buffers, word hashes, bounded bit filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import connected  # noqa: F401 - for the operators here

SLICE_BYTES = 1 << 21
MAX_FILTER_BITS = 1 << 27
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Named columns of one of the test tables."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def row_slices(lengths: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) whose lengths add up to about ``limit``; a longer row stands alone."""
    lo, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows in one array, and the n + 1 row bounds in it. A null is empty."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if texts.null_count:
        texts = texts.fill_null("" if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, bounds, data = texts.buffers()
    offsets = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into row ranges of bounded text: (rows, bytes, row bounds)."""
    if not batch.num_rows:
        return
    _, bounds = text_buffer(batch.column(column))
    for lo, hi in row_slices(np.diff(bounds), limit):
        part = batch.slice(lo, hi - lo)
        data, at = text_buffer(part.column(column))
        yield part, data, at


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _powers(kind: str, n: int) -> np.ndarray:
    have = _POWERS[kind]
    if len(have) < n:
        step = _BASE if kind == "up" else _BASE_INVERSE
        grown = np.full(max(n, SLICE_BYTES + 1), step, np.uint64)
        grown[0] = 1
        _POWERS[kind] = have = np.multiply.accumulate(grown)
    return have[:n]


class SpanHasher:
    """Hash of any byte span of one buffer from prefix sums: equal spans, equal hashes."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers("up", len(data)), out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        low = _powers("down", len(self.sums))
        return mixed((self.sums[ends] - self.sums[starts]) * low[starts] + (ends - starts).astype(np.uint64))


def runs(kinds: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of one non-zero kind inside rows: starts, ends, row of each."""
    if not len(kinds):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    change = np.empty(len(kinds), bool)
    change[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=change[1:])
    inner = bounds[(bounds > 0) & (bounds < len(kinds))]
    change[inner] = True
    edges = np.flatnonzero(change)
    ends = np.append(edges[1:], len(kinds))
    keep = kinds[edges] != 0
    starts, ends = edges[keep], ends[keep]
    return starts, ends, np.searchsorted(bounds, starts, side="right") - 1


def filter_words(hashes: DataFrame, column: str, expected: int, bits_each: int = 16) -> tuple[np.ndarray, int]:
    """Bit filter over a column of 64-bit hashes, of at most MAX_FILTER_BITS bits.

    ``bits_each`` bits per expected hash, two of them set for each. The size never
    passes 16 MB, however many hashes there are; a full filter lets more false
    candidates through and never drops a true one.
    """
    bits = 1 << 16
    while bits < min(MAX_FILTER_BITS, bits_each * max(1, expected)):
        bits *= 2
    h = F.col(column)
    spots = F.array(h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1))
    rows = (
        hashes.select(F.explode(spots).alias("spot"))
        .select(F.shiftright("spot", 6).alias("word"), F.expr("shiftleft(1L, cast(spot & 63 as int))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    )
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return words, bits


def in_filter(words: np.ndarray, bits: int, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    mask, six, low = np.uint64(bits - 1), np.uint64(6), np.uint64(63)

    def lit(spot: np.ndarray) -> np.ndarray:
        return (words[spot >> six] >> (spot & low)) & np.uint64(1) == 1

    found = lit(hashes & mask)
    at = np.flatnonzero(found)
    found[at] = lit((hashes[at] >> np.uint64(32)) & mask)
    return found


def with_columns(df: DataFrame, column: str, fields: str, make, limit: int = SLICE_BYTES, per_task: bool = False) -> DataFrame:
    """Every row of ``df`` with new columns made from one text column, Arrow batch by batch.

    With ``per_task``, ``make`` takes no arguments and returns the function for
    one task; what that holds is let go when the task ends.

    ``make(texts, data, bounds)`` gets rows of about ``limit`` bytes of text (an
    Arrow array, its bytes, the row bounds in them) and returns one array per
    field of the DDL string ``fields``. Columns of these names are replaced.
    """
    added = df.sparkSession.createDataFrame([], fields).schema
    kept = df.select(*[c for c in df.columns if c not in added.fieldNames()])
    schema = type(added)(kept.schema.fields + added.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = make() if per_task else make
        for batch in batches:
            for part, data, bounds in text_slices(batch, column, limit):
                made = values(part.column(column), data, bounds)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *[m if isinstance(m, pa.Array) else pa.array(m) for m in made]],
                    names=[*part.schema.names, *added.fieldNames()],
                )

    return kept.mapInArrow(run, schema)
