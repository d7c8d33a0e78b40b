"""Exact repeated substrings by column-wise multi-document construction.

All places that may hold a repeat of ``length`` bytes are cut out with an
anchor: the smallest hash of the 32-byte grams inside a window. Equal windows
have equal anchors at equal distances, so windows to compare meet under their
anchor's hash with the anchor in the same column. Under each hash the pieces
are documents of a small collection, built column by column from the right:
every round inserts one symbol per document in front of its suffix, which
gives the order of the longer suffixes (the column of the collection's
Burrows-Wheeler transform, sorted stably) and the common prefixes of
neighbours from those of the round before. A window is repeated if its common
prefix with a neighbour reaches ``length``. Columns are read in sequence and
no round looks back, so a collection needs one column, an order and an array
of common prefixes at a time beside the piece bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import SpanHasher, filter_words, in_filter, mixed, text_slices, with_columns

GRAM = 32
CROWD = 20_000
COLLECTION_BYTES = 24 << 20


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest value in every window, by running minima of blocks from both ends."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    square = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    back = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    low = np.minimum(back[:count], ahead[width - 1 : width - 1 + count])
    # where the minimum changes, or the last place it was found at has left the window, look for it again
    at = np.empty(count, np.int64)
    i = 0
    edges = np.append(np.flatnonzero(low[1:] != low[:-1]) + 1, count).tolist()
    for end in edges:
        while i < end:
            spot = i + int(np.argmax(values[i : i + width] == low[i]))
            stop = min(end, spot + 1)
            at[i:stop] = spot
            i = stop
    return at


def anchors(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Per run of window starts with the same anchor: row, first start, last start, anchor, its hash; bytes count from the buffer's start."""
    grams = len(data) - GRAM + 1
    width = length - GRAM + 1
    rows, firsts, lasts, spots, keys = [], [], [], [], []
    if grams > 0:
        begins = np.arange(grams)
        hashes = SpanHasher(data)(begins, begins + GRAM)
        for row, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            if b - a < length:
                continue
            at = window_minima(hashes[a : b - GRAM + 1], width)
            cut = np.flatnonzero(at[1:] != at[:-1]) + 1
            first, last = np.append(0, cut), np.append(cut - 1, len(at) - 1)
            rows.append(np.full(len(first), row))
            firsts.append(first + a)
            lasts.append(last + a)
            spots.append(at[first] + a)
            keys.append(hashes[at[first] + a])
    if not rows:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty, np.empty(0, np.uint64)
    return tuple(np.concatenate(x) for x in (rows, firsts, lasts, spots, keys))


def repeated_starts(pieces: list[bytes], anchor_at: np.ndarray, groups: np.ndarray, length: int) -> list[np.ndarray]:
    """For each piece, which of its first len - length + 1 starts begin a window that another piece of its group has too.

    ``anchor_at`` is where the anchor lies in each piece; windows are compared
    only where they lie alike around it. ``groups`` must be sorted.
    """
    m = len(pieces)
    sizes = np.fromiter(map(len, pieces), np.int64, m)
    shift = anchor_at.max() - anchor_at
    width = int((shift + sizes).max())
    columns = np.full((width, m), -1, np.int16)
    for i, p in enumerate(pieces):
        columns[shift[i] : shift[i] + sizes[i], i] = np.frombuffer(p, np.uint8)
    groups = groups.astype(np.int64)
    order = np.arange(m)
    prefix = np.zeros(m + 1, np.int32)  # common prefix of each suffix with the one before it in order
    repeated = np.zeros((width, m), bool)
    for c in range(width - 1, -1, -1):
        symbol = columns[c][order]  # the transform's column: what stands in front of the suffixes, in their order
        rank = groups[order] * 512 + symbol
        if (rank[1:] >= rank[:-1]).all():
            moved = None
            same = rank[1:] == rank[:-1]
            low = prefix[1:m]
        else:
            moved = np.argsort(rank, kind="stable")
            order, symbol, rank = order[moved], symbol[moved], rank[moved]
            same = rank[1:] == rank[:-1]
            low = np.zeros(m - 1, np.int32)
            pairs = np.flatnonzero(same)
            if len(pairs):  # smallest common prefix between the old places of the two
                spans = np.empty(2 * len(pairs), np.int64)
                spans[0::2], spans[1::2] = moved[pairs] + 1, moved[pairs + 1] + 1
                low[pairs] = np.minimum.reduceat(prefix, spans)[0::2]
        longer = np.where(same & (symbol[1:] >= 0), low + 1, 0)
        prefix = np.concatenate([[0], longer, [0]]).astype(np.int32)
        full = prefix >= length
        hit = full[:-1] | full[1:]
        if hit.any():
            repeated[c, order[hit]] = True
    return [repeated[shift[i] : shift[i] + sizes[i] - length + 1, i] for i in range(m)]


def spans_of(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last place of every run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[0::2].tolist(), (edges[1::2] - 1).tolist()


def collections(rows: Iterator[pd.DataFrame], length: int) -> Iterator[pd.DataFrame]:
    """Search sorted pieces (key, piece_key, anchor, piece) collection by collection, several small keys at a time; repeats are dropped as they come."""
    held: list[pd.DataFrame] = []
    size, last = 0, None

    def search() -> pd.DataFrame:
        part = pd.concat(held)
        groups, _ = pd.factorize(part["key"])
        alone = np.bincount(groups)[groups] == 1  # nothing to compare with
        part, groups = part[~alone], groups[~alone]
        if not len(part):
            return pd.DataFrame({"key": [], "piece_key": [], "first": [], "last": []})
        flags = repeated_starts(part["piece"].tolist(), part["anchor"].to_numpy(np.int64), groups, length)
        found = [(k, p, *spans_of(f)) for k, p, f in zip(part["key"], part["piece_key"], flags) if f.any()]
        return pd.DataFrame(found, columns=["key", "piece_key", "first", "last"])

    for batch in rows:
        if not len(batch):
            continue
        keys, names = batch["key"].to_numpy(), batch["piece_key"].to_numpy()
        new = np.append((keys[0], names[0]) != last, (keys[1:] != keys[:-1]) | (names[1:] != names[:-1]))
        last = (keys[-1], names[-1])
        batch, keys = batch[new], keys[new]
        if not len(batch):
            continue
        change = np.append(0, np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        for a, b in zip(change, [*change[1:], len(batch)]):
            part = batch.iloc[a:b]
            if held and size > COLLECTION_BYTES and held[-1]["key"].iloc[-1] != keys[a]:
                yield search()
                held, size = [], 0
            held.append(part)
            size += 2 * length * len(part)
    if held:
        yield search()


def repeated_spans(docs: DataFrame, length: int = 400, text: str = "text", row_key: str = "row_key") -> DataFrame:
    """(row_key, first, last): arrays of runs of window starts that also start elsewhere, for texts that have any.

    ``row_key`` names distinct (document, text) rows; ``copies`` says how many
    rows of that name there are, which repeat each other.

    Pieces are cut only around anchors that occur more than once, by a bit
    filter of at most 16 MB; equal pieces are compared as one, and their number
    makes them repeats. A busy anchor's pieces, over CROWD with their repeats,
    are dealt by piece first, so a task gets at most CROWD of any anchor. A crowded anchor, with over CROWD distinct pieces, is not
    searched in one collection: its windows are counted by a 128-bit hash each,
    combined on the map side.
    """
    spark = docs.sparkSession

    def named(data, bounds):
        row, first, last, spot, key = anchors(data, bounds, length)
        return row, first, last, spot, key, SpanHasher(data)(first, last + length) if len(row) else key

    def listed(_texts, data, bounds):
        row, first, last, _, key, piece = named(data, bounds)
        edges = pa.array(np.searchsorted(row, np.arange(len(bounds))).astype(np.int32))
        base = bounds[row] if len(row) else first
        arrays = [key.view(np.int64), (mixed(piece ^ key)).view(np.int64), (first - base).astype(np.int32), (last - base).astype(np.int32)]
        return [pa.ListArray.from_arrays(edges, pa.array(a)) for a in arrays]

    listing = written(
        with_columns(docs.select(row_key, "copies", text), text, "keys array<long>, piece_keys array<long>, firsts array<int>, lasts array<int>", listed).drop(text), "anchors"
    )
    every = listing.select(row_key, "copies", F.inline(F.arrays_zip("keys", "piece_keys", "firsts", "lasts"))).toDF(row_key, "copies", "key", "piece_key", "first", "last")
    pieces = every.groupBy("key", "piece_key").agg(F.sum("copies").alias("n"))
    stats = pieces.groupBy("key").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds"))
    pieces, several = written(pieces.where("n > 1"), "equal-pieces"), written(stats.where("n > 1"), "repeated-anchors")
    total = several.where("kinds > 1").count()
    crowded_count = several.where(F.col("kinds") > CROWD).count()
    shared = spark.sparkContext.broadcast(filter_words(several.where("kinds > 1"), "key", total))
    busy = several.where((F.col("kinds") > 1) & (F.col("kinds") <= CROWD) & (F.col("n") > CROWD))
    busy_count = busy.count()
    many = spark.sparkContext.broadcast(filter_words(busy, "key", busy_count))
    crowd = spark.sparkContext.broadcast(filter_words(several.where(F.col("kinds") > CROWD), "key", crowded_count))

    def cut(batches):
        for batch in batches:
            seen: set[int] = set()
            for part, data, bounds in text_slices(batch, text):
                row, first, last, spot, key, piece = named(data, bounds)
                piece = mixed(piece ^ key)
                keep = np.flatnonzero(in_filter(*shared.value, key))
                raw = data.tobytes()
                out = []
                for i, k, p, a, b, s, hot, often in zip(keep.tolist(), key[keep].view(np.int64).tolist(), piece[keep].view(np.int64).tolist(), first[keep].tolist(), last[keep].tolist(), spot[keep].tolist(), in_filter(*crowd.value, key[keep]).tolist(), in_filter(*many.value, key[keep]).tolist()):
                    if p in seen:
                        continue
                    seen.add(p)
                    out.append((k, p, s - a, raw[a : b + length], hot, often))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_(), pa.bool_()))], names=["key", "piece_key", "anchor", "piece", "crowded", "busy"])

    cuttings = docs.select(text).mapInArrow(cut, "key long, piece_key long, anchor int, piece binary, crowded boolean, busy boolean")
    single = cuttings.where("not crowded and not busy")
    if busy_count:
        single = single.unionByName(cuttings.where("busy and not crowded").dropDuplicates(["key", "piece_key"]))
    sorted_pieces = single.select("key", "piece_key", "anchor", "piece").repartition("key").sortWithinPartitions("key", "piece_key")
    found = sorted_pieces.mapInPandas(lambda rows: collections(rows, length), "key long, piece_key long, first array<int>, last array<int>")
    if crowded_count:
        found = found.unionByName(_counted_windows(cuttings.where("crowded").dropDuplicates(["key", "piece_key"]), length))
    found = written(found, "repeats")
    inner = every.join(found.withColumnRenamed("first", "f").withColumnRenamed("last", "l"), ["key", "piece_key"]).select(
        row_key, F.transform("f", lambda x: x + F.col("first")).alias("f"), F.transform("l", lambda x: x + F.col("first")).alias("l")
    )
    whole = every.join(pieces.select("key", "piece_key"), ["key", "piece_key"], "left_semi").select(row_key, F.array("first").alias("f"), F.array("last").alias("l"))
    both = inner.unionByName(whole).groupBy(row_key).agg(F.flatten(F.collect_list("f")).alias("first"), F.flatten(F.collect_list("l")).alias("last"))
    return both  # as many entries as the text has anchors


def _counted_windows(pieces: DataFrame, length: int) -> DataFrame:
    """Repeated starts of crowded anchors' pieces: every window's digest is counted, with map-side combining."""

    def windows(batches):
        for batch in batches:
            for k, p, s, piece in zip(*(batch.column(c).to_pylist() for c in ("key", "piece_key", "anchor", "piece"))):
                at = range(len(piece) - length + 1)
                digests = [hashlib.blake2b(piece[a : a + length] + (s - a).to_bytes(4, "little"), digest_size=16).digest() for a in at]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(digests)), pa.array([p] * len(digests)), pa.array(list(at), pa.int32()), pa.array(digests, pa.binary())], names=["key", "piece_key", "at", "digest"])

    every = written(pieces.select("key", "piece_key", "anchor", "piece").mapInArrow(windows, "key long, piece_key long, at int, digest binary"), "windows")
    twice = every.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    return every.join(twice, "digest", "left_semi").groupBy("key", "piece_key").agg(F.sort_array(F.collect_list("at")).alias("first")).withColumn("last", F.col("first"))


def _folded(source: DataFrame) -> DataFrame:
    """``source`` with one row per row_key and in ``copies`` how many it stands for; texts of rows that do not repeat stay in place."""
    again = written(source.groupBy("row_key").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "repeated-rows")
    if again.isEmpty():
        return source.withColumn("copies", F.lit(1).cast("long"))
    alone = source.join(again, "row_key", "left_anti").withColumn("copies", F.lit(1).cast("long"))
    one = source.join(again, "row_key", "left_semi").groupBy("row_key").agg(*[F.first(c).alias(c) for c in source.columns if c != "row_key"])
    return alone.unionByName(one.join(again, "row_key"))


DIGEST = "n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text's UTF-8 bytes without those that a repeated window covers.

    A window is ``length`` bytes that also start anywhere else, in the same or
    another row; windows never cross rows and are judged on the input. A null
    text is empty; rows that repeat (doc_id, text) repeat each other. ``kept`` is
    binary, as a cut may fall inside a character. Repeated rows are searched as
    one: only their texts are folded by a shuffle, and the spans found go back to
    all of them.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(_folded(source), length)
    joined = source.join(spans, "row_key", "left").select("doc_id", "text", "first", "last")

    def strip(batches):
        for batch in batches:
            for part, data, bounds in text_slices(batch, "text"):
                firsts, lasts = part.column("first").to_pylist(), part.column("last").to_pylist()
                n, removed, spans, kept = [], [], [], []
                for a, b, first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist(), firsts, lasts):
                    own = data[a:b]
                    gone = np.zeros(len(own) + 1, np.int64)
                    if first:
                        np.add.at(gone, first, 1)
                        np.add.at(gone, np.array(last) + length, -1)
                    covered = np.cumsum(gone[:-1]) > 0
                    n.append(len(own))
                    removed.append(int(covered.sum()))
                    spans.append(len(spans_of(covered)[0]))
                    kept.append(own[~covered].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )

    return joined.mapInArrow(strip, f"doc_id {dict(source.dtypes)['doc_id']}, {DIGEST}")
