"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over neighbouring tokens; tokens under its zeros are ignored,
so a hash survives a substitution there. Training tokens whose masked hash
may be one of the benchmark's are cut out with their surroundings; those
hashes are joined with the benchmark's; and around every hit the two texts are
laid side by side and compared token by token.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import SpanHasher, filter_words, in_filter, mixed, runs, text_slices

#: Fixed masks; a one is a token that counts. Each has six ones.
MASKS = ("1110111", "11010111", "110110011", "1011001101")
SPAN = max(map(len, MASKS))
CONTEXT = 64
#: From this many tokens on, the masks survive every substitution that 80 % identity allows.
SAFE = 12


def short_masks(width: int, identity: float) -> list[str]:
    """Masks over a whole window of ``width`` tokens: whichever tokens ``identity`` lets differ, one mask ignores them all.

    With k such tokens the window is cut into 2 k + 1 blocks (of one token at
    least), and each mask ignores k of them.
    """
    k = width - math.ceil(identity * width - 1e-9)
    blocks = np.array_split(np.arange(width), min(width, 2 * k + 1))
    out = []
    for gone in combinations(blocks, min(k, len(blocks))):
        ignored = {int(x) for block in gone for x in block}
        out.append("".join("0" if i in ignored else "1" for i in range(width)))
    return out


def numbered_masks(widths: list[int], identity: float) -> list[tuple[int, str]]:
    """The fixed masks and those of short windows, each with its number."""
    return [*enumerate(MASKS, 1), *((w << 16 | i, m) for w in widths for i, m in enumerate(short_masks(w, identity)))]


def _kinds() -> np.ndarray:
    kinds = np.ones(256, np.uint8)
    kinds[:128] = 0
    for a, b in ("09", "az", "AZ"):
        kinds[ord(a) : ord(b) + 1] = 1
    return kinds


WORD_BYTES = _kinds()


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token of all rows and each token's row: runs of letters, digits and non-ASCII characters, lower-cased."""
    import pyarrow.compute as pc

    from .common import text_buffer

    data, bounds = text_buffer(pc.utf8_lower(texts.fill_null("")))
    starts, ends, rows = runs(WORD_BYTES[data], bounds)
    return SpanHasher(data)(starts, ends), rows


def seed_hashes(tokens: np.ndarray, rows: np.ndarray, masks: list[tuple[int, str]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per mask: first token and hash of every placement that lies within one row."""
    out = []
    for number, mask in masks:
        n = len(tokens) - len(mask) + 1
        if n <= 0:
            out.append((np.empty(0, np.int64), np.empty(0, np.uint64)))
            continue
        at = np.flatnonzero(rows[:n] == rows[len(mask) - 1 :])
        h = np.full(len(at), number, np.uint64)
        for k, bit in enumerate(mask):
            if bit == "1":
                h = (h + tokens[at + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
        out.append((at, mixed(h)))
    return out


def benchmark_seeds(items: DataFrame, masks: list[tuple[int, str]], min_tokens: int) -> DataFrame:
    """(seed, item_id, at) of every placement of every mask in (item_id, text); masks of short windows fit windows of their width only."""

    def run(batches):
        for batch in batches:
            for part, _, _ in text_slices(batch, "text"):
                tokens, rows = token_hashes(part.column("text"))
                first = np.searchsorted(rows, np.arange(part.num_rows))
                widths = np.minimum(np.bincount(rows, minlength=part.num_rows), min_tokens)
                for (number, mask), (at, h) in zip(masks, seed_hashes(tokens, rows, masks)):
                    if number > len(MASKS):
                        fits = widths[rows[at]] == len(mask)
                        at, h = at[fits], h[fits]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(h.view(np.int64)), part.column("item_id").take(pa.array(rows[at])), pa.array((at - first[rows[at]]).astype(np.int32)),
                    ], names=["seed", "item_id", "at"])

    return items.select("item_id", "text").mapInArrow(run, "seed long, item_id long, at int")


def item_tokens(items: DataFrame) -> DataFrame:
    """(item_id, tokens array<long>): token hashes of every item."""

    def run(batches):
        for batch in batches:
            for part, _, _ in text_slices(batch, "text"):
                tokens, rows = token_hashes(part.column("text"))
                edges = np.searchsorted(rows, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.ListArray.from_arrays(pa.array(edges), pa.array(tokens.view(np.int64)))], names=["item_id", "item"])

    return items.select("item_id", "text").mapInArrow(run, "item_id long, item array<long>")


def suspects(docs: DataFrame, words, bits: int, masks: list[tuple[int, str]]) -> DataFrame:
    """Stretches of documents with placements that pass the bit filter.

    (doc_id, stretch, base, seeds array<struct<seed, at>>, tokens): a stretch
    ends where no placement passes for SPAN tokens; ``tokens`` are its token
    hashes with CONTEXT tokens on either side, ``base`` the number of its first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)  # a bit filter, of bounded size
    schema = "doc_id long, row_key long, stretch int, base int, seeds array<struct<seed:long,at:int>>, tokens array<long>"

    def run(batches):
        for batch in batches:
            for part, _, _ in text_slices(batch, "text"):
                tokens, rows = token_hashes(part.column("text"))
                found = [(at[ok], h[ok]) for at, h in seed_hashes(tokens, rows, masks) for ok in [in_filter(shared.value, bits, h)]]
                at, h = (np.concatenate(x) for x in zip(*found))
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, h = at[order], h[order]
                first = np.searchsorted(rows, np.arange(part.num_rows + 1))
                new = np.flatnonzero((np.diff(at) > SPAN) | (np.diff(rows[at]) != 0)) + 1
                a, b = np.append(0, new), np.append(new, len(at))
                row = rows[at[a]]
                lo = np.maximum(first[row], at[a] - CONTEXT)
                hi = np.minimum(first[row + 1], at[b - 1] + SPAN + CONTEXT)
                for lo_, hi_ in _chunks(hi - lo):
                    spans = np.concatenate([np.arange(x, y) for x, y in zip(lo[lo_:hi_], hi[lo_:hi_])])
                    sizes = np.append(0, np.cumsum((hi - lo)[lo_:hi_])).astype(np.int32)
                    s, e = a[lo_], b[hi_ - 1]
                    local = at[s:e] - np.repeat(first[row[lo_:hi_]], (b - a)[lo_:hi_])
                    seeds = pa.StructArray.from_arrays([pa.array(h[s:e].view(np.int64)), pa.array(local.astype(np.int32))], ["seed", "at"])
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id").take(pa.array(row[lo_:hi_])), part.column("row_key").take(pa.array(row[lo_:hi_])),
                        pa.array(at[a][lo_:hi_].astype(np.int32)), pa.array((lo - first[row])[lo_:hi_].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array((np.append(a[lo_:hi_], e) - s).astype(np.int32)), seeds),
                        pa.ListArray.from_arrays(pa.array(sizes), pa.array(tokens[spans].view(np.int64))),
                    ], names=["doc_id", "row_key", "stretch", "base", "seeds", "tokens"])

    return docs.mapInArrow(run, schema)


def _chunks(sizes: np.ndarray, limit: int = 1 << 18):
    from .common import row_slices

    return row_slices(sizes, limit)


OVERLAP = "doc_id long, row_key long, item_id long, doc_start int, item_start int, length int, matches int"


def overlaps(docs: DataFrame, items: DataFrame, min_tokens: int = 13, identity: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Overlaps of documents with benchmark items that tolerate substitutions.

    One row per document, item and alignment: where the overlap starts in each
    (tokens), its length and how many of its tokens are equal. An overlap is a
    stretch of one alignment, covered by windows of ``min_tokens`` tokens (all
    of the item, if it has fewer) of which at least ``identity`` are equal; the
    longest of an alignment is returned. ``docs`` needs (doc_id, text), ``items``
    (item_id, text). Texts are read whole; null ones are empty. A document may
    be named several times if doc_id repeats. Windows of fewer than SAFE tokens
    have masks of their own, so short items are found under every substitution
    that ``identity`` allows; documents are searched with the masks of those
    widths only that the benchmark has.

    The filter handed to all tasks is at most 16 MB, and thin enough that few
    placements pass by chance. Its false positives end in the join, which is on the hash and is split where one passage is in very
    many documents.
    """
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    widths = item_tokens(bench).select(F.least(F.size("item"), F.lit(min_tokens)).alias("width")).where(f"width between 1 and {SAFE - 1}").distinct()
    masks = numbered_masks(sorted(r["width"] for r in widths.collect()), identity)
    seeds = written(benchmark_seeds(bench, masks, min_tokens).distinct(), "benchmark-seeds")
    words, bits = filter_words(seeds.select("seed").distinct(), "seed", seeds.count(), 2048)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    found = written(suspects(source, words, bits, masks), "suspects")
    placed = found.select("row_key", "doc_id", "stretch", F.inline("seeds"))
    hits = placed.withColumnRenamed("at", "doc_at").join(seeds, "seed").select("doc_id", "row_key", "stretch", "item_id", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
    sided = hits.join(found.select("row_key", "stretch", "base", "tokens"), ["row_key", "stretch"]).join(item_tokens(bench), "item_id")

    def verify(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                doc, item = np.array(r["tokens"], np.int64), np.array(r["item"], np.int64)
                lo = max(0, r["base"] - r["shift"])  # item positions that lie inside the stretch
                hi = min(len(item), r["base"] - r["shift"] + len(doc))
                width = min(min_tokens, len(item))
                if hi - lo < width:
                    continue
                equal = item[lo:hi] == doc[lo + r["shift"] - r["base"] : hi + r["shift"] - r["base"]]
                sums = np.append(0, np.cumsum(equal))
                good = np.flatnonzero(sums[width:] - sums[:-width] >= identity * width - 1e-9)
                if not len(good):
                    continue
                parts = np.split(good, np.flatnonzero(np.diff(good) > width) + 1)
                best = max(parts, key=lambda p: p[-1] - p[0])
                a, b = int(best[0]), int(best[-1]) + width
                a += int(np.argmax(equal[a:b]))
                b -= int(np.argmax(equal[a:b][::-1]))
                out.append((r["doc_id"], r["row_key"], r["item_id"], lo + a + r["shift"], lo + a, b - a, int(equal[a:b].sum())))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(OVERLAP_NAMES, o)) for o in out], schema=OVERLAP_SCHEMA)

    return sided.select("doc_id", "row_key", "item_id", "shift", "base", "tokens", "item").mapInArrow(verify, OVERLAP)


OVERLAP_NAMES = [c.split()[0] for c in OVERLAP.split(", ")]
OVERLAP_SCHEMA = pa.schema([(n, pa.int64() if t == "long" else pa.int32()) for n, t in (c.split() for c in OVERLAP.split(", "))])


def contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, doc_start, item_start, length, matches): the longest overlap of each document and item."""
    found = overlaps(docs, items, **options)
    best = F.max(F.struct("length", "matches", (-F.col("doc_start")).alias("d"), (-F.col("item_start")).alias("i"))).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.d")).alias("doc_start"), (-F.col("best.i")).alias("item_start"), "best.length", "best.matches"
    )
