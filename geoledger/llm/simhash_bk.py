"""SimHash near-duplicates found with BK-trees.

Fingerprints are dealt into shards such that any two that may be linked meet in
at least one of them. A shard holds a BK-tree: each node's children are keyed
by their Hamming distance to it, so a probe follows only the edges whose
distance differs from its own by at most the radius. Links become connected
components; a shard reports a spanning forest of its links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .common import connected, filter_words, in_filter, mixed, text_slices, with_columns

BITS = 64
SHARD_ROWS = 2048
PARITY_BITS = 256
#: A prefix shares 1 + n // SHARED hashes with that of any similar set, n being the smaller size.
SHARED = 32
#: One in SAMPLED shingles tells which are frequent; at most FREQUENT of those are told to all tasks.
SAMPLED, FREQUENT = 32, 1 << 18


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, joined by a space; A-Z lower-cased, words split at ASCII white space.

    Fewer words: their whole sequence. No words: no hash.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= width:
        return np.array([digest(joined, 42)], np.uint64)
    starts = [0, *(ends[: -width] + 1).tolist()]
    stops = ends[width - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), np.uint64, len(stops))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(docs: DataFrame, text: str = "text", width: int = 4) -> DataFrame:
    """Every row with ``fp``, its fingerprint as a signed long. Whole texts; a null text is empty, and empty ones have zero."""

    def make(_texts, data, bounds):
        raw, at = data.tobytes(), bounds.tolist()
        return [pa.array([signed(fingerprint(shingle_hashes(raw[a:b], width))) for a, b in zip(at, at[1:])], pa.int64())]

    return with_columns(docs, text, "fp long", make)


class BKTree:
    """Tree over an array of distinct fingerprints; nodes are positions in it."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.children = values, {}
        todo = [np.arange(len(values))] if len(values) else []
        while todo:
            members = todo.pop()
            root, rest = int(members[0]), members[1:]
            d = np.bitwise_count(values[rest] ^ values[root])
            order = np.argsort(d, kind="stable")
            edges, first = np.unique(d[order], return_index=True)
            groups = np.split(rest[order], first[1:]) if len(edges) else []
            self.children[root] = [(int(e), int(g[0])) for e, g in zip(edges, groups)]
            todo += groups

    def within(self, probes: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each node visited: the probes (positions in ``probes``) within the radius of it."""
        todo = [(0, np.arange(len(probes)))] if len(self.values) else []
        while todo:
            node, active = todo.pop()
            d = np.bitwise_count(probes[active] ^ self.values[node]).astype(np.int16)
            near = active[d <= radius]
            if len(near):
                yield node, near
            for edge, child in self.children[node]:
                follow = active[np.abs(d - edge) <= radius]
                if len(follow):
                    todo.append((child, follow))


def shard_links(
    tree_values: np.ndarray, probe_values: np.ndarray, tree_groups: np.ndarray, probe_groups: np.ndarray, radius: int,
    alike: Callable[[int, np.ndarray], np.ndarray] | None = None,
) -> list[tuple[int, int]]:
    """Links (node, probe) that join groups not yet joined; ``alike`` says which probes a node may be linked with.

    Groups are numbers >= 0; equal ones are joined already. What is left out
    would join nothing new.
    """
    tree, links = BKTree(tree_values), []
    root = np.arange(int(max(tree_groups.max(initial=-1), probe_groups.max(initial=-1))) + 1)
    for node, near in tree.within(probe_values, radius):
        mine = root[tree_groups[node]]
        apart = near[root[probe_groups[near]] != mine]
        if len(apart) and alike is not None:
            apart = alike(node, apart)
        while len(apart):
            probe = int(apart[0])
            theirs = root[probe_groups[probe]]
            links.append((node, probe))
            mine, old = min(mine, theirs), max(mine, theirs)
            root[root == old] = mine
            apart = apart[root[probe_groups[apart]] != mine]
    return links


class Alike:
    """Exact Jaccard similarity of one node's shingles with those of many probes at once, over shingles numbered anew."""

    def __init__(self, nodes: list[np.ndarray], probes: list[np.ndarray], least: float) -> None:
        self.least = least
        sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (nodes, probes)]
        (self.node_size, self.probe_size), split = sizes, int(sizes[0].sum())
        every, ids = np.unique(np.concatenate([*nodes, *probes]), return_inverse=True)
        self.node_ids, self.probe_ids = ids[:split], ids[split:]
        self.node_at, self.probe_at = (np.append(0, np.cumsum(x)) for x in sizes)
        self.mark = np.zeros(len(every), bool)

    def __call__(self, node: int, probes: np.ndarray) -> np.ndarray:
        n, m = self.node_size[node], self.probe_size[probes]
        probes = probes[(np.minimum(n, m) >= self.least * np.maximum(n, m)) & (m > 0)]
        own = self.node_ids[self.node_at[node] : self.node_at[node + 1]]
        self.mark[own] = True
        a, b = self.probe_at[probes], self.probe_at[probes + 1]
        if len(probes) > 16:
            sums = np.append(0, np.cumsum(self.mark[self.probe_ids]))
            both = sums[b] - sums[a]
        else:
            both = np.array([np.count_nonzero(self.mark[self.probe_ids[i:j]]) for i, j in zip(a, b)], np.int64)
        self.mark[own] = False
        return probes[both >= self.least * (n + self.probe_size[probes] - both)]


def _stream(key_columns: list[str], work: Callable[[pd.DataFrame], list[tuple[int, int]]]) -> Callable:
    """Run ``work`` on each key's rows of a sorted partition; one key's rows, bounded by the sharding, are held at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            if not len(batch):
                continue
            keys = batch[key_columns].to_numpy()
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            parts = [batch.iloc[a:b] for a, b in zip([0, *change.tolist()], [*change.tolist(), len(batch)])]
            if held and (held[0][key_columns].iloc[0].to_numpy() == keys[0]).all():
                parts[0] = pd.concat([*held, parts[0]])
            elif held:
                parts.insert(0, pd.concat(held))
            held = [parts.pop()]
            links = [pair for part in parts if len(part) > 1 for pair in work(part)]
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")
        if held and len(whole := pd.concat(held)) > 1:
            yield pd.DataFrame(work(whole), columns=["a", "b"], dtype="int64")

    return run


def sharded_links(members: DataFrame, radius: int, min_similarity: float | None = None, shingles: DataFrame | None = None) -> DataFrame:
    """Links (a, b) between nodes that share a shard: (key, node, fp).

    Shards of more than SHARD_ROWS members are cut into blocks by a hash of the
    node: first every block is searched for itself, then blocks of one shard
    meet in pairs, where members joined already are passed over. With
    ``min_similarity`` a link also needs that Jaccard similarity of the
    ``shingles``: (node, shingles), distinct ints, joined to members last, as
    they are by far the widest column.
    """
    checked = min_similarity is not None

    def alike(left: pd.Series, right: pd.Series) -> Alike:
        return Alike(left.tolist(), right.tolist(), min_similarity)

    def inside(part: pd.DataFrame) -> list[tuple[int, int]]:
        nodes, values = part["node"].to_numpy(), part["fp"].to_numpy(np.int64).view(np.uint64)
        own = np.arange(len(part))
        found = shard_links(values, values, own, own, radius, alike(part["shingles"], part["shingles"]) if checked else None)
        return [(int(nodes[i]), int(nodes[j])) for i, j in found]

    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / SHARD_ROWS))
    shared = members.join(sizes.select("key", "blocks"), "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    keys = ["key", "block"]

    def wide(rows: DataFrame) -> DataFrame:
        return rows.join(shingles, "node") if checked else rows

    dealt = wide(shared.select(*keys, "node", "fp")).repartition(*keys).sortWithinPartitions(*keys)
    links = written(dealt.mapInPandas(_stream(keys, inside), "a long, b long").distinct(), "near-links")
    large = written(sizes.where("blocks > 1").select("key", "blocks"), "large-shards")
    if large.isEmpty():
        return links

    joined = connected(links, "near-parts")
    names = shared.join(large.select("key"), "key", "left_semi").join(joined, "node", "left").withColumn("part", F.coalesce("root", "node"))
    met = names.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("other <> block").select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") < F.col("other")).alias("tree"), "part", "node", "fp"
    )

    def across(part: pd.DataFrame) -> list[tuple[int, int]]:
        groups, _ = pd.factorize(part["part"])
        is_tree = part["tree"].to_numpy(bool)
        t, p = np.flatnonzero(is_tree), np.flatnonzero(~is_tree)
        nodes, values = part["node"].to_numpy(), part["fp"].to_numpy(np.int64).view(np.uint64)
        confirm = alike(part["shingles"].iloc[t], part["shingles"].iloc[p]) if checked else None
        return [(int(nodes[t[i]]), int(nodes[p[j]])) for i, j in shard_links(values[t], values[p], groups[t], groups[p], radius, confirm)]

    pair = ["key", "low", "high"]
    more = wide(met).repartition(*pair).sortWithinPartitions(*pair).mapInPandas(_stream(pair, across), "a long, b long")
    return links.unionByName(written(more.distinct(), "near-links"))


def agreeing_blocks(nodes: int, radius: int) -> int:
    """How many blocks of bits a shard shares, so that a shard of evenly spread fingerprints holds SHARD_ROWS at most, however many there are."""
    m = 1
    while m < BITS - radius and nodes > SHARD_ROWS << BITS * m // (radius + m):
        m += 1
    return m


def block_keys(fp: str, radius: int, agreeing: int = 1):
    """A key for every choice of ``agreeing`` of radius + agreeing blocks of bits.

    Fingerprints within the radius differ in at most ``radius`` blocks, so they
    agree on all blocks of one choice: 5 keys of 12 bits or more for a radius of 4,
    15 keys of 21, 35 of 27, 70 of 32.
    """
    count = radius + agreeing
    edges = [round(i * BITS / count) for i in range(count + 1)]
    cut = [F.shiftrightunsigned(F.shiftleft(fp, BITS - b), BITS - b + a) for a, b in zip(edges, edges[1:])]
    return F.array(*[F.xxhash64(F.lit(n), *[cut[i] for i in chosen]) for n, chosen in enumerate(combinations(range(count), agreeing))])


def near_components(docs: DataFrame, width: int = 4, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row: fingerprints link at ``radius`` or fewer differing bits.

    Exact: each choice of blocks of bits deals the distinct fingerprints into
    shards, and two within the radius agree on one choice at least. Shards share
    the more bits the more fingerprints there are, so they do not grow with the table. Rows of
    one fingerprint are one node, so copies cost one row. The component's name is
    its smallest doc_id; null ids are passed over unless there is no other.
    """
    rows = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", width).select("doc_id", "fp"), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    members = nodes.select(F.explode(block_keys("fp", radius, agreeing_blocks(nodes.count(), radius))).alias("key"), F.col("fp").alias("node"), "fp")
    roots = connected(sharded_links(members, radius), "near-components")
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("first").alias("component_id"))
    final = named.join(names, "root").select("fp", "component_id")
    return rows.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def node_name(distinct: np.ndarray) -> int:
    """Signed hash of a set of shingle hashes."""
    total = mixed(distinct).sum(dtype=np.uint64) ^ np.uint64(len(distinct))
    return int(mixed(np.array([total]))[0].astype(np.int64))


def parity(distinct: np.ndarray) -> np.ndarray:
    """PARITY_BITS bits as signed longs: one hash flips one bit, so two sets differ in at least as many hashes as their bits differ."""
    odd = np.bincount((mixed(distinct) >> np.uint64(32)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix_length(n: int, least: float) -> int:
    """So many hashes, first by any order common to all sets, share 1 + m // SHARED with those of any set of Jaccard similarity ``least`` or more; m is the smaller size."""
    return min(n, n - math.ceil(least * n - 1e-6) + 1 + n // SHARED)


def frequent_hashes(sampled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes seen often in a column of samples, at most FREQUENT of them, and the size class of each; they only order the hashes."""
    counts = sampled.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").select("h", F.floor(F.log2("n")).cast("int").alias("class"))
    counts = written(counts, "near-frequent")
    least, held = 64, 0
    for r in sorted(counts.groupBy("class").count().collect(), reverse=True):
        held += r["count"]
        if held > FREQUENT:
            break
        least = r["class"]
    rows = counts.where(F.col("class") >= least).toPandas()
    hashes = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["class"].to_numpy(np.uint8)[order]


def open_pairs(texts: DataFrame, parts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], width: int, least: float) -> DataFrame:
    """Distinct pairs (a, b) of nodes of different parts that may have a Jaccard similarity of ``least`` or more; none that has is left out.

    Each set of shingles is keyed by its prefix: its first hashes in an order
    common to all sets, frequent ones last. Keys that lie within one part are
    done. Under the others, a pair stays if neither its sizes, its parity bits
    nor the number of keys it shares rule it out; crowded keys are cut into
    pairs of blocks of SHARD_ROWS.
    ``parts`` is (node, root); a node it lacks is a part of its own.
    """
    spark = texts.sparkSession
    ordered = spark.sparkContext.broadcast(frequent)  # of bounded size

    def prefixes(batches):
        common, classes = ordered.value
        seen: set[int] = set()
        for batch in batches:
            for _, data, bounds in text_slices(batch, "text"):
                raw, at, out = data.tobytes(), bounds.tolist(), []
                for a, b in zip(at, at[1:]):
                    distinct = np.unique(shingle_hashes(raw[a:b], width))
                    if not len(distinct) or (node := node_name(distinct)) in seen:
                        continue
                    seen.add(node)
                    first = distinct
                    if len(common):
                        spot = np.minimum(np.searchsorted(common, distinct), len(common) - 1)
                        first = distinct[np.argsort(np.where(common[spot] == distinct, classes[spot], 0), kind="stable")]
                    out.append((node, len(distinct), parity(distinct), first[: prefix_length(len(distinct), least)].view(np.int64)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=["node", "n", "bits", "keys"])

    types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    heads = texts.select("text").mapInArrow(prefixes, "node long, n long, bits array<long>, keys array<long>")
    heads = written(heads.dropDuplicates(["node"]).join(parts, "node", "left").select("node", F.coalesce("root", "node").alias("part"), "n", "bits", "keys"), "near-heads")
    ends = heads.select(F.explode("keys").alias("key"), "part").groupBy("key").agg(F.min("part").alias("first"), F.max("part").alias("last"), F.count(F.lit(1)).alias("n"))
    keys = written(ends.where("first <> last").select("key", F.ceil(F.col("n") / SHARD_ROWS).alias("blocks")), "near-open")
    words, bits = filter_words(keys, "key", keys.count(), 32)
    passes = spark.sparkContext.broadcast(words)  # a bit filter, of bounded size

    def picked(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("keys")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            ok = np.flatnonzero(in_filter(passes.value, bits, flat.view(np.uint64)))
            for lo in range(0, len(ok), 1 << 14):
                some = ok[lo : lo + (1 << 14)]
                own = batch.select(["node", "part", "n", "bits"]).take(pa.array(row[some]))
                yield pa.RecordBatch.from_arrays([pa.array(flat[some]), *own.columns], names=["key", *own.schema.names])

    members = heads.mapInArrow(picked, "key long, node long, part long, n long, bits array<long>").join(keys, "key")
    met = members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "part", "n", "bits")
    met = written(met, "near-members")
    here, there = met.alias("a"), met.alias("b")
    differ = " + ".join(f"bit_count(a.bits[{i}] ^ b.bits[{i}])" for i in range(PARITY_BITS // 64))
    kept = F.expr(
        "a.key = b.key and a.low = b.low and a.high = b.high and a.node < b.node and a.part <> b.part and (a.low = a.high or a.block <> b.block)"
        f" and least(a.n, b.n) >= {least}D * greatest(a.n, b.n) - 1e-6D and {differ} <= (a.n + b.n) * {(1 - least) / (1 + least)!r}D + 1e-6D"
    )
    pairs = here.join(there, kept).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.least("a.n", "b.n").alias("n"))
    return pairs.groupBy("a", "b", "n").agg(F.count(F.lit(1)).alias("shared")).where(f"shared >= 1 + n div {SHARED}").select("a", "b")


def near_groups(docs: DataFrame, width: int = 5, radius: int = 14, min_similarity: float = 0.8, tables: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row_key, doc_id, group_id) per distinct (doc_id, text): groups of texts whose word shingles are alike.

    Exact: every pair of a Jaccard similarity of ``min_similarity`` or more is
    linked, in two steps. The first links most at little cost: shards are keyed
    by the smallest of the shingle hashes under ``tables`` orders, a BK-tree
    gives the pairs whose fingerprints differ in at most ``radius`` bits, and
    the similarity of their shingles decides. The second finds what the first
    missed between the groups made so far, see :func:`open_pairs`; ``tables``
    and ``radius`` only divide the work. Texts with the same shingles are one
    node. Texts without words form one group.
    """
    salts = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64)) for i in range(tables)]

    def make(_texts, data, bounds):
        raw, at = data.tobytes(), bounds.tolist()
        fps, nodes, keys, samples = [], [], [], []
        for a, b in zip(at, at[1:]):
            h = shingle_hashes(raw[a:b], width)
            fps.append(signed(fingerprint(h)))
            distinct = np.unique(h)
            nodes.append(node_name(distinct))
            keys.append([int(mixed(distinct ^ s).min().astype(np.int64)) if len(distinct) else 0 for s in salts])
            drawn = mixed(distinct ^ np.uint64(nodes[-1] % (1 << 64))) % np.uint64(SAMPLED) == 0
            samples.append(distinct[drawn].view(np.int64))
        return pa.array(fps, pa.int64()), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(samples, pa.list_(pa.int64()))

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    made = with_columns(source.withColumn("row_key", F.xxhash64("doc_id", "text")), "text", "fp long, node long, keys array<long>, sample array<long>", make)
    rows = written(made.drop("text"), "near-rows")
    nodes = rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("keys").alias("keys"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")).alias("first"))
    dealt = written(nodes.select(F.posexplode("keys").alias("t", "k"), "node", "fp", F.col("first.row_key").alias("row_key")).select(F.xxhash64("t", "k").alias("key"), "node", "fp", "row_key"), "near-shards")
    shared = dealt.join(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "key", "left_semi")
    shared = written(shared.select("key", "node", "fp", "row_key"), "near-shared")
    texts = source.select("text", F.xxhash64("doc_id", "text").alias("row_key"))

    def shingle_sets(wanted: DataFrame, whole: bool) -> DataFrame:
        """(node, shingles) of the texts named by (node, row_key): distinct hashes, whole ones or their low 32 bits."""
        words, bits = filter_words(wanted, "row_key", wanted.count(), 32)
        passes = docs.sparkSession.sparkContext.broadcast(words)  # a bit filter, of bounded size

        def shingled(batches):
            seen = set()
            for batch in batches:
                for part, data, at in text_slices(batch, "text"):
                    names = part.column("row_key").to_numpy()
                    rows = [i for i in np.flatnonzero(in_filter(passes.value, bits, names.view(np.uint64))).tolist() if names[i] not in seen]
                    seen.update(names[rows].tolist())
                    raw = data.tobytes()
                    hashes = [shingle_hashes(raw[at[i] : at[i + 1]], width) for i in rows]
                    sets = [np.unique(h).view(np.int64) if whole else np.unique(h.astype(np.uint32)).view(np.int32) for h in hashes]
                    yield pa.RecordBatch.from_arrays([pa.array(names[rows], pa.int64()), pa.array(sets, pa.list_(pa.int64() if whole else pa.int32()))], names=["row_key", "shingles"])

        # texts stay where they are: the filter picks the wanted ones, and a few more that the join drops
        found = texts.mapInArrow(shingled, f"row_key long, shingles array<{'long' if whole else 'int'}>").join(wanted, "row_key")
        return written(found.select("node", "shingles").dropDuplicates(["node"]) if whole else found.select("node", "shingles"), "near-shingles")

    links = sharded_links(shared.select("key", "node", "fp"), radius, min_similarity, shingle_sets(shared.select("node", "row_key").distinct(), False))
    parts = written(connected(links, "near-groups"), "near-parts")
    pairs = written(open_pairs(texts, parts, frequent_hashes(rows.select(F.explode("sample").alias("h"))), width, min_similarity), "near-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = shingle_sets(written(nodes.select("node", F.col("first.row_key").alias("row_key")).join(ends, "node", "left_semi"), "near-ends"), True)
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").withColumn("both", F.size(F.array_intersect("x", "y")))
    late = both.where(F.col("both") >= F.lit(min_similarity) * (F.size("x") + F.size("y") - F.col("both"))).select("a", "b")
    roots = connected(parts.toDF("a", "b").unionByName(written(late, "near-late")), "near-groups")
    placed = nodes.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    names = placed.groupBy("root").agg(F.min("first").alias("best"))
    final = placed.join(names, "root").select("node", F.col("best.doc_id").alias("group_id"), F.col("best.row_key").alias("best_key"))
    return rows.select("doc_id", "row_key", "node").join(final, "node").select("row_key", "doc_id", "group_id", "best_key")
