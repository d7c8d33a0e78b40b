"""Fingerprints, BK-trees and components against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from geoledger.llm import queries, simhash_bk

from ..conftest import SF


def plain_fingerprint(text: str | None, width: int = 4) -> int:
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(keys: list, joined) -> dict:
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(keys, 2):
        if joined(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: find(k) for k in keys}


def check_components(rows, texts):
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    distinct = sorted(set(fps.values()))
    root = plain_components(distinct, lambda a, b: (a ^ b).bit_count() <= 4)
    first = {}
    for i, fp in fps.items():
        first[root[fp]] = min(first.get(root[fp], i), i)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(i, f"{fp:016x}", first[root[fp]]) for i, fp in fps.items()}


def test_odd_texts(spark):
    texts = dict(enumerate([None, "", " \t\n", "one", "One", "a b c", "A B C d", "a b c d e", "É é\x0b x\x0c\x1c y z", "\xa0 x", "w " * 30_000, "w " * 30_001, "a b c d e"]))
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, fp string")
    check_components(simhash_bk.near_components(docs).collect(), texts)


def test_query_on_whole_table(spark):
    rows = queries.QUERIES["op8_simhash_bk"](spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    check_components(rows, {r["doc_id"]: r["text"] for r in docs})


def test_empty_table(spark):
    assert simhash_bk.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("radius", [0, 2, 4, 9])
def test_tree_finds_all_within_radius(radius):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    values = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(8)] + [base]))
    got = {(n, int(p)) for n, near in simhash_bk.BKTree(values).within(values, radius) for p in near}
    assert got == {(i, j) for i in range(len(values)) for j in range(len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= radius}


def test_large_shards_are_cut_and_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash_bk, "SHARD_ROWS", 8)
    rng = random.Random(2)
    fps = {rng.getrandbits(63) for _ in range(10)}
    for f in list(fps):
        for _ in range(12):
            f ^= 1 << rng.randrange(63)
            fps.add(f)
    members = spark.createDataFrame([(0, f, f) for f in fps], "key long, node long, fp long")
    links = [(r["a"], r["b"]) for r in simhash_bk.sharded_links(members, 1).collect()]
    wanted = plain_components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 1)
    assert plain_components(sorted(fps), lambda a, b: (a, b) in set(links) or (b, a) in set(links)) == wanted


def test_similar_groups(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    texts, n = {}, 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(6, 120))]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[n] = " ".join(copy)
            n += 1
    texts[n], texts[n + 1] = "", None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (t or "").split()) else frozenset() for i, t in texts.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    wanted = plain_components(sorted(texts), alike)
    got = {r["doc_id"]: r["group_id"] for r in simhash_bk.near_groups(docs, radius=64, tables=12).collect()}
    assert got == wanted


def test_no_pair_at_the_limit_is_lost(spark):
    """Lone pairs at 0.80 to 0.85: many differ in over 14 bits, some share none of four min-hashes."""
    rng = random.Random(4)
    texts, pairs, far, n = {}, [], 0, 0
    shingles = lambda words: {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    common = [f"c{i}" for i in range(30)]  # a passage of all texts
    while len(pairs) < 300:
        base = [*common, *[f"w{rng.randrange(10**6)}" for _ in range(rng.randint(100, 400))]]
        copy = list(base)
        for _ in range(rng.randint(3, 12)):
            copy[rng.randrange(30, len(copy))] = f"w{rng.randrange(10**6)}"
        a, b = shingles(base), shingles(copy)
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            texts[n], texts[n + 1] = " ".join(base), " ".join(copy)
            far += (plain_fingerprint(texts[n], 5) ^ plain_fingerprint(texts[n + 1], 5)).bit_count() > 14
            pairs.append((n, n + 1))
            n += 2
    assert far
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash_bk.near_groups(docs).collect()}
    assert got == {i: a for a, b in pairs for i in (a, b)}


def test_second_step_alone_is_exact_with_crowded_keys(spark, monkeypatch):
    """Without any link from the first step, keys of all texts cut into blocks give the same groups."""
    monkeypatch.setattr(simhash_bk, "SHARD_ROWS", 8)
    rng = random.Random(6)
    texts = {}
    for n in range(60):
        words = [f"x{i}" for i in range(60)]
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"y{rng.randrange(10**6)}"
        texts[n] = " ".join(words)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in texts.items() for w in [t.split()]}
    wanted = plain_components(sorted(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["group_id"] for r in simhash_bk.near_groups(docs, radius=-1).collect()}
    assert got == wanted


@pytest.mark.parametrize("agreeing", [1, 2, 3, 4])
def test_every_choice_of_blocks_keeps_every_link(spark, agreeing):
    rng = random.Random(agreeing)
    values = [rng.getrandbits(64) for _ in range(150)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))) for v in values[:120]]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    keys = simhash_bk.block_keys("fp", 4, agreeing)
    members = spark.createDataFrame([(v, v) for v in signed], "node long, fp long").select(simhash_bk.F.explode(keys).alias("key"), "node", "fp")
    got = {tuple(sorted(p)) for p in simhash_bk.sharded_links(members, 4).collect()}
    close = [(a, b) for a, b in itertools.combinations(range(len(values)), 2) if (values[a] ^ values[b]).bit_count() <= 4]
    root = plain_components(signed, lambda a, b: tuple(sorted((a, b))) in got)
    assert close and got <= {tuple(sorted((signed[a], signed[b]))) for a, b in close}
    assert all(root[signed[a]] == root[signed[b]] for a, b in close)


def test_shards_do_not_grow_with_the_table():
    for nodes in (10**5, 10**7, 10**9, 10**11):
        m = simhash_bk.agreeing_blocks(nodes, 4)
        assert nodes / 2 ** (64 * m // (4 + m)) <= simhash_bk.SHARD_ROWS
    assert [simhash_bk.agreeing_blocks(10**e, 4) for e in (5, 7, 9, 11)] == [1, 2, 2, 3]  # blocks of 12 bits or more
