"""Spaced seeds: planted overlaps, and the query against a comparison of everything."""

from __future__ import annotations

import itertools
import random
import re

from geoledger.llm import queries, spaced_seeds

from ..conftest import SF


def tokens(text):
    return re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", (text or "").lower())


def plain_pairs(docs, items, width=13, identity=0.8):
    """Pairs with a window of 13 tokens (all of a shorter item) in which 80 % are equal and a seed fits."""
    masks = [[k for k, b in enumerate(m) if b == "1"] for m in spaced_seeds.MASKS]
    index = {}
    for i, text in items.items():
        t = tokens(text)
        for m in masks:
            for a in range(len(t) - m[-1]):
                index.setdefault(tuple([m[1], m[2], *(t[a + k] for k in m)]), []).append((i, a))
    out = set()
    for d, text in docs.items():
        t = tokens(text)
        shifts = {(i, a - b) for m in masks for a in range(len(t) - m[-1]) for i, b in index.get(tuple([m[1], m[2], *(t[a + k] for k in m)]), ())}
        for i, shift in shifts:
            item = tokens(items[i])
            w = min(width, len(item))
            equal = [0 <= k + shift < len(t) and t[k + shift] == x for k, x in enumerate(item)]
            inside = [0 <= k + shift < len(t) for k in range(len(item))]
            if any(sum(equal[k : k + w]) >= identity * w and all(inside[k : k + w]) for k in range(len(item) - w + 1)):
                out.add((d, i))
    return out


def test_planted(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(3000)] + ["the", "of", "Ünd"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: " ".join(say(rng.randint(14, 50))) for i in range(20)}
    items[20], items[21], items[22] = None, "", "only three words"
    items[23] = items[3]
    docs, planted = {}, set()
    for i in range(20):
        w = items[i].upper().split()
        docs[i] = ", ".join(say(30) + w + say(10))  # whole, other case and punctuation
        planted.add((i, i))
        w = items[i].split()
        w[len(w) // 2] = "other"
        docs[100 + i] = " ".join(say(200) + w)  # one word replaced
        planted.add((100 + i, i))
        docs[200 + i] = " ".join(say(20) + items[i].split()[:6] + say(20))  # six words only: clean
    docs[300], docs[301], docs[302] = None, "", "x " * 5000
    planted |= {(d, 23) for d, i in planted if i == 3}
    left = spark.createDataFrame([(d, t, "x") for d, t in docs.items()] + [(0, docs[0], "y")], "doc_id long, text string, item_id string")
    right = spark.createDataFrame([(i, t, 1) for i, t in items.items()] + [(None, items[1], 1)], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]) for r in spaced_seeds.contaminated(left, right).collect()}
    assert got == planted == plain_pairs(docs, items)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p")], "doc_id long, text string")
    assert spaced_seeds.contaminated(docs, items).collect() == []
    assert spaced_seeds.contaminated(some, items).collect() == []
    assert spaced_seeds.contaminated(docs, some.withColumnRenamed("doc_id", "item_id")).collect() == []


def test_query_on_whole_table(spark):
    read = lambda name, key: {r[key]: r["text"] for r in spark.read.parquet(f"{SF}/{name}.parquet").select(key, "text").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op4_spaced_seeds"](spark, SF).collect()}
    assert got and got == plain_pairs(read("documents", "doc_id"), read("benchmark", "item_id"))


def test_short_items_under_every_allowed_substitution(spark):
    items = {n: " ".join(f"i{n}x{k}" for k in range(n)) for n in range(1, 14)}
    docs, planted = [], set()
    for n, text in items.items():
        for gone in (g for k in range(n // 5 + 2) for g in itertools.combinations(range(n), min(k, n))):
            words = ["other" if k in gone else w for k, w in enumerate(text.split())]
            if n - len(gone) >= 0.8 * n:
                planted.add((len(docs), n))
            docs.append((len(docs), " ".join(["before", "it", *words, "after"])))
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(list(items.items()), "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in spaced_seeds.contaminated(left, right).collect()} == planted
