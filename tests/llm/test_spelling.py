"""Spelling variants against all pairs, trees against all boxes, and words against a plain count."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from geoledger.llm import spelling as S


def one_edit(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def plain(counts: dict[str, int], times: int = 5):
    forms = {}
    for w, n in counts.items():
        near = [v for v in counts if v != w and one_edit(v, w)]
        form = min(near, key=lambda v: (-counts[v], v), default=None)
        forms[w] = (len(near), form if form is not None and counts[form] >= times * n else None)
    out = []
    for w, n in counts.items():
        root = w
        while forms[root][1] is not None:
            root = forms[root][1]
        form = forms[w][1]
        out.append((w, n, forms[w][0], form, counts.get(form), root))
    return sorted(out)


def some_words(n: int, seed: int = 5) -> dict[str, int]:
    rnd = random.Random(seed)
    letters = "abcde" + "éÉ×ÿ"
    words = {}
    while len(words) < n:
        w = "".join(rnd.choice(letters) for _ in range(rnd.choice([6, 6, 7, 7, 8])))
        words[w] = rnd.choice([5, 6, 30, 200, 1500, 9000])
        for _ in range(rnd.choice([0, 0, 1, 3])):
            p = rnd.randrange(len(w))
            v = rnd.choice([w[:p] + w[p + 1 :], w[:p] + rnd.choice(letters) + w[p:], w[:p] + rnd.choice(letters) + w[p + 1 :]])
            if len(v) >= 6:
                words.setdefault(v, rnd.choice([5, 5, 6, 40, 200]))
    return words


@pytest.mark.parametrize("cell, leaf, crowd", [(S.CELL_WORDS, S.LEAF, S.PAIRS_AT_ONCE), (40, 4, 2), (7, 1, 50)])
def test_against_all_pairs(spark, monkeypatch, cell, leaf, crowd):
    monkeypatch.setattr(S, "CELL_WORDS", cell)
    monkeypatch.setattr(S, "LEAF", leaf)
    monkeypatch.setattr(S, "PAIRS_AT_ONCE", crowd)
    words = some_words(700)
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(tuple(r) for r in S.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert got == plain(words)


def test_anagrams_and_long_words(spark):
    words = {"".join(p): 5 for p in {tuple(random.Random(i).sample("aabbcdefgh", 10)) for i in range(300)}}
    words |= {"x" * 400: 7, "x" * 401: 60, "x" * 399 + "y": 5, "é" * 3000 + "abc": 9, "é" * 3000 + "abd": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert sorted(tuple(r) for r in S.variants(df).select("word", "n", "n_near", "form", "form_n", "root").collect()) == plain(words)
    assert S.variants(df.limit(0)).collect() == []


def test_searches_enter_every_cell_in_reach():
    rng = np.random.default_rng(2)
    codes = rng.integers(ord("a"), ord("h"), (600, 7)).astype(np.uint8)
    counts = S.letter_counts(codes)
    tree = S.CountTree(counts, 8)
    home = tree.homes(counts)
    for lose in (True, False):
        reached = {(int(r), leaf) for leaf, rows in tree.search(counts, lose) for r in rows}
        moved = [(r, y, x) for r in range(len(counts)) for y in range(8) for x in (range(y) if lose else (None,)) if x is None or counts[r, x]]
        for r, y, x in moved:
            v = counts[r].copy()
            v[y] += 1
            if x is not None:
                v[x] -= 1
            leaf = int(tree.homes(v[None, :])[0])
            assert (r, leaf) in reached
    assert sorted(np.concatenate(tree.leaves)) == list(range(600)) and (home >= 0).all()


def test_words(spark):
    rows = [(i, t, "x") for i, t in enumerate(["Straße ÄÖß " * 6, None, "", "abcdef " * 7 + "x1abcdef2" * 3, "Ünïque WORDS—words×words " * 9])]
    rows += [(1000 + i, "letters words spelling " * 3, "x") for i in range(400)] + [(None, "nullid " * 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    expected = Counter()
    for i, text, _ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            expected[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    got = {r["word"]: r["n"] for r in S.corpus_words(docs).collect()}
    assert got == {w: n for w, n in expected.items() if len(w) >= 6 and n >= 5}
