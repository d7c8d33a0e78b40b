"""Exact search against all scores."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from geoledger.llm import va_file


def plain(rows, k):
    out = []
    for n, (q, a) in enumerate(rows):
        if q is not None and q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for m, (i, b) in enumerate(rows) if m != n and i is not None and len(b) == len(a))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def search(df, k, **options):
    q = va_file.quantised(df)
    return sorted(map(tuple, va_file.top_k(q, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)), k, **options).collect()))


def test_search(spark):
    rng = np.random.default_rng(3)
    vectors = [list(map(float, v)) for v in rng.normal(0, 0.3, (400, 8))]
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(400 + i, vectors[7]) for i in range(90)] + [(600 + i, [0.0] * 8) for i in range(41)] + [(800, [1.0] * 3), (820, [2.0] * 3), (840, [9.0])]
    bad = [(900, None), (920, [0.1] * 7 + [None]), (940, [0.1] * 7 + [math.nan]), (960, [0.1] * 7 + [math.inf]), (None, vectors[0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows + bad], "vec_id long, embedding array<float>, score string")
    floats = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows]
    for k, options in ((20, {}), (3, {"cells": 4, "block": 64, "query_block": 7, "batch": 4}), (1000, {"block": 100, "query_block": 8})):
        assert search(df, k, **options) == plain(floats, k)


def test_repeated_ids_and_small_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert search(spark.createDataFrame([], schema), 20) == []
    assert search(spark.createDataFrame([(20, [1.0])], schema), 20) == []
    assert search(spark.createDataFrame([(1, [1.0]), (2, [1.0])], schema), 20) == []
    assert search(spark.createDataFrame([(20, [1.0]), (20, [1.0]), (3, [2.0])], schema), 20) == [(20, 1, 3, 64 * 128), (20, 1, 3, 64 * 128), (20, 2, 20, 64 * 64), (20, 2, 20, 64 * 64)]


def test_large_components(spark):
    """Scores past 64 bits are ordered exactly and shown at the end of the range; bounds that round lose nothing."""
    rng = np.random.default_rng(5)
    for size in (2.0**24, 2.0**30, 1e17, 1e30):
        rows = [(i, [float(x) for x in rng.normal(0, size, 4)]) for i in range(120)] + [(200, [1.0] * 4), (201, [0.5] * 4), (220, [0.0] * 4)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        limit = 45 * 10**17  # 9e18 over the root of 4
        cut = [(i, [max(-limit, min(limit, math.floor(64 * x))) for x in v]) for i, v in rows]
        expected = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in plain(cut, 20)]
        assert search(df, 20) == expected
        assert search(df, 5, cells=4, block=16, query_block=2, batch=4) == [e for e in expected if e[1] <= 5]
