"""Importance weights against plain counting, held-out accuracy, and the sample's definition."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from geoledger.llm import importance, queries
from geoledger.llm.common import _BASE

from ..conftest import SF

M = (1 << 64) - 1


def mixed(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M
    x ^= x >> 29
    x = x * 0xC4CEB9FE1A85EC53 & M
    return x ^ x >> 32


def span_hash(token):
    return mixed((sum((b + 1) * pow(int(_BASE), i, 1 << 64) for i, b in enumerate(token)) + len(token)) & M)


def plain_grams(text):
    tokens = [span_hash(t) for t in re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t\n\x0b\x0c\r ]+", (text or "").encode())]
    return [g % importance.BUCKETS for g in tokens + [mixed((3 * a + b) & M) for a, b in zip(tokens, tokens[1:])]]


def plain_weights(docs, good):
    raw, target = Counter(), Counter()
    for i, text in docs:
        raw.update(g := plain_grams(text))
        if i in good:
            target.update(g)
    n, m = sum(raw.values()) + importance.BUCKETS, sum(target.values()) + importance.BUCKETS
    ratio = lambda g: math.log((target[g] + 1) / m) - math.log((raw[g] + 1) / n)
    return {i: importance.LENGTH * sum(map(ratio, g)) / (len(g) + importance.PRIOR) for i, text in docs for g in [plain_grams(text)]}


def test_weights_and_sample(spark):
    texts = ["good plain words here", "good words again, plain.", "BAD!! $$$ %%% ###", "", None, "bad $$$ bad", "é ñ ü " * 400, "words plain good"]
    docs = list(enumerate(texts * 3))
    labels = [(0, 1), (1, 1), (2, 0), (5, 0), (7, 1), (7, 1), (1, None), (None, 1), (99, 1)]
    left = spark.createDataFrame([(i, t, 1.5) for i, t in docs], "doc_id long, text string, score double")
    right = spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, text int")
    wanted = plain_weights(docs, {0, 1, 7})
    for k in (0, 1, 9, 24, 100):
        rows = importance.resample(left, right, k=k).collect()
        assert {r["doc_id"]: r["log_weight"] for r in rows} == pytest.approx(wanted)
        best = sorted((r["score"] for r in rows), reverse=True)[: k]
        assert {r["doc_id"] for r in rows if r["kept"]} == {r["doc_id"] for r in rows if r["score"] in best}
    rows = importance.resample(left, right).collect()
    assert len(rows) == 24 and not any(r["kept"] for r in rows if r["doc_id"] % 8 in (2, 5)) and sum(r["kept"] for r in rows) == 15


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, "a"), (None, None)], "doc_id long, text string")
    assert [r["kept"] for r in importance.resample(docs, none).collect()] == [True, True]
    assert importance.resample(docs.limit(0), none).collect() == []


def test_kth_largest(spark):
    values = [35, -10, 0, 20, 20, -(1 << 62), 1 << 40, -70_000]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert [importance.kth_largest(df, "v", k) for k in range(10)] == [None, *sorted(values, reverse=True), None]


def test_held_out_accuracy(spark):
    sf = SF.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r["kept"] for r in importance.resample(docs, labels.where("doc_id % 2 = 0")).collect()}
    held = [(r["quality"], rows[r["doc_id"]]) for r in labels.where("doc_id % 2 = 1").collect()]
    good, bad = [k for q, k in held if q == 1], [k for q, k in held if q == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.15 * len(bad)


def test_query_on_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    rows = queries.QUERIES["op6_importance"](spark, SF).collect()
    assert {r["doc_id"]: r["log_weight"] for r in rows} == pytest.approx(plain_weights(docs, good))
