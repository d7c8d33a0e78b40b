"""Group profiles, quantiles, samples and upserts against plain Python."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoledger.operators import pyramid as Z
from geoledger.operators import upsert as U
from geoledger.operators.quantiles import exact_quantiles
from geoledger.operators.rollup import facet_rollup


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    out = [(rnd.choice("ab"), rnd.choice([None, "x", "y", "z"]), rnd.choice(["p", "q", None]), i, rnd.random()) for i in range(300)]
    return [*out, ("single", None, None, 300, 1.0), (None, "x", "p", 301, 2.0)]


def test_facet_rollup(spark, rows):
    df = spark.createDataFrame(rows, "k string, code string, kind string, id long, v double")
    out = facet_rollup(
        df, ["k"], "n", distinct={"codes": "code", "kinds": "kind"}, modes={"top": "code"}, firsts={"first": "kind"},
        first_by="id", sums={"total": F.col("v")}, mins={"low": F.col("v")}, maxs={"high": F.col("v")})
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    got = {r.k: r for r in out.collect()}
    assert set(got) == set(groups)
    for k, g in groups.items():
        counts = collections.Counter(r[1] for r in g if r[1] is not None)
        top = min(counts, key=lambda c: (-counts[c], c)) if counts else None
        r = got[k]
        assert (r.n, r.codes, r.kinds, r.top) == (len(g), len({x[1] for x in g}), len({x[2] for x in g}), top)
        assert r["first"] == min(g, key=lambda x: x[3])[2]
        assert r.total == pytest.approx(sum(x[4] for x in g))
        assert (r.low, r.high) == (min(x[4] for x in g), max(x[4] for x in g))


def test_facet_rollup_weighted(spark):
    df = spark.createDataFrame([("a", "x", 5), ("a", "y", 2), ("a", "y", 2)], "k string, code string, w int")
    r = facet_rollup(df, ["k"], "n", distinct={"codes": "code"}, modes={"top": "code"}, weight=F.col("w")).first()
    assert (r.n, r.codes, r.top) == (9, 2, "x")


@pytest.mark.parametrize("values", [
    [1.0], [1.0, 2.0], [5.0] * 50, list(range(101)), [random.Random(1).gauss(0, 1) for _ in range(997)],
    [0.0] + [100 + i * 1e-6 for i in range(200)], [-1e12, 1e300, *[37.7 + i % 700 * 1e-4 for i in range(3000)]]])
def test_exact_quantiles(spark, values):
    df = spark.createDataFrame([(float(v), -float(v)) for v in values] + [(None, None)], "x double, y double")
    probs = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {(r["column"], r.probability): r.value for r in exact_quantiles(df, ["x", "y"], probs).collect()}
    for p in probs:
        assert got["x", p] == pytest.approx(float(np.quantile(np.array(values, dtype=float), p)))
        assert got["y", p] == pytest.approx(float(np.quantile(-np.array(values, dtype=float), p)))


@pytest.mark.parametrize("n", [0, 1, 37, 500, 2000])
def test_sample_has_exact_size_and_repeats(spark, n):
    df = spark.range(500).withColumnRenamed("id", "k")
    first = {r.k for r in Z.sample_points(df.repartition(7), n, "k").collect()}
    again = {r.k for r in Z.sample_points(df.repartition(3), n, "k").collect()}
    assert first == again and len(first) == min(n, 500)


def test_sample_survives_a_hot_key(spark):
    df = spark.createDataFrame([(7,)] * 200 + [(i,) for i in range(100, 200)], "k long")
    assert Z.sample_points(df, 150, "k").count() == 150


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "B"), (3, "c"), (3, "d")], "k int, v string")
    ignore = U.upsert_ignore(old, new, ["k"], F.col("v"))
    update = U.upsert_update(old, new, ["k"], F.col("v"))
    assert sorted(map(tuple, ignore.collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, update.collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert sorted(map(tuple, U.upsert_ignore(update, new, ["k"], F.col("v")).collect())) == sorted(map(tuple, update.collect()))


def test_pyramid_counts_agree_on_every_level(tables):
    located = tables.businesses.where("longitude is not null").count()
    levels = Z.zoom_pyramid(tables.businesses)
    sums = {r.zoom_level: r.n for r in levels.groupBy("zoom_level").agg(F.sum("business_count").alias("n")).collect()}
    assert sums == {z: located for z in range(1, 13)}
    top = {r.zoom_level: r.features for r in Z.pyramid_summary(Z.zoom_pyramid(tables.businesses, top=20)).collect()}
    cells = {r.zoom_level: r.features for r in Z.pyramid_summary(levels).collect()}
    assert top == {z: min(20, n) for z, n in cells.items()} and max(cells.values()) > 20


def test_pyramid_box_and_single_family(tables):
    box = (-122.42, 37.765, -122.40, 37.78)
    inside = tables.businesses.where("longitude between -122.42 and -122.40 and latitude between 37.765 and 37.78").count()
    only = Z.zoom_pyramid(tables.businesses, [10], box)
    assert only.agg(F.sum("business_count")).first()[0] == inside
    with pytest.raises(ValueError):
        Z.zoom_pyramid(tables.businesses, [15])
