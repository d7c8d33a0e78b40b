"""Digest trees of table versions, product-limit curves, and fingerprints of odd texts."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from geoledger.operators import versions as V
from geoledger.operators.analytics import survival_curve
from geoledger.operators.changes import content_fingerprint


def test_changes_between_versions(spark, tmp_path):
    rnd = random.Random(2)
    old = [(i if i else None, rnd.choice(["a", None, ""]), rnd.choice([None, 1.5])) for i in range(600)] + [(7, "twice", 1.0)] * 2
    new = [r for r in old if r[0] not in (3, 50)] + [(7, "twice", 1.0), (1000, None, None), (1001, "", None)]
    new = [(i, "changed", x) if i in (None, 10, 11) else (i, x2, y) for (i, x2, y), x in ((r, r[2]) for r in new)]
    expected = {}
    before, after = defaultdict(Counter), defaultdict(Counter)
    for rows, side in ((old, before), (new, after)):
        for r in rows:
            side[r[0]][r[1:]] += 1
    for key in before.keys() | after.keys():
        if before.get(key) != after.get(key):
            expected[key] = "added" if key not in before else "removed" if key not in after else "changed"
    schema = "k long, v string, x double"
    for name, rows in (("old", old), ("new", new)):
        V.write_version(spark.createDataFrame(rows, schema), str(tmp_path / name), ["k"])
    got = V.version_changes(spark, str(tmp_path / "old"), str(tmp_path / "new"), ["k"])
    assert {r["k"]: r["change"] for r in got.collect()} == expected and set(expected.values()) == {"added", "removed", "changed"}
    leaves = V.differing_leaves(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    assert len(leaves) <= len(expected)  # other leaves are not read
    assert V._rows_in(spark, str(tmp_path / "new"), leaves).count() < 60
    assert V.differing_leaves(spark, str(tmp_path / "old"), str(tmp_path / "old")) == []
    assert V.version_changes(spark, str(tmp_path / "old"), str(tmp_path / "old"), ["k"]).collect() == []


def test_an_empty_version(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    V.write_version(rows, str(tmp_path / "some"), ["k"])
    V.write_version(rows.where("k > 5"), str(tmp_path / "none"), ["k"])
    for a, b, change in (("none", "some", "added"), ("some", "none", "removed")):
        assert {(r["k"], r["change"]) for r in V.version_changes(spark, str(tmp_path / a), str(tmp_path / b), ["k"]).collect()} == {(1, change), (2, change)}


def test_survival_curve(spark):
    rnd = random.Random(9)
    now = dt.datetime(2000, 1, 1)
    rows = []
    for i in range(300):
        start = dt.datetime(1995 + rnd.randrange(3), 1 + rnd.randrange(12), 1)
        end = None if rnd.random() < 0.4 else start + dt.timedelta(days=rnd.choice([-5, 0, 30, 30, 400, 900, 5000]))
        rows.append((start, end, rnd.choice(["a", "b", None])))
    rows += [(None, now, "a"), (dt.datetime(2001, 1, 1), None, "a")] + [(dt.datetime(1990, 1, 1), dt.datetime(1990, 1, 11), "all gone")] * 3
    df = spark.createDataFrame(rows, "business_start_date timestamp, business_end_date timestamp, naics_description string")
    groups = defaultdict(list)
    for start, end, kind in rows:
        if start is not None and start <= now:
            closed = end is not None and end <= now
            age = ((end if closed else now) - start).days
            if age >= 0:
                groups[start.year, kind].append((age, closed))
    want = {}
    for (cohort, kind), lives in groups.items():
        survival, spread = 1.0, 0.0
        for age in sorted({a for a, closed in lives if closed}):
            n, d = sum(a >= age for a, _ in lives), sum(a == age and closed for a, closed in lives)
            survival *= 1 - d / n
            spread += d / (n * (n - d)) if n > d else 0.0
            want[cohort, kind, age] = (n, d, survival, survival * math.sqrt(spread) if survival else None)
    got = {(r["cohort"], r["kind"], r["age_days"]): (r["at_risk"], r["closings"], r["survival"], r["std_error"]) for r in survival_curve(df, now).collect()}
    assert got.keys() == want.keys()
    for key in want:
        assert got[key] == pytest.approx(want[key], abs=1e-12) if want[key][3] is not None else got[key] == (*want[key][:2], 0.0, None)


def test_fingerprints_of_texts_with_separators(spark):
    pairs = [[("a\x1fb", "c")], [("a", "b\x1fc")], [("\x00", "c")], [(None, "c")], [("a\x1bSb", "c")]]
    prints = {content_fingerprint(spark.createDataFrame(rows, "x string, y string"), ["x", "y"], "md5").select(F.col("fingerprint")).first()[0] for rows in pairs}
    assert len(prints) == len(pairs)
