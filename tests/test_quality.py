"""Validation, scores, trends, changes and refresh decisions on small cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from geoledger.operators import analytics as N
from geoledger.operators import changes as C
from geoledger.operators import quality as Q

SCHEMA = (
    "unique_id long, business_account_number long, ownership_name string, dba_name string, street_address string,"
    " zipcode string, business_start_date timestamp_ntz, business_end_date timestamp_ntz, naics_code string,"
    " longitude double, latitude double"
)
T0 = dt.datetime(2000, 1, 1)


@pytest.fixture(scope="module")
def businesses(spark):
    rows = [
        (1, 10, "Ann", "ANN", "1 MAIN ST", "94100", T0, T0 + dt.timedelta(1), "7201", -122.41, 37.77),
        (2, 10, "Bob", "Shop", "PIER", "94100", dt.datetime(1840, 1, 1), None, "7220-7229", -122.42, 37.78),
        (3, None, None, "Cat", "2 HILL WAY", "94101", dt.datetime(2100, 1, 1), None, None, None, None),
        (4, None, "Dan", None, "2 HILL WAY", None, T0, T0 - dt.timedelta(1), "1", -122.4123456789, 37.9),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_completeness(businesses):
    got = {r.field: (r.non_null_count, r.passes_threshold) for r in Q.check_completeness(businesses).collect()}
    assert got["unique_id"] == (4, True) and got["latitude"] == (3, False)
    assert "naics_code" in got and len(got) == 7


def test_coordinates_and_codes(businesses):
    r = Q.check_coordinates(businesses).first()
    assert (r.total_records, r.coordinates_in_city, r.passes_geographic_validation) == (4, 2, False)
    n = Q.check_naics(businesses).first()
    assert (n.unique_naics_count, n.valid_format_rate) == (4, 0.25)  # null is one value; 9 characters are too many


def test_duplicates_count_null_once_and_need_both_parts(businesses):
    r = Q.detect_duplicates(businesses).first()
    assert (r.unique_accounts, r.unique_name_address) == (2, 4)
    assert r.account_duplicate_rate == 0.5


def test_empty_table_has_no_division_by_zero(businesses):
    empty = businesses.where("1 = 0")
    assert Q.check_coordinates(empty).first().city_coverage_rate == 0.0
    assert Q.check_addresses(empty).first().passes_format_validation is False
    assert Q.score_validity(empty, T0).first().score == 1.0
    assert Q.detect_outliers(empty).first().outlier_count == 0
    assert Q.quality_score(empty, T0).first().quality_grade == "poor"


def test_scores(businesses):
    a = Q.score_accuracy(businesses).first()
    assert (a.geographic_accuracy, a.naics_format_accuracy, a.address_format_accuracy) == (0.5, 0.25, 0.75)
    with_mail = businesses.withColumn("email", F.lit("a@b.c"))
    assert Q.score_accuracy(with_mail).first().email_format_accuracy == 1.0
    c = Q.score_consistency(businesses).first()
    assert (c.name_consistency, c.date_consistency, c.coordinate_consistency) == (0.5, 0.5, None)
    assert c.score == 0.5  # no zip code has five rows
    v = Q.score_validity(businesses, dt.datetime(2024, 1, 1)).first()
    assert (v.start_date_validity, v.naics_validity) == (0.5, pytest.approx(1 / 3))
    assert v.coordinate_precision_validity == 0.5  # the poorer of the two axes
    u = Q.score_uniqueness(businesses).first()
    assert (u.account_uniqueness, u.name_address_uniqueness, u.coordinate_uniqueness) == (0.5, 1.0, 1.0)


def test_quality_score_is_the_weighted_mean_of_the_parts(businesses):
    now = dt.datetime(2024, 1, 1)
    r = Q.quality_score(businesses, now).first()
    parts = {
        "completeness": Q.overall_completeness(businesses, Q.SCORE_FIELDS).first()[0],
        "accuracy": Q.score_accuracy(businesses).first().score,
        "consistency": Q.score_consistency(businesses).first().score,
        "validity": Q.score_validity(businesses, now).first().score,
        "uniqueness": Q.score_uniqueness(businesses).first().score,
    }
    assert {k: r[k] for k in parts} == pytest.approx(parts)
    assert r.overall_score == pytest.approx(sum(Q.WEIGHTS[k] * v for k, v in parts.items()))
    alerts = {a.type for a in Q.quality_alerts(Q.quality_score(businesses, now)).collect()}
    assert alerts == {"overall_quality", "accuracy", "validity"}  # completeness is 5 / 6


@pytest.mark.parametrize("score,label", [(0.95, "excellent"), (0.85, "good"), (0.7, "fair"), (0.5, "poor"), (0.1, "poor")])
def test_grades(spark, score, label):
    assert spark.range(1).select(Q.grade(F.lit(score))).first()[0] == label


def test_outliers(spark):
    rows = [(i, 37.0 + i * 0.001, -122.0 + i * 0.001) for i in range(50)] + [(50, 45.0, -122.0), (51, None, None)]
    r = Q.detect_outliers(spark.createDataFrame(rows, "unique_id long, latitude double, longitude double")).first()
    assert (r.total_records, r.outlier_count, r.passes_outlier_check) == (52, 1, True)


def test_trends(spark):
    rows = [("a", T0 + dt.timedelta(i), s) for i, s in enumerate([0.5, 0.8, 0.9])]
    rows += [("b", T0, 0.9), ("b", T0 + dt.timedelta(1), 0.905), ("c", T0, 0.4)]
    h = spark.createDataFrame(rows, "dataset string, ts timestamp_ntz, score double")
    got = {r.dataset: (r.latest_score, r.previous_score, r.analysis_period, r.trend_direction) for r in Q.quality_trend(h).collect()}
    assert got == {"a": (0.9, 0.8, 3, "improving"), "b": (0.905, 0.9, 2, "stable")}
    d = Q.dimension_trend(h, dimension="dataset", last=2).collect()
    assert sorted((r.dataset, r.current, r.previous, r.trend) for r in d) == [
        ("a", 0.9, 0.8, "improving"), ("b", 0.905, 0.9, "improving")]


def test_changes(spark):
    rows = [("d", 1, 100, T0, ["a", "b"]), ("d", 2, 90, T0, ["a", "c"]), ("d", 3, 2000, T0 + dt.timedelta(1), ["c", "a"])]
    v = spark.createDataFrame(rows, "dataset_id string, version int, total_rows long, last_updated timestamp_ntz, columns array<string>")
    got = [tuple(r)[2:] for r in C.detect_changes(v).orderBy("version").collect()]
    assert got == [(-10, False, ["c"], ["b"], True), (1910, True, [], [], True)]


def test_freshness_and_alerts(spark):
    loads = spark.createDataFrame([("business_data", T0), ("building_data", T0)], "dataset string, ts timestamp_ntz")
    fresh = C.freshness_check(loads, T0 + dt.timedelta(days=7, seconds=1))
    got = {r.dataset: (r.is_fresh, r.exists) for r in fresh.collect()}
    assert got == {"business_data": (False, True), "building_data": (True, True), "spatial_joins": (False, False)}
    history = spark.createDataFrame([("q", T0, 0.8), ("q", T0 + dt.timedelta(1), 0.75)], "dataset string, ts timestamp_ntz, score double")
    alerts = C.monitor_alerts(fresh, Q.quality_trend(history))
    assert sorted((r.alert_type, r.severity, r.subject) for r in alerts.collect()) == [
        ("data_freshness", "warning", "business_data"), ("missing_table", "high", "spatial_joins"),
        ("quality_degradation", "medium", "q")]


def test_refresh_rules(spark):
    rows = [("business_refresh", T0, "success"), ("business_refresh", T0 + dt.timedelta(hours=2), "error"),
            ("business_refresh", T0 + dt.timedelta(hours=3), "error"), ("other", T0, "error")]
    e = spark.createDataFrame(rows, "event_type string, ts timestamp_ntz, status string")
    due = {r.event_type: r.needs_refresh for r in C.needs_refresh(e, T0 + dt.timedelta(hours=24)).collect()}
    assert due == {"business_refresh": False, "buildings_refresh": True}
    s = {r.event_type: (r.error_count, r.consecutive_failures, r.overall_status) for r in C.refresh_summary(e).collect()}
    assert s == {"business_refresh": (2, 2, "partial_failure"), "other": (1, 1, "partial_failure")}


@pytest.mark.parametrize("algorithm", ["xxhash64", "md5"])
def test_fingerprint_sees_content_not_order(spark, algorithm):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string")
    base = tuple(C.content_fingerprint(df, algorithm=algorithm).first())
    assert tuple(C.content_fingerprint(df.repartition(3).orderBy(F.desc("k")), algorithm=algorithm).first()) == base
    assert tuple(C.content_fingerprint(df.where("k = 1").unionByName(df.where("k = 1")), algorithm=algorithm).first()) != base
    changed = df.withColumn("v", F.coalesce("v", F.lit("")))
    assert C.content_fingerprint(changed, algorithm=algorithm).first().fingerprint != base[1]


def test_survival_leaves_out_what_is_not_yet_seen(spark):
    rows = [(dt.datetime(2000, 1, 1), dt.datetime(2000, 6, 1)), (dt.datetime(2000, 6, 1), None), (dt.datetime(2002, 6, 1), None)]
    df = spark.createDataFrame(rows, "business_start_date timestamp_ntz, business_end_date timestamp_ntz")
    got = {(r.cohort, r.years): (r.at_risk, r.surviving) for r in N.survival_rates(df, dt.datetime(2003, 1, 1), (1, 2)).collect()}
    assert got == {(2000, 1): (2, 1), (2000, 2): (2, 1)}


def test_trend_of_openings_and_closings(spark):
    rows = [("n", dt.datetime(2020, 1, 5), dt.datetime(2020, 3, 1)), ("n", dt.datetime(2020, 3, 9), None), ("n", None, None)]
    df = spark.createDataFrame(rows, "neighborhood string, business_start_date timestamp_ntz, business_end_date timestamp_ntz")
    got = [(r.openings, r.closings, r.net, r.active_total) for r in N.openings_closings_trend(df).orderBy("period").collect()]
    assert got == [(1, 0, 1, 1), (1, 1, 0, 1)]
