"""Validation checks, quality scores, trends and alerts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import moment
from .aggregates import one_row, per_group_cap
from .quantiles import exact_quantiles
from .rollup import distinct_with_null

# Bounds, thresholds, patterns, weights and grades.
CITY_LAT = (37.7049, 37.8089)
CITY_LON = (-122.5110, -122.3816)
VALIDATION_FIELDS = (
    "unique_id", "ownership_name", "dba_name", "street_address", "longitude", "latitude", "naics_code",
)
SCORE_FIELDS = ("unique_id", "dba_name", "street_address", "latitude", "longitude", "naics_code")
THRESHOLDS = {
    "completeness": 0.80, "coordinates": 0.95, "naics": 0.80, "outliers": 0.02, "geometries": 0.90,
    "addresses": 0.85,
}
STARTS_WITH_NUMBER = r"^\d+"
STREET_WORDS = (
    r"(?i)(street|st|avenue|ave|boulevard|blvd|road|rd|drive|dr|lane|ln|way|ct|circle|pl|place)"
)
NAICS_PATTERN = r"^\d{2,6}$"
EMAIL_PATTERN = r"^[^@]+@[^@]+\.[^@]+$"
WEIGHTS = {"completeness": 0.25, "accuracy": 0.25, "consistency": 0.20, "validity": 0.20, "uniqueness": 0.10}
GRADES = ((0.95, "excellent"), (0.85, "good"), (0.70, "fair"), (0.50, "poor"))
ALERT_LIMITS = (
    ("overall_score", 0.70, "overall_quality", "high"),
    ("completeness", 0.80, "completeness", "medium"),
    ("accuracy", 0.85, "accuracy", "medium"),
    ("validity", 0.80, "validity", "medium"),
)
MIN_ZIP_ROWS = 5
EARLIEST_START = dt.datetime(1850, 1, 1)


def _rows() -> Column:
    return F.count(F.lit(1))


def rate(part: Column | str, whole: Column | str, empty: float = 0.0) -> Column:
    """part / whole, or ``empty`` where there is nothing to divide by."""
    part = F.col(part) if isinstance(part, str) else part
    whole = F.col(whole) if isinstance(whole, str) else whole
    return F.when(whole > 0, part / whole).otherwise(F.lit(empty))


def _in_city() -> Column:
    return F.col("latitude").between(*CITY_LAT) & F.col("longitude").between(*CITY_LON)


def _mean(columns: Sequence[str]) -> Column:
    total = F.col(columns[0])
    for name in columns[1:]:
        total = total + F.col(name)
    return total / len(columns)


# Validation ---------------------------------------------------------------


def check_completeness(df: DataFrame, fields: Sequence[str] = VALIDATION_FIELDS) -> DataFrame:
    """Per required field: non-null count and rate, in one pass over the table."""
    present = [f for f in fields if f in df.columns]
    counts = df.agg(_rows().alias("total_count"), *[F.count(f).alias(f) for f in present])
    entry = F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).alias("non_null_count")) for f in present
    ])
    return (
        counts.select("total_count", F.inline(entry))
        .withColumn("completeness_rate", rate("non_null_count", "total_count"))
        .withColumn("passes_threshold", F.col("completeness_rate") >= THRESHOLDS["completeness"])
    )


def overall_completeness(df: DataFrame, fields: Sequence[str] = VALIDATION_FIELDS) -> DataFrame:
    present = [f for f in fields if f in df.columns]
    counts = df.agg(_rows().alias("_t"), *[F.count(f).alias(f"_{f}") for f in present])
    rates = counts.select(*[rate(f"_{f}", "_t").alias(f) for f in present])
    return rates.select(_mean(present).alias("overall_completeness"))


def check_coordinates(df: DataFrame) -> DataFrame:
    out = df.agg(
        _rows().alias("total_records"),
        F.count("latitude").alias("_lat"), F.count("longitude").alias("_lon"),
        F.count_if(_in_city()).alias("coordinates_in_city"),
    )
    coverage = rate("coordinates_in_city", "total_records")
    return out.select(
        "total_records", "coordinates_in_city", coverage.alias("city_coverage_rate"),
        rate("_lat", "total_records").alias("latitude_completeness"),
        rate("_lon", "total_records").alias("longitude_completeness"),
        (coverage >= THRESHOLDS["coordinates"]).alias("passes_geographic_validation"),
    )


def check_naics(df: DataFrame) -> DataFrame:
    out = df.agg(
        _rows().alias("total_records"), F.count("naics_code").alias("_present"),
        distinct_with_null("naics_code").alias("unique_naics_count"),
        F.count_if(F.char_length("naics_code").between(2, 6)).alias("_valid"),
    )
    coverage = rate("_present", "total_records")
    return out.select(
        "total_records", coverage.alias("naics_coverage_rate"), "unique_naics_count",
        rate("_valid", "total_records").alias("valid_format_rate"),
        (coverage >= THRESHOLDS["naics"]).alias("passes_naics_validation"),
    )


def _name_address() -> Column:
    # null if either part is null
    return F.concat(F.col("dba_name"), F.lit("|"), F.col("street_address"))


def detect_duplicates(df: DataFrame) -> DataFrame:
    """Share of rows that repeat an account, or a name and address."""
    out = df.agg(
        _rows().alias("total_records"),
        distinct_with_null("business_account_number").alias("unique_accounts"),
        distinct_with_null(_name_address()).alias("unique_name_address"),
    )
    return out.select(
        "*",
        F.when(F.col("total_records") > 0, 1 - F.col("unique_accounts") / F.col("total_records"))
        .otherwise(0.0).alias("account_duplicate_rate"),
        F.when(F.col("total_records") > 0, 1 - F.col("unique_name_address") / F.col("total_records"))
        .otherwise(0.0).alias("name_address_duplicate_rate"),
    )


def detect_outliers(df: DataFrame) -> DataFrame:
    """Coordinates more than 1.5 interquartile ranges outside the quartiles."""
    quartiles = exact_quantiles(df, ["latitude", "longitude"], [0.25, 0.75])

    def quartile(column: str, p: float) -> Column:
        return F.max(F.when((F.col("column") == column) & (F.col("probability") == p), F.col("value")))

    named = quartiles.agg(*[
        quartile(column, p).alias(f"{axis}_q{q}")
        for axis, column in (("lat", "latitude"), ("lon", "longitude")) for q, p in ((1, 0.25), (3, 0.75))
    ])
    limits = []
    for axis in ("lat", "lon"):
        spread = 1.5 * (F.col(f"{axis}_q3") - F.col(f"{axis}_q1"))
        limits += [
            (F.col(f"{axis}_q1") - spread).alias(f"{axis}_lower"), (F.col(f"{axis}_q3") + spread).alias(f"{axis}_upper"),
        ]
    box = named.select(F.struct(*limits).alias("b"))
    lat, lon = F.col("latitude"), F.col("longitude")
    outside = (
        (lat < F.col("b.lat_lower")) | (lat > F.col("b.lat_upper"))
        | (lon < F.col("b.lon_lower")) | (lon > F.col("b.lon_upper"))
    )
    out = df.select("latitude", "longitude", box.scalar().alias("b")).agg(
        _rows().alias("total_records"), F.count_if(outside).alias("outlier_count"),
        F.any_value("b").alias("b"), F.avg("latitude").alias("lat_mean"), F.avg("longitude").alias("lon_mean"),
    )
    share = rate("outlier_count", "total_records")
    return out.select(
        "total_records", "outlier_count", share.alias("outlier_rate"), "b.*", "lat_mean", "lon_mean",
        (share <= THRESHOLDS["outliers"]).alias("passes_outlier_check"),
    )


def check_geometries(df: DataFrame, geometry: str = "geom_wkt") -> DataFrame:
    out = df.agg(
        _rows().alias("total_buildings"), F.count(geometry).alias("_present"),
        F.count_if(F.startswith(F.col(geometry), F.lit("POLYGON"))).alias("_polygons"),
    )
    valid = rate("_polygons", "total_buildings")
    return out.select(
        "total_buildings", rate("_present", "total_buildings").alias("geometry_completeness"),
        valid.alias("valid_polygon_rate"),
        ((F.col("total_buildings") > 0) & (valid >= THRESHOLDS["geometries"])).alias("passes_geometry_validation"),
    )


def check_addresses(df: DataFrame) -> DataFrame:
    address = F.col("street_address")
    out = df.agg(
        _rows().alias("total_records"), F.count(address).alias("_present"),
        F.count_if(address.rlike(STARTS_WITH_NUMBER)).alias("_numbered"),
        F.count_if(address.rlike(STREET_WORDS)).alias("_street"),
    )
    valid = rate("_numbered", "total_records")
    return out.select(
        "total_records", rate("_present", "total_records").alias("address_completeness"),
        valid.alias("valid_format_rate"), rate("_street", "total_records").alias("street_type_coverage"),
        ((F.col("total_records") > 0) & (valid >= THRESHOLDS["addresses"])).alias("passes_format_validation"),
    )


def validation_report(businesses: DataFrame, buildings: DataFrame | None = None) -> DataFrame:
    """One row: the checks that count and their mean. All counts over the businesses come from one pass; outliers need their quartiles first."""
    present = [f for f in VALIDATION_FIELDS if f in businesses.columns]
    counts = businesses.agg(
        _rows().alias("_t"), *[F.count(f).alias(f"_{f}") for f in present], F.count_if(_in_city()).alias("_city"),
        F.count("naics_code").alias("_code"), F.count("street_address").alias("_address"),
    )
    parts = [
        counts.select(
            *[rate(f"_{f}", "_t").alias(f) for f in present], rate("_city", "_t").alias("coordinates"), rate("_code", "_t").alias("naics"), rate("_address", "_t").alias("addresses"),
        ).select(_mean(present).alias("completeness"), "coordinates", "naics", "addresses"),
        detect_outliers(businesses).select(F.when(F.col("passes_outlier_check"), 1.0).otherwise(0.5).alias("outliers")),
    ]
    if buildings is not None:
        parts.append(check_geometries(buildings).select(F.col("valid_polygon_rate").alias("geometries")))
    names = [c for c in ("completeness", "coordinates", "naics", "outliers", "addresses", "geometries") if any(c in p.columns for p in parts)]
    return one_row(*parts).select(
        *names, _mean(names).alias("overall_score"), F.lit(len(names)).alias("total_checks")
    )


# Quality scores -----------------------------------------------------------


Checks = tuple[dict[str, Column], dict[str, Column]]  # counts over the table, scores over the counts


def _score_frame(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    out = df.select(*[c.alias(n) for n, c in checks.items()])
    return out.withColumn("score", _mean(list(checks)))


def _counted(df: DataFrame, *checks: Checks) -> DataFrame:
    """All counts of the given checks in one pass over the table."""
    counts = {name: col for aggs, _ in checks for name, col in aggs.items()}
    return df.agg(_rows().alias("_t"), *[c.alias(n) for n, c in counts.items()])


def _completeness_checks(df: DataFrame, fields: Sequence[str]) -> Checks:
    present = [f for f in fields if f in df.columns]
    return {f"_has_{f}": F.count(f) for f in present}, {f: rate(f"_has_{f}", "_t") for f in present}


def _accuracy_checks(df: DataFrame) -> Checks:
    aggs = {
        "_in_city": F.count_if(_in_city()),
        "_code_length": F.count_if(F.char_length("naics_code").between(2, 6)),
        "_numbered": F.count_if(F.col("street_address").rlike(STARTS_WITH_NUMBER)),
    }
    scores = {
        "geographic_accuracy": rate("_in_city", "_t"), "naics_format_accuracy": rate("_code_length", "_t"),
        "address_format_accuracy": rate("_numbered", "_t"),
    }
    if "email" in df.columns:
        aggs["_email"] = F.count_if(F.col("email").rlike(EMAIL_PATTERN))
        scores["email_format_accuracy"] = rate("_email", "_t")
    return aggs, scores


def _consistency_checks() -> Checks:
    start, end = F.col("business_start_date"), F.col("business_end_date")
    aggs = {
        "_same_name": F.count_if(F.lower("dba_name") == F.lower("ownership_name")),
        "_both_names": F.count_if(F.col("dba_name").isNotNull() & F.col("ownership_name").isNotNull()),
        "_ordered": F.count_if(start <= end),
        "_both_dates": F.count_if(start.isNotNull() & end.isNotNull()),
    }
    return aggs, {
        "name_consistency": rate("_same_name", "_both_names", 1.0),
        "date_consistency": rate("_ordered", "_both_dates", 1.0),
    }


def _validity_checks(now: dt.datetime, naics_pattern: str) -> Checks:
    start, lat, lon = F.col("business_start_date"), F.col("latitude"), F.col("longitude")
    aggs = {
        "_start_ok": F.count_if(start.between(moment(EARLIEST_START), moment(now))), "_start": F.count(start),
        "_code_ok": F.count_if(F.col("naics_code").rlike(naics_pattern)), "_code": F.count("naics_code"),
        "_lat_ok": F.count_if(F.bround(lat, 6) == lat), "_lon_ok": F.count_if(F.bround(lon, 6) == lon),
    }
    return aggs, {
        "start_date_validity": rate("_start_ok", "_start", 1.0),
        "naics_validity": rate("_code_ok", "_code", 1.0),
        "coordinate_precision_validity": rate(F.least("_lat_ok", "_lon_ok"), "_t", 1.0),
    }


def _zip_spread(df: DataFrame) -> DataFrame:
    """Average spread of the coordinates of a zip code; nulls if none has enough rows."""
    zips = df.groupBy("zipcode").agg(
        F.stddev_samp("latitude").alias("lat_std"), F.stddev_samp("longitude").alias("lon_std"), _rows().alias("n")
    ).where(F.col("n") >= MIN_ZIP_ROWS)
    return zips.agg(F.avg("lat_std").alias("_zip_lat"), F.avg("lon_std").alias("_zip_lon"))


def score_accuracy(df: DataFrame) -> DataFrame:
    checks = _accuracy_checks(df)
    return _score_frame(_counted(df, checks), checks[1])


def _consistency_scores(counted: DataFrame) -> DataFrame:
    """Adds the zip check and the consistency score to rows with counts and zip spread."""
    zip_check = F.greatest(F.lit(0.0), 1 - (F.col("_zip_lat") + F.col("_zip_lon")) * 100)
    plain = counted.withColumns(_consistency_checks()[1])
    two = F.col("name_consistency") + F.col("date_consistency")
    has_zips = F.col("_zip_lat").isNotNull()
    return plain.withColumn("coordinate_consistency", F.when(has_zips, zip_check)).withColumn(
        "consistency", F.when(has_zips, (two + F.col("coordinate_consistency")) / 3).otherwise(two / 2)
    )


def score_consistency(df: DataFrame) -> DataFrame:
    """Equal names, ordered dates, and how tightly a zip code's points lie together.

    Without a zip code of MIN_ZIP_ROWS rows the mean is over two checks.
    """
    both = one_row(_counted(df, _consistency_checks()), _zip_spread(df))
    return _consistency_scores(both).select(
        "name_consistency", "date_consistency", "coordinate_consistency", F.col("consistency").alias("score")
    )


def score_validity(df: DataFrame, now: dt.datetime, naics_pattern: str = NAICS_PATTERN) -> DataFrame:
    checks = _validity_checks(now, naics_pattern)
    return _score_frame(_counted(df, checks), checks[1])


def score_uniqueness(df: DataFrame) -> DataFrame:
    position = F.concat(F.col("latitude").cast("string"), F.lit(","), F.col("longitude").cast("string"))
    counts = df.agg(
        _rows().alias("_t"),
        distinct_with_null("business_account_number").alias("_a"),
        distinct_with_null(_name_address()).alias("_n"),
        distinct_with_null(position).alias("_p"),
    )
    return _score_frame(counts, {
        "account_uniqueness": rate("_a", "_t", 1.0),
        "name_address_uniqueness": rate("_n", "_t", 1.0),
        "coordinate_uniqueness": rate("_p", "_t", 1.0),
    })


def quality_score(
    df: DataFrame, now: dt.datetime, fields: Sequence[str] = SCORE_FIELDS, weights: Mapping[str, float] = WEIGHTS
) -> DataFrame:
    """One row: five dimension scores, the weighted score, grade and row count.

    Three passes: all counts, the zip codes, the distinct counts.
    """
    complete, accurate, valid = _completeness_checks(df, fields), _accuracy_checks(df), _validity_checks(now, NAICS_PATTERN)
    counted = _counted(df, complete, accurate, valid, _consistency_checks())
    unique = score_uniqueness(df).select(F.col("score").alias("uniqueness"))
    scored = _consistency_scores(one_row(counted, _zip_spread(df), unique))

    def mean(checks: Checks) -> Column:
        columns = list(checks[1].values())
        return sum(columns[1:], columns[0]) / len(columns)

    scored = scored.withColumns({"completeness": mean(complete), "accuracy": mean(accurate), "validity": mean(valid)})
    overall = None
    for name, weight in weights.items():
        term = F.col(name) * F.lit(weight)
        overall = term if overall is None else overall + term
    return scored.select(*weights, F.col("_t").alias("total_records"), overall.alias("overall_score")).withColumn(
        "quality_grade", grade(F.col("overall_score"))
    )


def grade(score: Column) -> Column:
    chain = F
    for least, label in GRADES:
        chain = chain.when(score >= least, F.lit(label))
    return chain.otherwise(F.lit("poor"))


def score_checks(df: DataFrame, now: dt.datetime) -> DataFrame:
    """Long form (dimension, check, score) of all individual checks."""
    parts = {
        "accuracy": score_accuracy(df), "consistency": score_consistency(df),
        "validity": score_validity(df, now), "uniqueness": score_uniqueness(df),
    }
    out = check_completeness(df, SCORE_FIELDS).select(
        F.lit("completeness").alias("dimension"), F.col("field").alias("check"), F.col("completeness_rate").alias("score")
    )
    for dimension, part in parts.items():
        checks = [c for c in part.columns if c != "score"]
        entries = F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("score")) for c in checks])
        out = out.unionByName(part.select(F.lit(dimension).alias("dimension"), F.inline(entries)))
    return out


def quality_alerts(scores: DataFrame, limits: Sequence[tuple[str, float, str, str]] = ALERT_LIMITS) -> DataFrame:
    """One alert per score that is below its threshold."""
    entries = F.array(*[
        F.struct(
            F.lit(kind).alias("type"), F.lit(severity).alias("severity"),
            F.col(column).alias("current_value"), F.lit(float(limit)).alias("threshold"),
        )
        for column, limit, kind, severity in limits
    ])
    alerts = scores.select(F.inline(entries)).where(F.col("current_value") < F.col("threshold"))
    message = F.format_string(
        "%s score (%.2f%%) is below threshold (%.2f%%)",
        F.initcap(F.replace(F.col("type"), F.lit("_"), F.lit(" "))),
        F.col("current_value") * 100, F.col("threshold") * 100,
    )
    return alerts.withColumn("message", message)


# Trends -------------------------------------------------------------------


def quality_trend(
    history: DataFrame, by: Sequence[str] = ("dataset",), ts: str = "ts", score: str = "score",
    tie: Sequence[str] = (), tolerance: float = 0.01,
) -> DataFrame:
    """Latest against previous score per dataset, with the number of scores."""
    order = [F.desc(ts), *[F.desc(t) for t in tie]]
    window = Window.partitionBy(*by).orderBy(*order)
    latest = history.withColumn("_rank", F.row_number().over(window)).where("_rank <= 2")
    pair = latest.groupBy(*by).agg(
        F.max(F.when(F.col("_rank") == 1, F.col(score))).alias("latest_score"),
        F.max(F.when(F.col("_rank") == 2, F.col(score))).alias("previous_score"),
    )
    periods = history.groupBy(*by).agg(_rows().alias("analysis_period"))
    change = F.col("latest_score") - F.col("previous_score")
    return (
        pair.join(periods, list(by))
        .where(F.col("analysis_period") >= 2)
        .withColumn("score_change", change)
        .withColumn(
            "trend_direction",
            F.when(change > tolerance, "improving").when(change < -tolerance, "declining").otherwise("stable"),
        )
    )


def dimension_trend(
    history: DataFrame, dimension: str = "dimension", ts: str = "ts", score: str = "score",
    tie: Sequence[str] = (), last: int = 10,
) -> DataFrame:
    """Change between neighbouring scores over the last ``last`` per dimension."""
    order = [F.desc(ts), *[F.desc(t) for t in tie]]
    recent = per_group_cap(history, dimension, last, *order)
    forward = Window.partitionBy(dimension).orderBy(ts, *tie)
    change = F.col(score) - F.col("previous")
    return (
        recent.withColumn("previous", F.lag(score).over(forward))
        .where(F.col("previous").isNotNull())
        .select(
            dimension, ts, *tie, F.col(score).alias("current"), "previous", change.alias("change"),
            F.when(change > 0, "improving").otherwise("declining").alias("trend"),
        )
    )
