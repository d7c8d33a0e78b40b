"""Change detection, freshness, refresh decisions and pipeline alerts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.measures import moment

# Age limits in hours.
FRESHNESS_HOURS = {"business_data": 168.0, "building_data": 720.0, "spatial_joins": 168.0}
REFRESH_HOURS = {"business_refresh": 24.0, "buildings_refresh": 168.0}
VERSION_ROW_DELTA = 1000


def _hours(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(3_600_000_000.0)


def _limit_table(like: DataFrame, name: str, limits: Mapping[str, float]) -> DataFrame:
    """The given limits as a frame: as many rows as the caller named."""
    entries = F.array(*[
        F.struct(F.lit(k).alias(name), F.lit(float(v)).alias("threshold_hours")) for k, v in limits.items()
    ])
    return like.sparkSession.range(1).select(F.inline(entries))


def detect_changes(
    versions: DataFrame, dataset: str = "dataset_id", version: str = "version", row_delta: int = VERSION_ROW_DELTA
) -> DataFrame:
    """Every version against the one before it: rows, update time, columns, and whether to keep a copy.

    ``versions`` has one row per dataset version, with ``total_rows``,
    ``last_updated`` and ``columns``.
    """
    window = Window.partitionBy(dataset).orderBy(version)
    before = versions.withColumn(
        "_old", F.lag(F.struct("total_rows", "last_updated", "columns")).over(window)
    ).where(F.col("_old").isNotNull())
    added = F.array_sort(F.array_except("columns", F.col("_old.columns")))
    removed = F.array_sort(F.array_except(F.col("_old.columns"), F.col("columns")))
    delta = F.col("total_rows") - F.col("_old.total_rows")
    return before.select(
        dataset, version, delta.alias("row_count_change"),
        (~F.col("last_updated").eqNullSafe(F.col("_old.last_updated"))).alias("last_updated_changed"),
        added.alias("added"), removed.alias("removed"),
    ).withColumn(
        "keep_version", (F.col("row_count_change") > row_delta) | (F.size("added") > 0) | (F.size("removed") > 0)
    )


def schema_diff(versions: DataFrame, dataset: str = "dataset_id", version: str = "version") -> DataFrame:
    """Columns each stored version added or removed against the one before it: (dataset, version, column_name, change)."""
    changes = detect_changes(versions, dataset, version)

    def named(kind: str) -> DataFrame:
        return changes.select(dataset, version, F.explode(kind).alias("column_name"), F.lit(kind).alias("change"))

    return named("added").unionByName(named("removed"))


def freshness_check(
    events: DataFrame, now: dt.datetime, limits: Mapping[str, float] = FRESHNESS_HOURS,
    dataset: str = "dataset", ts: str = "ts",
) -> DataFrame:
    """Age of every named dataset against its limit; one without rows is not fresh."""
    latest = events.groupBy(dataset).agg(F.max(ts).alias("last_updated"), F.count(F.lit(1)).alias("cached_rows"))
    age = _hours(moment(now), F.col("last_updated"))
    return (
        _limit_table(events, dataset, limits)
        .join(latest, dataset, "left")
        .withColumn("age_hours", age)
        .withColumn("is_fresh", F.coalesce(age <= F.col("threshold_hours"), F.lit(False)))
        .withColumn("exists", F.col("last_updated").isNotNull())
        .withColumn("cached_rows", F.coalesce("cached_rows", F.lit(0)))
    )


def needs_refresh(
    events: DataFrame, now: dt.datetime, limits: Mapping[str, float] = REFRESH_HOURS
) -> DataFrame:
    """Whether the last success of an event type is older than its limit, or missing."""
    success = events.where(F.col("status") == "success").groupBy("event_type").agg(F.max("ts").alias("last_success"))
    age = _hours(moment(now), F.col("last_success"))
    return (
        _limit_table(events, "event_type", limits)
        .join(success, "event_type", "left")
        .withColumn("age_hours", age)
        .withColumn("needs_refresh", F.coalesce(age > F.col("threshold_hours"), F.lit(True)))
    )


def refresh_summary(events: DataFrame) -> DataFrame:
    """Per event type: counts by status, failures since the last success, share of good steps."""
    totals = events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("total_events"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in ("success", "skipped", "error")],
        F.max(F.when(F.col("status") == "success", F.col("ts"))).alias("last_success"),
    )
    errors = events.where(F.col("status") == "error").join(
        totals.select("event_type", "last_success"), "event_type"
    )
    streak = errors.where(F.col("last_success").isNull() | (F.col("ts") > F.col("last_success"))).groupBy(
        "event_type"
    ).agg(F.count(F.lit(1)).alias("consecutive_failures"))
    good = F.col("success_count") + F.col("skipped_count")
    return (
        totals.join(streak, "event_type", "left")
        .withColumn("consecutive_failures", F.coalesce("consecutive_failures", F.lit(0)))
        .withColumn("success_ratio", good / F.col("total_events"))
        .withColumn(
            "overall_status", F.when(good == F.col("total_events"), "success").otherwise("partial_failure")
        )
    )


def run_status(events: DataFrame, run: str = "run_id") -> DataFrame:
    """Per pipeline run: good steps of all steps, failed steps, and whether the run as a whole succeeded."""
    good = F.count_if(F.col("status").isin("success", "skipped"))
    return events.groupBy(run).agg(
        F.count(F.lit(1)).alias("steps"), good.alias("good_steps"), F.count_if(F.col("status") == "error").alias("failed_steps"),
        F.min("ts").alias("started"), F.max("ts").alias("ended"),
    ).withColumn("overall_status", F.when(F.col("good_steps") == F.col("steps"), "success").when(F.col("good_steps") == 0, "failure").otherwise("partial_failure"))


def monitor_alerts(freshness: DataFrame, trend: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Stale or missing data, and scores that are low or falling."""
    stale = freshness.where(F.col("exists") & ~F.col("is_fresh")).select(
        F.lit("data_freshness").alias("alert_type"), F.lit("warning").alias("severity"),
        F.col(dataset).alias("subject"), F.col("age_hours").alias("value"),
    )
    missing = freshness.where(~F.col("exists")).select(
        F.lit("missing_table").alias("alert_type"), F.lit("high").alias("severity"),
        F.col(dataset).alias("subject"), F.lit(None).cast("double").alias("value"),
    )
    score = F.col("latest_score")
    falling = F.col("latest_score") <= F.col("previous_score")
    poor = trend.where((score < 0.70) | ((score < 0.85) & falling)).select(
        F.lit("quality_degradation").alias("alert_type"),
        F.when(score < 0.70, "high").otherwise("medium").alias("severity"),
        F.col(dataset).alias("subject"), score.alias("value"),
    )
    return stale.unionByName(missing).unionByName(poor)


def content_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, algorithm: str = "xxhash64") -> DataFrame:
    """One row that changes with the content but not with the order of rows.

    Row digests are added up, so repeated rows do not cancel out. ``md5``
    gives digests any other engine can recompute; ``xxhash64`` is faster.
    """
    columns = list(columns or df.columns)
    if algorithm == "xxhash64":
        # null flags tell (x, null) from (null, x); 48 bits leave room for 10 ** 15 rows in the sum
        nulls = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
        digest = F.shiftrightunsigned(F.xxhash64(nulls, *columns), 16).cast("decimal(20,0)")
    elif algorithm == "md5":
        # a text that holds the separator, the mark of a null or the escape itself is escaped
        def spelled(c: str) -> Column:
            value = F.col(c).cast("string")
            for mark, name in (("\u001b", "E"), ("\u001f", "S"), ("\u0000", "N")):
                value = F.replace(value, F.lit(mark), F.lit(f"\u001b{name}"))
            return F.coalesce(value, F.lit("\u0000"))

        text = F.concat_ws("\u001f", *map(spelled, columns))
        digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(20,0)")
    else:
        raise ValueError(f"unknown algorithm {algorithm!r}")
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("fingerprint"),
    )
