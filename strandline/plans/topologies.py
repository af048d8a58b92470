"""The applications: mobility and segments, mail, and counting active records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.values import clean_mail
from strandline.operators import activity, coverage, geodiameter, hmm, home, ordering, places, segments
from strandline.plans.pipeline import Config, Pipeline


def _rectified(df: DataFrame, **how) -> DataFrame:
    return hmm.rectify(df, **how).withColumn("mode", F.col("rectified"))


def _placed(df: DataFrame, **how) -> DataFrame:
    return places.leader_places(places.place_segments(df, **how))


def mobility_pipeline(records: DataFrame, config: Config | None = None, *, interval_ms: int = 30_000) -> Pipeline:
    return (
        Pipeline(config or Config("mobility"))
        .source("records", records)
        .task("gated", ordering.monotonic_gate, source="records")
        .task("throttled", ordering.rate_limit, source="gated", min_interval_ms=interval_ms)
        .task("coverage", coverage.mobility_coverage, source="throttled", window="hour", target="coverage")
        .task("places", _placed, source="throttled")
        .task("home", home.home_time, source="places", target="leave_return_home_time")
        .task("geodiameter", geodiameter.geodiameter, source="throttled", window="day", target="geodiameter")
        .task("rectified", _rectified, source="throttled")
        .task("summaries", activity.daily_summary, source="rectified", window="day", target="summaries")
    )


def segment_pipeline(rows: DataFrame, config: Config | None = None) -> Pipeline:
    return (
        Pipeline(config or Config("segments"))
        .source("rows", rows)
        .task("filtered", segments.remove_overlap, source="rows")
        .task("coverage", coverage.segment_coverage, source="filtered", window="hour", target="coverage")
        .task("points", segments.track_points, source="filtered")
        .task("geodiameter", lambda df: geodiameter.geodiameter(ordering.monotonic_gate(df, order=("seq", "point"))), source="points", target="geodiameter")
        .task("summaries", activity.segment_summary, source="filtered", window="day", target="summaries")
        .task("home", home.segment_home_time, source="filtered", target="leave_return_home_time")
    )


def mail_pipeline(mail: DataFrame, config: Config | None = None) -> Pipeline:
    return Pipeline(config or Config("mail", cold_start=True)).source("mail", mail).task("cleaned", lambda df: df.withColumn("content", clean_mail("content")), source="mail")


def active_count_pipeline(records: DataFrame, config: Config | None = None) -> Pipeline:
    return Pipeline(config or Config("active-count")).source("records", records).task("gated", ordering.monotonic_gate, source="records").task("count", activity.active_count, source="gated", window="day", target="active_count")
