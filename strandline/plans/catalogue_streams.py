"""Registered queries that run a stream over the events to its end; their SQL is that of the batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.plans import catalogue, catalogue_more
from strandline.plans.catalogue import AHEAD_MS, GAP_S, SEGMENT_MS, _ntz
from strandline.sources.records import mobility_stream
from strandline.streaming import windows
from strandline.streaming.batches import stream_places, stream_rectify
from strandline.streaming.stateful import run_to_end, stream_gate


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = run_to_end(stream_gate(mobility_stream(spark, sf_dir), min_interval_ms=catalogue.LIMIT_MS))
    return _ntz(kept.select("user_key", "seq", "ts"))


def stream_active_count_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(run_to_end(windows.stream_windows(mobility_stream(spark, sf_dir), "day", windows.active_count_task())))


def stream_coverage_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = run_to_end(windows.stream_windows(mobility_stream(spark, sf_dir), "hour", windows.coverage_task()))
    return _ntz(c.select("user_key", "win_begin", F.round("coverage", 6).alias("coverage")))


def stream_activity_time_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = run_to_end(windows.stream_windows(mobility_stream(spark, sf_dir), "day", windows.mode_time_task()))
    return _ntz(t.select("user_key", "win_begin", F.timestamp_millis("first_ms").alias("first_ts"), "active_s", "sedentary_s", "transport_s", "total_s"))


def stream_geodiameter_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = run_to_end(windows.stream_windows(mobility_stream(spark, sf_dir), "day", windows.geodiameter_task()))
    return _ntz(g.select("user_key", "win_begin", F.timestamp_millis("first_ms").alias("first_ts"), F.round("miles", 6).alias("miles")))


def stream_aligned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = mobility_stream(spark, sf_dir).filter("k % 5 <> 0 or seq % 7 = 0").withColumn("stream", F.col("k") % 5 == 0)
    return _ntz(run_to_end(windows.stream_windows(two, "day", windows.count_task(), streams=2)))


def stream_hmm_rectify(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = run_to_end(stream_rectify(mobility_stream(spark, sf_dir), max_gap_s=GAP_S))
    return _ntz(r.select("user_key", "seq", "ts", "mode", "rectified"))


def stream_place_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = run_to_end(stream_places(mobility_stream(spark, sf_dir), ahead_ms=AHEAD_MS, max_gap_ms=SEGMENT_MS, long_split=False, by_day=False))
    return _ntz(p.select("user_key", "state", "start", "end", "points", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng")))


#: Each query, and the batch query that gives the same rows.
QUERIES = {
    stream_rate_limit: "rate_limit",
    stream_active_count_daily: "active_count_daily",
    stream_coverage_hourly: "mobility_coverage_hourly",
    stream_activity_time_daily: "activity_time_daily",
    stream_geodiameter_daily: "geodiameter_daily",
    stream_aligned_counts: "aligned_counts",
    stream_hmm_rectify: "hmm_rectify",
    stream_place_segments: "place_segments",
}


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    batch = catalogue.oracle_sql() | catalogue_more.oracle_sql()
    return {q.__name__: batch[name] for q, name in QUERIES.items()}
