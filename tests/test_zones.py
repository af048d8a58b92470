"""Zones over a change of offset, streams of several inputs, and rows without a user."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from strandline.operators import activity, coverage, home, hmm, ordering, places, segments, windows
from strandline.sources import records

NY, BERLIN = "America/New_York", "Europe/Berlin"


def at(text):
    return datetime.fromisoformat(text)


@pytest.mark.parametrize("zone, midnight", [(NY, "2024-03-11 04:00:00"), (BERLIN, "2024-03-10 23:00:00"), ("+00:00", "2024-03-11 00:00:00")])
def test_split_by_day_over_a_change(spark, zone, midnight):
    df = spark.createDataFrame([("u", 1, zone, at("2024-03-10 06:00:00"), at("2024-03-11 06:00:00"))], "user_key string, seq long, tz string, start timestamp, end timestamp")
    got = [(r.start, r.end) for r in segments.split_by_day(df).orderBy("start").collect()]
    assert got[0][0] == at("2024-03-10 06:00:00") and got[-1][1] == at("2024-03-11 06:00:00")
    assert at(midnight) in [a for a, _ in got] and at(midnight) - timedelta(milliseconds=1) in [b for _, b in got]


def test_home_over_a_change(spark):
    """A day of 23 hours: from its local midnight to the next one."""
    rows = [("2024-03-10 05:00:00", "2024-03-10 13:00:00", 1), ("2024-03-10 13:00:00", "2024-03-10 20:00:00", 2), ("2024-03-10 20:00:00", "2024-03-11 03:59:00", 1)]
    df = spark.createDataFrame([("u", NY, i, at(a), at(b), "Place", p, 1.0, 2.0) for i, (a, b, p) in enumerate(rows)], "user_key string, tz string, segment long, start timestamp, end timestamp, state string, place_id long, lat double, lng double")
    got = home.home_time(df, include_open=True).collect()
    # 00:00 to 09:00 on the wall is eight hours; 16:00 to midnight is eight.
    assert [(r["leave"], r["return"], r.home_s) for r in got] == [(at("2024-03-10 13:00:00"), at("2024-03-10 20:00:00"), 16 * 3600 - 1)]


def test_zone_of_the_first_record(spark):
    rows = [(0, "2024-06-01 03:00:00", NY), (1, "2024-06-01 20:00:00", "+00:00"), (2, "2024-06-02 03:30:00", NY), (3, "2024-06-02 12:00:00", NY)]
    df = spark.createDataFrame([("u", i, at(t), z) for i, t, z in rows], "user_key string, seq long, ts timestamp, tz string")
    own = windows.window_task(df, "day", F.count("*").alias("n"), include_open=True)
    first = windows.window_task(df, "day", F.count("*").alias("n"), include_open=True, first_zone=True)
    assert sorted((r.win_begin.day, r.n) for r in own.collect()) == [(1, 2), (2, 1), (31, 1)]
    # The day that the record of +00:00 opens is one of +00:00.
    assert sorted((r.win_begin.day, r.n) for r in first.collect()) == [(1, 1), (2, 2), (31, 1)]


def test_coverage_of_months_and_years(spark):
    df = spark.createDataFrame([("u", "+00:00", at("2023-12-31 00:00:00"), at("2024-02-01 00:00:00"))], "user_key string, tz string, start timestamp, end timestamp")
    month = {r.win_begin.month: r.coverage for r in coverage.segment_coverage(df, "month", include_open=True).collect()}
    assert abs(month[12] - 1 / 31) < 1e-6 and month[1] == 1.0 and 2 not in month
    year = {r.win_begin.year: r.coverage for r in coverage.segment_coverage(df, "year", include_open=True).collect()}
    assert abs(year[2023] - 1 / 365) < 1e-6 and abs(year[2024] - 31 / 366) < 1e-6
    moves = spark.createDataFrame([("u", i, at("2024-01-01 00:00:00") + timedelta(minutes=5 * i), "+00:00") for i in range(13)], "user_key string, seq long, ts timestamp, tz string")
    assert abs(coverage.mobility_coverage(moves, "month", include_open=True).first().coverage - 1 / (31 * 24)) < 1e-6


def test_thinning_without_a_user(spark):
    df = spark.createDataFrame([(None, i, at("2024-01-01 00:00:00") + timedelta(seconds=i)) for i in range(5)], "user_key string, seq long, ts timestamp")
    assert ordering.rate_limit(df).count() == 1


def test_whole_seconds_between_episodes(spark):
    times = [0, 330.5, 662.0]
    df = spark.createDataFrame([("u", i, at("2024-01-01 00:00:00") + timedelta(seconds=t), "+00:00", "WALK") for i, t in enumerate(times)], "user_key string, seq long, ts timestamp, tz string, mode string")
    assert sorted(r.records for r in activity.episodes(df, include_open=True).collect()) == [1, 2]


def test_windows_wait_for_every_stream(spark):
    day = lambda d: at(f"2024-01-0{d} 10:00:00")
    rows = [("u", "a", d) for d in (1, 2, 3, 4)] + [("u", "b", d) for d in (1, 3)] + [("v", "a", d) for d in (1, 2)]
    df = spark.createDataFrame([(u, s, day(d), "+00:00", i) for i, (u, s, d) in enumerate(rows)], "user_key string, stream string, ts timestamp, tz string, seq long")
    got = windows.aligned_windows(df, "day", F.count("*").alias("n"), streams=2).collect()
    assert sorted((r.user_key, r.win_begin.day, r.n) for r in got) == [("u", 1, 2), ("u", 2, 1)]


def test_tokens_fan_out(spark):
    rows = [("u", 1, "p", "mail cal", "t1", False), ("u", 2, "p", "cal", "t2", False), ("u", 3, "p", "mail", None, True), ("u", 4, "q", " mail  mail ", "t4", None), ("u", 5, "p", None, "t5", False)]
    df = spark.createDataFrame([(u, s, at(f"2024-01-0{s} 00:00:00"), p, sc, t, bad) for u, s, p, sc, t, bad in rows], "user_key string, seq long, ts timestamp, provider string, scope string, token string, invalid boolean")
    assert sorted((r.provider, r.scope, r.token) for r in records.token_store(df).collect()) == [("p", "cal", "t2"), ("q", "mail", "t4")]


def test_location_time_and_trips(spark):
    t0 = at("2024-01-01 00:00:00")
    rows = [(i, t0 + timedelta(minutes=10 * i), t0 + timedelta(minutes=m), 40.0 + m / 100, -74.0, 10.0, "DRIVE", "+00:00") for i, m in enumerate([0, 10, 5, 20, 30, 40, 50, 60])]
    df = spark.createDataFrame([("u", *r) for r in rows], "user_key string, seq long, ts timestamp, loc_ts timestamp, lat double, lng double, accuracy double, mode string, tz string")
    assert [r.seq for r in places.by_location_time(df).orderBy("ts").collect()] == [0, 1, 3, 4, 5, 6, 7]
    trip = places.place_segments(df, include_open=True, long_split=False).filter("state = 'Moves'").first()
    assert (trip.start, trip.from_lat, trip.to_lat, trip.lat) == (t0, 40.0, 40.4, None)


def test_summary_keeps_zone_and_accuracy(spark):
    t0 = at("2024-01-01 20:00:00")
    rows = [("u", i, t0 + timedelta(minutes=2 * i), NY, "WALK", 40.0 + i * 1e-4, -74.0, 5.0) for i in range(400)]
    df = spark.createDataFrame(rows, "user_key string, seq long, ts timestamp, tz string, mode string, lat double, lng double, accuracy double")
    fixed = hmm.rectify(df, include_open=True)
    assert {(r.tz, r.accuracy) for r in fixed.collect()} == {(NY, 5.0)}
    days = activity.daily_summary(fixed.withColumn("mode", F.col("rectified"))).orderBy("win_begin").collect()
    assert [(r.win_begin, r.episodes) for r in days] == [(at("2024-01-01 00:00:00"), 1)] and days[0].miles > 0.1 and days[0].active_s > 0


@pytest.mark.parametrize("include_open", [True, False])
def test_windows_of_several_units_in_one_pass(spark, include_open):
    df = records.mobility(spark, "/root/testdata/sf0.001").withColumn("tz", F.when(F.col("k") % 2 == 0, "America/New_York").otherwise("Europe/Berlin"))
    units = ("minute", "hour", "day", "week", "month", "year")
    aggs = [F.count("*").alias("n"), F.min("ts").alias("first_ts")]
    got = windows.windows_task(ordering.monotonic_gate(df), units, *aggs, include_open=include_open)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # One reading, and one sort for the gate, whatever the number of units.
    assert plan.count("Scan parquet") == 1 and plan.count("Union") == 0
    want = [(r.user_key, u, r.win_begin, r.win_end, r.n, r.first_ts) for u in units for r in windows.window_task(ordering.monotonic_gate(df), u, *aggs, include_open=include_open).collect()]
    assert sorted(map(tuple, got.collect())) == sorted(want)
