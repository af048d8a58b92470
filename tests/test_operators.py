"""Each threshold from both sides."""

import itertools
import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import geo, values
from strandline.functions.times import local, parse_iso, print_iso, window_begin
from strandline.operators import activity, coverage, geodiameter, hmm, home, ordering, places, segments, windows
from strandline.plans.pipeline import Config, Pipeline
from strandline.plans.topologies import active_count_pipeline, mail_pipeline, mobility_pipeline, segment_pipeline
from strandline.sources import records, sinks

T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(milliseconds=round(seconds * 1000))


def stream(spark, rows, tz="+00:00"):
    """rows: (seconds, mode, lat, lng, accuracy), all but the first optional."""
    full = [(1, i, at(r[0]), tz, *(list(r[1:]) + ["STILL", None, None, None][len(r) - 1 :])) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, "user_key long, seq long, ts timestamp, tz string, mode string, lat double, lng double, accuracy double")


def seconds(df, column="ts"):
    return [(r[column] - T0).total_seconds() for r in df.orderBy("seq").collect()]


def test_gate(spark):
    assert seconds(ordering.monotonic_gate(stream(spark, [(t,) for t in (1, 3, 2, 3, 4)]))) == [1, 3, 4]


@pytest.mark.parametrize("given, kept", [((0, 10, 29.999, 30, 45, 60), [0, 30, 60]), ((0, 20, 40, 60), [0, 40])])
def test_rate_limit(spark, given, kept):
    assert seconds(ordering.rate_limit(stream(spark, [(t,) for t in given]))) == kept


def test_closed_windows(spark):
    two = stream(spark, [(10, "WALK"), (20, "STILL"), (86_400, "WALK")])
    assert [(r.win_begin, r.win_end, r.active_count) for r in activity.active_count(two).collect()] == [(T0, at(86_399.999), 1)]
    assert activity.active_count(two, include_open=True).count() == 2
    with pytest.raises(ValueError):
        windows.window_task(two, "day", F.count("*"), n=2)


def test_window_zone(spark):
    rows = [(1, 0, datetime(2024, 1, 2, 4, 30), "-05:00", "WALK"), (1, 1, datetime(2024, 1, 2, 5, 30), "-05:00", "WALK")]
    df = spark.createDataFrame(rows, "user_key long, seq long, ts timestamp, tz string, mode string")
    assert activity.active_count(df, include_open=True).count() == 2
    assert activity.active_count(df.withColumn("tz", F.lit("+00:00")), include_open=True).count() == 1
    assert windows.with_window(df).count() == 2
    got = windows.window_apply(df, "day", lambda pdf: pd.DataFrame({"user_key": [1], "win_begin": pdf["win_begin"].iloc[:1], "n": [len(pdf)]}), "user_key long, win_begin timestamp, n long", include_open=True)
    assert got.count() == 2


def test_compat_epoch(spark):
    row = spark.sql("select timestamp'2024-03-31 12:00:00' as ts, '-05:00' as tz")
    got = row.select(window_begin(local("ts", "tz"), "month", compat_epoch=True, tz=F.col("tz")).alias("m"), window_begin(local("ts", "tz"), "month").alias("c"), window_begin(local("ts", "tz"), "week").alias("w")).first()
    assert (got.m.day, got.c.day, got.w.weekday()) == (31, 1, 3)


def test_coverage(spark):
    c = coverage.mobility_coverage(stream(spark, [(0,), (419.999,), (839.999,), (3590,), (3610,), (7300,)]))
    assert [round(r.coverage * 3599.999, 3) for r in c.orderBy("win_begin").collect()] == [419.999, 20.0]
    with pytest.raises(Exception, match="coverage over"):
        spark.range(1).select(coverage.clamp(F.lit(1.2), strict=True)).collect()
    assert spark.range(1).select(coverage.clamp(F.lit(1.05)).alias("c")).first().c == 1.0


def test_mode_time(spark):
    r = activity.mode_time(stream(spark, [(0, "WALK"), (329.9, "STILL"), (659.9, "DRIVE"), (662.9, "DRIVE")]), include_open=True).first()
    assert (r.active_s, r.sedentary_s, r.transport_s, r.total_s) == (164.5, 167.5, 3.0, 332.0)


def test_episodes(spark):
    def count(rows):
        return activity.episodes(stream(spark, rows), include_open=True).count()

    assert count([(0, "WALK"), (120, "STILL"), (130, "RUN")]) == 1
    assert count([(0, "WALK"), (120.001, "STILL"), (130, "RUN")]) == 2
    assert count([(0, "WALK"), (330, "WALK")]) == 1
    assert count([(0, "WALK"), (331, "WALK")]) == 2


def test_episode_distance(spark):
    slow = [(i * 60, "WALK", 40 + i * 0.0005, -74.0, 5.0) for i in range(4)]
    fast = [(i * 60, "WALK", 40 + i * 0.05, -74.0, 5.0) for i in range(4)]
    far = lambda rows: activity.episode_distance(stream(spark, rows), include_open=True).first()
    assert 0.05 < far(slow).miles < 0.11 and far(slow).duration_s == 180
    assert far(fast).miles == 0 and far(slow[:1]).miles == 0


def test_summary(spark):
    e = spark.createDataFrame([(1, T0, 300, 9.0, -1), (1, T0, 301, 1.0, 5), (2, T0, 10, 1.0, -1)], "user_key int, win_begin timestamp, duration_s long, miles double, steps long")
    got = {r.user_key: r for r in activity.summarise(e).collect()}
    assert got[1].steps == 5 and got[2].steps == -1 and got[2].max_mph == -1 and math.isclose(got[1].max_mph, 3600 / 301)


def test_kalman_first_and_gain():
    lat, _ = geo.kalman(np.array([0.0, 1.0]), np.zeros(2), np.array([4.0, 4.0]), np.array([0, 1000]))
    assert lat[0] == 0 and math.isclose(lat[1], 32 / 48, rel_tol=1e-6)


def test_hull_against_all_pairs():
    rng = np.random.default_rng(1)
    for n in (2, 3, 5, 40):
        lat, lng = 40 + rng.random(n) * 0.1, -74 + rng.random(n) * 0.1
        want = max(geo.np_distance(lat[i], lng[i], lat[j], lng[j], "mile") for i in range(n) for j in range(i))
        assert math.isclose(geo.widest_pair(lat, lng)[0], want, rel_tol=1e-12)


def test_geodiameter(spark):
    rows = [(0, "STILL", 40.0, -74.0, 100.0), (1, "STILL", 40.1, -74.0, 100.1), (2, "STILL", 40.01, -74.0, -1.0)]
    r = geodiameter.geodiameter(stream(spark, rows), include_open=True).first()
    assert math.isclose(r.miles, geo.np_distance(40.0, -74.0, 40.01, -74.0, "mile")) and (r.earlier_seq, r.later_seq) == (0, 2)
    assert geodiameter.geodiameter(stream(spark, rows[:2]), include_open=True).count() == 0
    many = [(i, "STILL", 40 + i / 1000, -74.0, 1.0) for i in range(11)]
    full, thin = (geodiameter.geodiameter(stream(spark, many), include_open=True, drop_every=n).first() for n in (None, 11))
    assert (full.later_seq, thin.later_seq) == (10, 9)


def test_place_state(spark):
    def state(mode, metres):
        d = math.degrees(metres / 6371009)
        rows = [(0, mode, 40.0, -74.0, 5.0), (300, mode, 40.0 + d, -74.0, 5.0), (1000, mode, 40.0, -74.0, 5.0)]
        return places.place_state(stream(spark, rows)).orderBy("seq").first().state

    assert [state("WALK", m) for m in (99.9, 100.1)] == ["Place", "Moves"]
    assert [state("STILL", m) for m in (49.9, 1999, 2001)] == ["Place", "Place", "Moves"]
    # A record with none within ten minutes after it stays in the state before it.
    far = [(0, "STILL", 40.0, -74.0, 5.0), (300, "STILL", 41.0, -74.0, 5.0), (2000, "STILL", 41.0, -74.0, 5.0), (9000, "STILL", 41.0, -74.0, 5.0)]
    assert [r.state for r in places.place_state(stream(spark, far)).orderBy("seq").collect()] == ["Moves", "Moves", "Moves"]


def test_place_segments(spark):
    def run(rows, **how):
        return places.with_segments(stream(spark, rows).withColumn("state", F.col("mode")), **how)

    assert run([(0, "Place"), (1200, "Place"), (2401, "Moves")]).agg(F.count_distinct("segment")).first()[0] == 1
    assert run([(0, "Place"), (1200.001, "Place"), (2401, "Moves")]).agg(F.count_distinct("segment")).first()[0] == 2
    assert places.segment_rows(run([(0, "Place"), (10, "Moves"), (20, "Moves"), (30, "Place")])).count() == 1

    def parts(n):
        """Records ten minutes apart, then one of another state."""
        long = [(i * 600, "Place", 40.0, -74.0, 1.0) for i in range(n)] + [(n * 600, "Moves", 40.0, -74.0, 1.0)]
        return [r.points for r in places.segment_rows(places.split_long(run(long))).orderBy("part").collect()]

    # A segment is cut when a further record of its own arrives, never at its end.
    assert [parts(n) for n in (25, 26, 40, 41)] == [[25], [15, 11], [15, 25], [15, 15, 11]]


def test_split_and_clip(spark):
    rows = [(1, 0, "+00:00", at(0), at(0)), (1, 1, "+00:00", at(86_000), at(86_500)), (1, 2, "+00:00", at(10), at(86_400))]
    df = spark.createDataFrame(rows, "user_key long, seq long, tz string, start timestamp, end timestamp")
    got = [(r.seq, (r.start - T0).total_seconds(), (r.end - T0).total_seconds()) for r in segments.split_by_day(df).orderBy("seq", "start").collect()]
    assert got == [(1, 86_000, 86_399.999), (1, 86_400, 86_500), (2, 10, 86_399.999)]
    clipped = segments.clip_to_day(df.withColumn("day", F.date_add(F.to_date(F.lit("2024-01-01")), F.col("seq").cast("int") % 2)))
    assert [(r.seq, (r.start - T0).total_seconds()) for r in clipped.orderBy("seq").collect()] == [(0, 0), (1, 86_400), (2, 10)]


def seg(spark, rows):
    full = [(1, i, "+00:00", at(b), at(a), at(b)) for i, (a, b) in enumerate(rows)]
    return spark.createDataFrame(full, "user_key long, seq long, tz string, ts timestamp, start timestamp, end timestamp")


def test_remove_overlap(spark):
    def run(*rows):
        return [((r.start - T0).total_seconds(), (r.end - T0).total_seconds()) for r in segments.remove_overlap(seg(spark, rows)).orderBy("end").collect()]

    assert run((0, 10), (20, 30)) == [(0, 10)]
    assert run((0, 10), (10, 30)) == [(0, 10)]
    assert run((0, 10), (5, 30)) == [(0, 5)]
    assert run((5, 10), (5, 30)) == [] == run((5, 10), (2, 30))
    assert run((0, 10), (3, 10), (20, 30)) == [(0, 10)]


def test_segment_coverage(spark):
    got = coverage.segment_coverage(seg(spark, [(1800, 9000)]), include_open=True).orderBy("win_begin").collect()
    assert [round(r.coverage, 4) for r in got] == [0.5, 1.0, 0.5]
    assert coverage.segment_coverage(seg(spark, [(1800, 9000)])).count() == 2


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    for n in range(1, 6):
        for _ in range(15):
            seen = rng.integers(0, 4, n)

            def worth(p):
                x = hmm.START[p[0]] * hmm.EMIT[p[0]][seen[0]]
                for i in range(1, n):
                    x *= hmm.MOVE[p[i - 1]][p[i]] * hmm.EMIT[p[i]][seen[i]]
                return x

            best = max(map(worth, itertools.product(range(4), repeat=n)))
            assert math.isclose(worth(hmm.viterbi(seen)), best, rel_tol=1e-9)


def test_hmm_batches(spark):
    def rows(n):
        return stream(spark, [(i * 10, "DRIVE" if i == 9 else "STILL", 40.0, -74.0, 5.0) for i in range(n)] + [(n * 10 + 500, "STILL", 40.0, -74.0, 5.0), (n * 10 + 510, "UNKNOWN")])

    kept, decoded = (hmm.rectify(rows(n)).filter("seq = 9").first().rectified for n in (19, 20))
    assert (kept, decoded) == ("DRIVE", "STILL")
    # Forty batches, more than a group holds, of 20 (a DRIVE is taken back) and 19 records (it stays) in turn.
    many = [(k * 10_000 + i * 10, "DRIVE" if i == 9 else "STILL", 40.0, -74.0, 5.0) for k in range(40) for i in range(20 - k % 2)]
    got = hmm.rectify(stream(spark, many), include_open=True).orderBy("ts").collect()
    assert [r.rectified for r in got] == [m if k % 2 else "STILL" for k in range(40) for m in ["STILL"] * 9 + ["DRIVE"] + ["STILL"] * (10 - k % 2)]
    b = hmm.with_batches(stream(spark, [(i, "STILL") for i in range(125)] + [(304, "WALK"), (484.001, "WALK")])).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in b] == [60, 60, 6, 1]


def day_of(spark, spans, place=(1, 1)):
    """spans: (state, place_id, begin hour, end hour)."""
    rows = [(1, i, 0, s, at(a * 3600), at(b * 3600), p, 40.0, -74.0, "+00:00") for i, (s, p, a, b) in enumerate(spans)]
    rows.append((1, 99, 0, "Place", at(30 * 3600), at(31 * 3600), 1, 40.0, -74.0, "+00:00"))
    return spark.createDataFrame(rows, "user_key long, segment int, part int, state string, start timestamp, end timestamp, place_id long, lat double, lng double, tz string")


def test_home_time(spark):
    ok = [("Moves", None, 0, 1), ("Place", 1, 1, 8), ("Moves", None, 8, 9), ("Place", 2, 9, 17), ("Place", 1, 18, 23)]
    r = home.home_time(day_of(spark, ok)).first()
    assert (r.leave, r["return"], r.home_s) == (at(8 * 3600), at(18 * 3600), 8 * 3600 + 6 * 3600 - 1)
    assert home.home_time(day_of(spark, [("Place", 1, 2, 22)])).first().home_s == 86_400
    assert home.home_time(day_of(spark, [("Place", 1, 12, 23), ("Place", 1, 23, 23.5)])).count() == 0
    assert home.home_time(day_of(spark, [("Place", 1, 2, 19.9)])).count() == 0
    assert home.home_time(day_of(spark, [("Place", 1, 8, 20)])).count() == 0
    assert home.home_time(day_of(spark, [("Place", 1, 8, 20 + 1 / 3600)])).count() == 1
    assert home.home_time(day_of(spark, [("Place", 1, 1, 12), ("Place", 2, 12, 23)])).count() == 0


def test_segment_home_time(spark):
    def run(*spans):
        rows = [(1, i, at(b * 3600), "+00:00", at(a * 3600), at(b * 3600), None if p is None else (p, t, 40.0, -74.0)) for i, (p, t, a, b) in enumerate(spans)]
        rows.append((1, 99, at(30 * 3600), "+00:00", at(29 * 3600), at(30 * 3600), None))
        return home.segment_home_time(spark.createDataFrame(rows, "user_key long, seq long, ts timestamp, tz string, start timestamp, end timestamp, place struct<id: long, type: string, lat: double, lng: double>")).collect()

    assert run((1, "Home", 0, 86_399 / 7200)) == []
    r = run((1, "Home", 0, 8), (None, None, 8, 9), (2, "Work", 9, 17), (1, "Home", 18, 23))[0]
    assert (r.leave, r["return"], r.home_s) == (at(8 * 3600), at(18 * 3600), 8 * 3600 + 21_599)
    assert run((5, "Other", 0, 8), (6, "Other", 9, 17), (5, "Other", 18, 23))[0].home_s == 8 * 3600 + 21_599
    assert run((5, "Other", 0, 14), (6, "Other", 15, 17)) == []
    assert run((1, "Home", 0, 20))[0].home_s == 86_400


def test_mail(spark):
    quoted = ["hello\nOn Mon, X <x@y> wrote:\n> q", "hello\n----- Original Message -----\nFrom: a\nSent: today\nq", "hello\nFrom: a\nSubject: b\nq", "hello\n------\n> Time: 8:50\n> To: b\nq"]
    # A marker or a header alone quotes nothing.
    whole = ["from a to b", "On time he wrote a letter", "hello\n----- Original Message -----\nq", "hello\n-----\nFrom: a\nq"]
    df = spark.createDataFrame(list(enumerate(quoted + whole)), "i int, content string")
    assert [r.c.strip() for r in df.select("i", values.clean_mail("content").alias("c")).orderBy("i").collect()] == ["hello"] * len(quoted) + whole
    assert mail_pipeline(df).build()["cleaned"].count() == len(quoted + whole)


def test_mail_after_a_line_that_begins_with_on(spark):
    intro = "\nOn Mon Jun 7, 2010 at 8:50 PM, X wrote:\n> q"
    texts = ["a\nOn the whole." + intro, "a\nOn 75.164.212.188 we met." + intro, "\U0001f600 a" + intro, intro[1:], "a\nOn Mon Jun 7, X\non behalf of Y wrote:\n> q", "a\nOn Mon Jun 7,\nX wrote:\n> q", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, content string")
    got = [r.c for r in df.select("i", values.clean_mail("content").alias("c")).orderBy("i").collect()]
    assert got == ["a\nOn the whole.\n", "a\nOn 75.164.212.188 we met.\n", "\U0001f600 a\n", "", "a\n", "a\n", None, ""]


def test_sent_mail_folder_and_address(spark):
    part = [("x", False), ("file", True)]
    df = spark.createDataFrame([(1, records.SENT_FOLDER, part), (2, "INBOX", part), (3, None, part)], "i int, folder string, parts array<struct<text: string, attachment: boolean>>")
    assert [(r.i, r.content, r.attachment) for r in records.sent_mail(df).collect()] == [(1, "x", True)]
    assert records.sent_mail(df, folder=None).count() == 3
    texts = ['{"a": {"email": "x@y"}, "email": "z@y"}', '{"emails": "no", "b": [{"email" : "q@r"}]}', '{"email": 7, "c": {"email": "z@y"}}', "{}", None]
    meta = spark.createDataFrame(list(enumerate(texts)), "i int, meta string")
    assert [r[0] for r in meta.orderBy("i").select(values.email_of("meta")).collect()] == ["x@y", "q@r", None, None, None]


def test_modes_and_groups(spark):
    df = spark.createDataFrame([("bike",), ("Running",), ("still",), ("x",), (None,)], "m string")
    assert [r[0] for r in df.select(values.normal_mode("m")).collect()] == ["CYCLING", "RUN", "STILL", "UNKNOWN", None]
    assert spark.range(1).select(values.group_state(F.lit(None).cast("string"))).first()[0] == "WALK"
    with pytest.raises(Exception, match="unknown activity group"):
        spark.range(1).select(values.group_state(F.lit("flying"))).collect()


def test_tokens(spark):
    df = spark.createDataFrame([(1, {"google:a_b": 1, "moves:x": 2}), (2, {"google:a_b": 1})], "user int, t map<string, int>")
    both = F.array(values.token_key(F.lit("google"), F.lit("a.b")), F.lit("moves:x"))
    assert [r.user for r in df.filter(values.has_all("t", both)).collect()] == [1]
    assert df.select(values.put("t", F.lit("google:a_b"), F.lit(9)).alias("t")).first().t["google:a_b"] == 9
    assert spark.range(1).select(values.scopes(F.lit("a  b"))).first()[0] == ["a", "b"]


def test_records(spark):
    text = '{"metadata":{"timestamp":"2014-06-28T16:16:32.688-04:00","location":{"latitude":40.7127,"longitude":74.0059,"provider":"","timestamp":"2014-06-28T16:16:32.688-04:00","accuracy":-1.0}},"data":null}'
    df = records.decode(spark.createDataFrame([("u", 0, text), ("u", 1, "{bad")], "user_key string, seq long, json string"), "struct<mode: string>")
    r = df.orderBy("seq").first()
    assert r.tz == "-04:00" and r.ts == datetime(2014, 6, 28, 20, 16, 32, 688000) and r.location.lat == 40.7127
    again = df.filter("seq = 0").select(records.encode(df).alias("j")).first().j
    assert '"2014-06-28T16:16:32.688-04:00"' in again
    ts, tz = parse_iso(F.lit(""))
    assert spark.range(1).select(ts, tz).first() == (None, None)
    ts, tz = parse_iso(F.lit("2024-01-01T00:00:00Z"))
    assert spark.range(1).select(print_iso(ts, tz)).first()[0] == "2024-01-01T00:00:00.000+00:00"


def test_store(spark, tmp_path):
    df = stream(spark, [(0, "WALK"), (0, "RUN"), (5, "STILL")])
    sinks.write_stream(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert [r.mode for r in records.range_query(back, user=1, start=T0, end=at(5)).collect()] == ["RUN", "STILL"]
    assert [r.mode for r in records.range_query(back, descending=True, max_rows=1).collect()] == ["STILL"]
    sinks.write_stream(df, str(tmp_path / "dry"), dry_run=True)
    assert not (tmp_path / "dry").exists()
    assert len(records.pages(T0.date(), (T0 + timedelta(days=15)).date())) == 3
    assert records.shard(df, 3).rdd.getNumPartitions() == 3
    assert activity.record_count(records.odd(records.ticks(spark, 1, 7300)), "hour").count() >= 1


def test_credentials(spark):
    schema = "user_key string, seq long, ts timestamp, username string, provider string, scope string"
    own = spark.createDataFrame([("a", 1, at(5), "", "g", "s"), ("b", 2, at(9), None, "g", "s"), ("b", 3, at(99), "b", "g", "s")], schema)
    given = spark.createDataFrame([("r", 4, at(5), "a", "g", "s"), ("r", 5, at(8), "b", "g", "s")], schema)
    got = {r.user_key: r.seq for r in records.latest_credential(own, given).collect()}
    assert got == {"a": 4, "b": 2}
    assert [r.seq for r in records.latest_oauth(own, "g", "s").collect()] == [3]


def test_storylines(spark):
    rows = [("u", "+00:00", T0.date(), [(at(-100), at(50)), (at(90_000), at(91_000)), (at(86_000), at(86_500))])]
    df = spark.createDataFrame(rows, "user_key string, tz string, day date, segments array<struct<start: timestamp, end: timestamp>>")
    assert [((r.start - T0).total_seconds(), (r.end - T0).total_seconds()) for r in records.storylines(df).orderBy("seq").collect()] == [(0, 50), (86_000, 86_399.999)]
    assert records.storylines(df, at(60)).count() == 1


def test_track_points(spark):
    rows = [(1, 0, "+00:00", at(0), at(10), (1, "Home", 1.0, 2.0), [("walking", [(3.0, 4.0, None), (5.0, 6.0, at(2))], at(9))]), (1, 1, "+00:00", at(10), at(20), None, None)]
    df = spark.createDataFrame(rows, "user_key long, seq long, tz string, start timestamp, end timestamp, place struct<id: long, type: string, lat: double, lng: double>, activities array<struct<group: string, track_points: array<struct<lat: double, lng: double, ts: timestamp>>, end: timestamp>>")
    assert [(r.lat, (r.ts - T0).total_seconds()) for r in segments.track_points(df).orderBy("point").collect()] == [(3.0, 9), (5.0, 2), (1.0, 10)]


def test_nearest_place(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.00026), (3, 60.0, 10.00052), (4, 60.0, 10.0006), (5, None, None)], "seq long, lat double, lng double")
    g = spark.createDataFrame([(9, 0.0, 0.0), (8, 60.0, 10.0)], "place_id long, lat double, lng double")
    assert {r.seq: r.place_id for r in places.nearest_place(points, g).collect()} == {1: 9, 2: 9, 3: 8, 4: None, 5: None}


def test_location_gate(spark):
    df = stream(spark, [(i, "STILL", 1.0, 1.0) for i in range(4)] + [(4,)]).withColumn("loc_ts", F.element_at(F.array(*[F.lit(at(x)) for x in (5, 4, 5, 6, 7)]), (F.col("seq") + 1).cast("int")))
    assert [r.seq for r in ordering.location_gate(df).orderBy("seq").collect()] == [0, 2, 3]


def test_pipeline(spark, tmp_path):
    df = stream(spark, [(i * 60, "WALK", 40.0, -74.0, 5.0) for i in range(200)] + [(90_000, "STILL", 40.0, -74.0, 5.0)])
    out = active_count_pipeline(df, Config("t", target_root=str(tmp_path))).run()
    assert out["count"].first().generator.sources == ["records"]
    assert spark.read.parquet(str(tmp_path / "active_count")).first().active_count == 200
    frames = mobility_pipeline(df).build()
    assert {n: f.count() for n, f in frames.items() if n in ("throttled", "coverage", "summaries", "geodiameter", "home")}["throttled"] == 201
    p = Pipeline().source("a", df)
    with pytest.raises(TypeError):
        p.task("b", ordering.drop_unknown, source="a", window="day")
    with pytest.raises(ValueError):
        p.task("b", ordering.drop_unknown, source="zzz")
    assert Pipeline(Config(requestees=("2",))).source("a", df).task("b", ordering.drop_unknown, source="a").build()["b"].count() == 0


def test_segment_pipeline(spark):
    d = "/root/testdata/sf0.001"
    frames = segment_pipeline(records.moves(spark, d)).build()
    assert all(f.count() >= 0 for f in frames.values()) and frames["filtered"].count() > 0
