"""The registered queries over the driver's tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import values
from strandline.functions.times import ms, parse_iso, print_iso
from strandline.operators import activity, coverage, geodiameter, hmm, home, ordering, places, segments, windows
from strandline.sources import records, sinks

#: Rules of minutes, stretched to the gaps of the events table.
GAP_S, LIMIT_MS, AHEAD_MS, SEGMENT_MS = 1800, 1_800_000, 3_600_000, 7_200_000


def _ntz(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.monotonic_gate(records.mobility(spark, sf_dir))


def active_count_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(activity.active_count(_gated(spark, sf_dir)))


def record_count_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(activity.record_count(_gated(spark, sf_dir)).select("user_key", "win_begin", "records"))


def monotonic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(ordering.monotonic_gate(records.mobility(spark, sf_dir), order=("value", "seq")).select("user_key", "seq", "ts"))


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(ordering.rate_limit(_gated(spark, sf_dir), LIMIT_MS).select("user_key", "seq", "ts"))


def mode_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.mobility(spark, sf_dir).groupBy("raw_mode", "mode").agg(F.count("*").alias("n"), F.count_if(values.is_active("mode")).alias("active"))


def accurate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.accurate(ordering.drop_unknown(records.mobility(spark, sf_dir))).select("user_key", "seq", F.round("accuracy", 6).alias("accuracy"))


def calendar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = ("minute", "hour", "day", "week", "month", "year")
    return _ntz(windows.windows_task(_gated(spark, sf_dir), units, F.count("*").alias("records"), include_open=True))


def window_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = windows.window_stats(_gated(spark, sf_dir))
    return _ntz(s.select("user_key", "win_begin", "first_ts", "last_ts", "records", "slots", F.round("median_gap_s", 6).alias("median_gap_s"), F.round("missing_rate", 6).alias("missing_rate")))


def mobility_coverage_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = coverage.mobility_coverage(_gated(spark, sf_dir))
    return _ntz(c.select("user_key", "win_begin", F.round("coverage", 6).alias("coverage")))


def activity_time_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(activity.mode_time(_gated(spark, sf_dir)).drop("win_end"))


def activity_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = activity.episodes(_gated(spark, sf_dir), max_gap_s=GAP_S, linger_ms=600_000)
    return _ntz(e.withColumn("types", F.array_join("types", ",")))


def episode_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = activity.episode_distance(_gated(spark, sf_dir), max_gap_s=GAP_S, linger_ms=600_000)
    return _ntz(e.withColumn("miles", F.round("miles", 6)))


def activity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = activity.episode_distance(_gated(spark, sf_dir), max_gap_s=GAP_S, linger_ms=600_000)
    s = activity.summarise(e.withColumn("steps", F.when(F.col("duration_s") % 2 == 0, F.col("duration_s")).otherwise(-1)))
    return _ntz(s.select("user_key", "win_begin", F.round("miles", 6).alias("miles"), "steps", F.round("max_mph", 6).alias("max_mph")))


def geodiameter_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geodiameter.geodiameter(_gated(spark, sf_dir))
    return _ntz(g.select("user_key", "win_begin", "first_ts", F.round("miles", 6).alias("miles")))


def place_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places.place_state(_gated(spark, sf_dir), ahead_ms=AHEAD_MS)
    return _ntz(p.select("user_key", "seq", "ts", F.round("max_m", 3).alias("max_m"), "state"))


def place_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places.place_segments(_gated(spark, sf_dir), ahead_ms=AHEAD_MS, max_gap_ms=SEGMENT_MS, long_split=False, by_day=False)
    return _ntz(p.select("user_key", "state", "start", "end", "points", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng")))


def place_segments_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places.place_segments(_gated(spark, sf_dir), ahead_ms=AHEAD_MS, max_gap_ms=SEGMENT_MS)
    return _ntz(places.leader_places(p).select("user_key", "segment", "part", "state", "start", "end", "points", "place_id"))


def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = ordering.accurate(records.mobility(spark, sf_dir)).select("user_key", "seq", "lat", "lng")
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("id"))
    gazetteer = s.select(F.col("id").alias("place_id"), (40.70 + F.col("id") * 0.0005).alias("lat"), (-74.0 + (F.col("id") % 10) * 0.0005).alias("lng"))
    return places.nearest_place(points, gazetteer).select("user_key", "seq", "place_id")


def hmm_rectify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(hmm.rectify(_gated(spark, sf_dir), max_gap_s=GAP_S).select("user_key", "seq", "ts", "mode", "rectified"))


def home_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The events have hardly any place that lasts, so each record lasts until the next, at one of two places or on the way.
    stay = F.col("raw_mode").isin("still", "walking", "running")
    g = _gated(spark, sf_dir).withColumn("end", F.lead("ts").over(Window.partitionBy("user_key").orderBy("ts", "seq"))).filter("end is not null")
    s = g.select("user_key", "tz", F.col("seq").alias("segment"), F.col("ts").alias("start"), "end", F.when(stay, "Place").otherwise("Moves").alias("state"), F.when(stay, F.when(F.col("k") % 3 == 0, 1).otherwise(0)).cast("long").alias("place_id"))
    s = s.withColumn("lat", 40.7 + F.col("place_id") * 0.5).withColumn("lng", -74.0 + F.col("place_id") * 0.5)
    return _ntz(home.home_time(segments.split_by_day(s)))


def segment_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(segments.remove_overlap(records.moves(spark, sf_dir)).select("user_key", "seq", "start", "end"))


def split_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = records.moves(spark, sf_dir).withColumn("end", F.timestamp_millis(ms("start") + F.col("seq") % 5 * 50_000_000))
    return _ntz(segments.split_by_day(long).select("user_key", "seq", "start", "end"))


def clip_to_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records.moves(spark, sf_dir).withColumn("day", F.date_add(F.to_date("start"), (F.col("seq") % 2).cast("int")))
    long = m.withColumn("end", F.timestamp_millis(ms("start") + F.col("seq") % 5 * 50_000_000))
    return _ntz(segments.clip_to_day(long).select("user_key", "seq", "start", "end"))


def moves_coverage_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = coverage.segment_coverage(segments.remove_overlap(records.moves(spark, sf_dir)))
    return _ntz(c.select("user_key", "win_begin", F.round("coverage", 6).alias("coverage")))


def moves_activity_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = activity.segment_summary(records.moves(spark, sf_dir))
    return _ntz(s.select("user_key", "win_begin", "first_ts", *[F.round(c, 3).alias(c) for c in ("total_s", "active_s", "sedentary_s", "transport_s", "miles")], "steps", F.col("episodes").cast("bigint").alias("episodes")))


def moves_home_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Stretched, so that more than half of a day is covered.
    m = records.moves(spark, sf_dir).withColumn("end", F.timestamp_millis(ms("end") + 400_000)).withColumn("ts", F.col("end"))
    return _ntz(home.segment_home_time(segments.remove_overlap(m)))


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = segments.track_points(records.moves(spark, sf_dir))
    return _ntz(p.select("user_key", "seq", "point", "ts", F.round("lat", 4).alias("lat"), F.round("lng", 4).alias("lng")))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records.mobility(spark, sf_dir)
    return m.select("user_key", "seq", "ts", F.when(F.col("k") % 3 == 0, "google").otherwise("moves").alias("provider"), F.when(F.col("k") % 2 == 0, "mail profile").otherwise("activity").alias("scope"), F.when(F.col("k") % 4 == 0, "").when(F.col("k") % 4 == 1, F.col("user_key").cast("string")).otherwise("other").alias("username"))


def latest_credential(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir)
    best = records.latest_credential(t.filter("seq % 2 = 0"), t.filter("seq % 2 = 1"))
    return _ntz(best.select("user_key", "seq", "ts", "from_requester"))


def latest_oauth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(records.latest_oauth(_tokens(spark, sf_dir), "goo", "profile|activity").select("user_key", "seq", "ts", "scope"))


def store_range_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = records.range_query(records.mobility(spark, sf_dir), user=0, start="2024-01-05", end="2024-01-20", descending=True, max_rows=100)
    return _ntz(q.select("user_key", "seq", "ts"))


def stream_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ntz(records.stream_scan(records.mobility(spark, sf_dir), "2024-01-15", ["user_key", "seq", "ts", "mode"]))


def upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse = records.mobility(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    return _ntz(sinks.upsert_last(coarse).select("user_key", "ts", "seq", "mode"))


def tick_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A user has a tick a second from the first record on, as many as records.
    m = records.mobility(spark, sf_dir)
    user = Window.partitionBy("user_key")
    first = F.ceil(F.min(ms("ts")).over(user) / 1000) * 1000
    at = first + (F.row_number().over(user.orderBy("seq")) - 1) * 1000
    ticks = m.select("user_key", "seq", "tz", at.cast("long").alias("data")).withColumn("ts", F.timestamp_millis("data"))
    return _ntz(activity.record_count(records.odd(ticks), "hour").select("user_key", "win_begin", "records"))


def mail_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # Replies, quoted messages with their headers, headers alone; a marker without headers is text.
    i, marker = F.col("doc_id"), "\n----- Original Message -----\n"
    quoted = F.when(i % 4 == 0, F.concat("text", F.lit("\nOn Mon Jun 7, 2010 at 8:50 PM, X wrote:\n> quoted")))
    quoted = quoted.when(i % 4 == 2, F.concat("text", F.lit(f"{marker}From: a\nSubject: b\nmore"))).when(i % 4 == 3, F.concat("text", F.lit("\nFrom: a\nTo: b\nSubject: c\nmore")))
    quoted = quoted.when(i % 8 == 1, F.concat("text", F.lit(f"{marker}more"))).otherwise(F.col("text"))
    return d.select("doc_id", F.md5(values.clean_mail(quoted)).alias("cleaned"))


def sent_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    part = F.struct("turn", F.col("text").alias("text"), (F.col("role") == "user").alias("attachment"))
    mail = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    mail = mail.withColumn("folder", F.when(F.col("conv_id") % 3 == 0, "INBOX").otherwise(records.SENT_FOLDER))
    return records.sent_mail(mail).select("conv_id", F.md5("content").alias("content"), "attachment")


def wifi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records.mobility(spark, sf_dir)
    mac = lambda n: F.concat(F.lit("00:1a:2b:3c:4d:"), F.lower(F.lpad(F.hex((F.col("k") + n) % 256), 2, "0")))
    scan = F.when(F.col("k") % 7 != 0, F.array(F.struct(mac(0).alias("bssid"), F.lit(-40.0).alias("strength")), F.struct(F.lit("home").alias("bssid"), F.lit(-50.0).alias("strength")), F.struct(mac(1).alias("bssid"), F.lit(-60.0).alias("strength"))))
    w = m.withColumn("scan", scan).withColumn("wifis", values.wifi_map("scan"))
    return w.select("seq", F.size(F.map_keys("wifis")).alias("n"), F.array_max(F.map_keys("wifis")).alias("last"))


def token_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tokens(spark, sf_dir).select("user_key", "seq", values.token_key("provider", F.concat("scope", F.lit(".read"))).alias("key"))
    tokens = t.groupBy("user_key", "key").agg(F.max("seq").alias("seq")).groupBy("user_key").agg(F.map_from_entries(F.collect_list(F.struct("key", "seq"))).alias("m"))
    m = values.put(values.remove("m", F.lit("moves:activity_read")), F.lit("extra"), F.lit(1).cast("bigint"))
    return tokens.select("user_key", F.array_join(F.array_sort(F.map_keys(m)), ";").alias("keys"), values.has_all(m, F.array(F.lit("extra"), F.lit("google:activity_read"))).alias("both"))


def record_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records.mobility(spark, sf_dir)
    text = F.concat(F.lit('{"metadata":{"timestamp":"'), print_iso(F.col("ts"), F.lit("-04:00")), F.lit('","location":{"latitude":'), F.coalesce(F.col("lat"), F.lit(0.0)).cast("string"), F.lit(',"longitude":1.5,"accuracy":-1,"provider":"","time":1000,"timezone":"+01:00"},"extra":1},"data":{"mode":"'), F.col("raw_mode"), F.lit('"}}'))
    d = records.decode(m.select("user_key", "seq", text.alias("json")), "struct<mode: string>")
    again = records.decode(d.select("user_key", "seq", records.encode(d).alias("json")), "struct<mode: string>")
    return _ntz(again.select("user_key", "seq", "ts", "tz", F.col("location.ts").alias("loc_ts"), F.col("location.tz").alias("loc_tz"), F.col("data.mode").alias("mode")))


def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, tz = parse_iso(F.col("s"))
    m = records.mobility(spark, sf_dir).select("seq", print_iso(F.col("ts"), F.when(F.col("k") % 2 == 0, "+05:30").otherwise("-08:00")).alias("s"))
    return _ntz(m.select("seq", ts.alias("ts"), tz.alias("tz")))


QUERIES = [active_count_daily, record_count_hourly, monotonic_gate, rate_limit, mode_normalise, accurate_records, calendar_windows, window_stats, mobility_coverage_hourly, activity_time_daily, activity_episodes, episode_distance, activity_summary, geodiameter_daily, place_state, place_segments, place_segments_split, nearest_place, hmm_rectify, home_time, segment_dedup, split_by_day, clip_to_day, moves_coverage_hourly, moves_activity_daily, moves_home_time, track_points, latest_credential, latest_oauth, store_range_topk, stream_scan, upsert_last, tick_count, mail_clean, sent_mail, wifi_scan, token_map, record_json, iso_times]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


MOBILITY = """
e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events),
m AS (SELECT CAST(floor(user_id / 75.0) AS BIGINT) AS user_key, event_id AS seq, CAST(date_trunc('millisecond', ts) AS TIMESTAMP) AS ts, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 AS ms,
  CASE WHEN k >= 95 THEN 'moonwalk' WHEN event_type = 'view' THEN 'still' WHEN event_type = 'click' THEN 'walking' WHEN event_type = 'signup' THEN 'running' WHEN event_type = 'purchase' THEN 'drive' ELSE 'bike' END AS raw_mode,
  CASE WHEN k >= 95 THEN 'UNKNOWN' WHEN event_type = 'view' THEN 'STILL' WHEN event_type = 'click' THEN 'WALK' WHEN event_type = 'signup' THEN 'RUN' WHEN event_type = 'purchase' THEN 'DRIVE' ELSE 'CYCLING' END AS mode,
  CASE WHEN k % 10 = 9 THEN NULL ELSE 40.70 + k * 0.0002E0 END AS lat, CASE WHEN k % 10 = 9 THEN NULL ELSE -74.00 + (value % 10) * 0.0005E0 END AS lng,
  CASE WHEN k % 10 = 9 THEN NULL ELSE value % 130 END AS accuracy, value, k FROM e),
g AS (SELECT * FROM (SELECT *, max(ms) OVER (PARTITION BY user_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM m) WHERE was IS NULL OR ms > was)"""
MOVES = """,
v AS (SELECT user_key, seq, ts AS "start", ms AS a, ms + CAST(floor(value * 10000) AS BIGINT) AS b, raw_mode IN ('still', 'running') AS placed, raw_mode, value, k, raw_mode IN ('walking', 'bike', 'moonwalk') AS walked FROM m)"""
_HOME = """,
s AS (SELECT user_key, ms AS a, lead(ms) OVER (PARTITION BY user_key ORDER BY ms, seq) AS b, CASE WHEN raw_mode IN ('still', 'walking', 'running') THEN CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END END AS place FROM g),
d AS (SELECT user_key, place, d, greatest(a, d * 86400000) AS a, least(b, (d + 1) * 86400000 - 1) AS b FROM (SELECT *, unnest(generate_series(a // 86400000, b // 86400000)) AS d FROM s WHERE b IS NOT NULL)),
c AS (SELECT * FROM d WHERE a < b QUALIFY d < max(d) OVER (PARTITION BY user_key)),
p AS (SELECT *, min(a) FILTER (place IS NOT NULL) OVER w AS p0, max(a) FILTER (place IS NOT NULL) OVER w AS p1 FROM c WINDOW w AS (PARTITION BY user_key, d)),
r AS (SELECT *, row_number() OVER w AS n, arg_min(place, a) OVER w2 AS home FROM p WHERE a BETWEEN p0 AND p1 WINDOW w AS (PARTITION BY user_key, d ORDER BY a), w2 AS (PARTITION BY user_key, d)),
h AS (SELECT *, min(n) FILTER (place IS DISTINCT FROM home) OVER w AS away0, max(n) FILTER (place IS DISTINCT FROM home) OVER w AS away1 FROM r WINDOW w AS (PARTITION BY user_key, d)),
t AS (SELECT user_key, d, min(home) AS home, arg_max(place, a) AS last_place, min(a) AS a0, max(b) AS b1, sum((b - a) // 1000) AS span, max(away0) AS away0, max(b) FILTER (n = away0 - 1) AS left_at, max(a) FILTER (n = away1 + 1) AS back_at, coalesce(sum(b - a) FILTER (n > away0 AND n < away1 AND place = home), 0) AS inside FROM h GROUP BY user_key, d)
SELECT user_key, make_timestamp(d * 86400000000) AS win_begin, make_timestamp(b1 * 1000) AS "at", make_timestamp(left_at * 1000) AS leave, make_timestamp(back_at * 1000) AS "return",
  CASE WHEN away0 IS NULL THEN 86400 ELSE CAST((left_at - d * 86400000 + (d + 1) * 86400000 - 1 - back_at + inside) // 1000 AS BIGINT) END AS home_s, 40.7E0 + home * 0.5E0 AS home_lat, -74.0E0 + home * 0.5E0 AS home_lng
FROM t WHERE hour(make_timestamp(a0 * 1000)) <= 11 AND hour(make_timestamp(b1 * 1000)) >= 20 AND span > 43200 AND home = last_place"""
_ACTIVE = "mode IN ('RUN', 'WALK', 'CYCLING')"
_CLOSED = "FROM x QUALIFY win_begin < max(win_begin) OVER (PARTITION BY user_key)"
_DAY, _HOUR = "date_trunc('day', ts)", "date_trunc('hour', ts)"


def _stamp(x: str) -> str:
    return f"make_timestamp(({x}) * 1000)"


def _metres(a: str, b: str, radius: float = 6371009.0) -> str:
    return f"(2 * {radius}::DOUBLE * asin(sqrt(least(1.0, pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * pow(sin(radians({b}.lng - {a}.lng) / 2), 2)))))"


_PLACES = f""",
l AS (SELECT *, max(ms) OVER (PARTITION BY user_key) AS final FROM g WHERE lat IS NOT NULL AND lng IS NOT NULL),
d AS (SELECT p.user_key, p.seq, p.ts, p.ms, p.mode, p.lat, p.lng, coalesce(max(CASE WHEN q.seq IS NULL THEN NULL WHEN abs(p.lat - q.lat) <= 1e-4 AND abs(p.lng - q.lng) <= 1e-4 THEN 0 ELSE {_metres('p', 'q')} END), -1) AS max_m
  FROM l p LEFT JOIN l q ON p.user_key = q.user_key AND q.seq > p.seq AND q.ms BETWEEN p.ms AND p.ms + {AHEAD_MS} WHERE p.final - p.ms > {AHEAD_MS} GROUP BY ALL),
s AS (SELECT *, coalesce(last_value(CASE WHEN {_ACTIVE} AND max_m > 100 THEN 'Moves' WHEN max_m > 2000 THEN 'Moves' WHEN max_m >= 0 AND max_m < 50 THEN 'Place' END IGNORE NULLS) OVER (PARTITION BY user_key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'Place') AS state FROM d)"""
_EPISODES = f""",
w AS (SELECT *, {_DAY} AS win_begin FROM g), c AS (SELECT * FROM w QUALIFY win_begin < max(win_begin) OVER (PARTITION BY user_key)),
f AS (SELECT *, ((ms - lag(ms) OVER o) // 1000 > {GAP_S}) OR (NOT {_ACTIVE} AND ms - last_value(CASE WHEN {_ACTIVE} THEN ms END IGNORE NULLS) OVER (PARTITION BY user_key, win_begin ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 600000) AS ends FROM c WINDOW o AS (PARTITION BY user_key, win_begin ORDER BY ts, seq)),
h AS (SELECT *, sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY user_key, win_begin ORDER BY ts, seq) AS cut FROM f),
i AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY user_key, win_begin ORDER BY cut) AS INT) AS episode FROM h WHERE {_ACTIVE})"""
_DEDUP = MOVES + """,
u AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_key, b ORDER BY seq) = 1),
n AS (SELECT *, lead(a) OVER o AS na, lead(b) OVER o AS nb FROM u WINDOW o AS (PARTITION BY user_key ORDER BY b, seq)),
r AS (SELECT user_key, seq, placed, k, a, CASE WHEN na < b AND a < nb THEN greatest(a, na) ELSE b END AS b FROM n WHERE nb IS NOT NULL),
z AS (SELECT * FROM r WHERE b > a)"""
_MOVES_HOME = _DEDUP.replace("u AS (SELECT * FROM v", "u AS (SELECT * REPLACE (b + 400000 AS b) FROM v") + """,
q AS (SELECT *, b // 86400000 AS d, CASE WHEN placed THEN CAST(k % 5 AS BIGINT) END AS place FROM z QUALIFY b // 86400000 < max(b // 86400000) OVER (PARTITION BY user_key)),
i AS (SELECT *, row_number() OVER (PARTITION BY user_key, d ORDER BY b, seq) AS n FROM q),
y AS (SELECT user_key, d, CASE WHEN bool_or(place = 0) THEN 0 WHEN arg_min(place, n) = arg_max(place, n) THEN arg_min(place, n) END AS home FROM i GROUP BY ALL HAVING sum(b - a) / 86399000.0 > 0.5),
h AS (SELECT i.*, home, place IS NOT DISTINCT FROM home AS stay FROM i JOIN y USING (user_key, d) WHERE home IS NOT NULL),
f AS (SELECT *, min(n) FILTER (NOT stay) OVER w AS away0, max(n) FILTER (NOT stay) OVER w AS away1 FROM h WINDOW w AS (PARTITION BY user_key, d)),
t AS (SELECT user_key, d, min(home) AS home, min(b) AS b0, max(b) FILTER (n = away0 - 1) AS left_at, max(a) FILTER (n = away1 + 1) AS back_at, coalesce(sum((b - a) // 1000) FILTER (stay AND n > away0 AND n < away1), 0) AS inside FROM f GROUP BY user_key, d)
SELECT user_key, make_timestamp(d * 86400000000) AS win_begin, make_timestamp(b0 * 1000) AS "at", CASE WHEN back_at IS NOT NULL THEN make_timestamp(left_at * 1000) END AS leave, CASE WHEN left_at IS NOT NULL THEN make_timestamp(back_at * 1000) END AS "return",
  CASE WHEN left_at IS NULL OR back_at IS NULL THEN 86400 ELSE CAST((left_at - d * 86400000) // 1000 + ((d + 1) * 86400000 - 1 - back_at) // 1000 + inside AS BIGINT) END AS home_s, 40.70E0 + home * 0.001E0 AS home_lat, CAST(-74.0 AS DOUBLE) AS home_lng FROM t"""


def oracle_sql() -> dict[str, str]:
    with_m = "WITH RECURSIVE " + MOBILITY
    units = {"minute": ("date_trunc('minute', ts)", "INTERVAL 1 MINUTE"), "hour": (_HOUR, "INTERVAL 1 HOUR"), "day": (_DAY, "INTERVAL 1 DAY"), "week": ("CAST(DATE '1970-01-01' + CAST(floor(datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) / 7) * 7 AS INT) AS TIMESTAMP)", "INTERVAL 7 DAY"), "month": ("CAST(date_trunc('month', ts) AS TIMESTAMP)", "INTERVAL 1 MONTH"), "year": ("CAST(date_trunc('year', ts) AS TIMESTAMP)", "INTERVAL 1 YEAR")}
    tokens = ", t AS (SELECT user_key, seq, ts, CASE WHEN k % 3 = 0 THEN 'google' ELSE 'moves' END AS provider, CASE WHEN k % 2 = 0 THEN 'mail profile' ELSE 'activity' END AS scope, CASE WHEN k % 4 = 0 THEN '' WHEN k % 4 = 1 THEN CAST(user_key AS VARCHAR) ELSE 'other' END AS username FROM m)"
    seconds = lambda modes: f"coalesce(sum(CASE WHEN gap < 330 AND mode IN ({modes}) THEN gap / 2.0 END), 0) + coalesce(sum(CASE WHEN gap < 330 AND was_mode IN ({modes}) THEN gap / 2.0 END), 0)"
    day_ms = 86_400_000
    return {
        "active_count_daily": f"{with_m}, x AS (SELECT user_key, {_DAY} AS win_begin, {_DAY} + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS win_end, count(*) FILTER ({_ACTIVE}) AS active_count FROM g GROUP BY ALL) SELECT * {_CLOSED}",
        "record_count_hourly": f"{with_m}, x AS (SELECT user_key, {_HOUR} AS win_begin, count(*) AS records FROM g GROUP BY ALL) SELECT * {_CLOSED}",
        "monotonic_gate": f"{with_m} SELECT user_key, seq, ts FROM (SELECT *, max(ms) OVER (PARTITION BY user_key ORDER BY value, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM m) WHERE last IS NULL OR ms > last",
        "rate_limit": f"{with_m}, o AS (SELECT user_key, seq, ts, ms, min(ms) OVER (PARTITION BY user_key ORDER BY ms RANGE BETWEEN {LIMIT_MS} FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt, row_number() OVER (PARTITION BY user_key ORDER BY ms) AS n FROM g), y AS (SELECT user_key, seq, ts, ms, nxt FROM o WHERE n = 1 UNION ALL SELECT o.user_key, o.seq, o.ts, o.ms, o.nxt FROM y JOIN o ON o.user_key = y.user_key AND o.ms = y.nxt) SELECT user_key, seq, ts FROM y",
        "mode_normalise": f"{with_m} SELECT raw_mode, mode, count(*) AS n, count(*) FILTER ({_ACTIVE}) AS active FROM m GROUP BY ALL",
        "accurate_records": f"{with_m} SELECT user_key, seq, round(accuracy, 6) AS accuracy FROM m WHERE mode <> 'UNKNOWN' AND lat IS NOT NULL AND accuracy <= 100",
        "calendar_windows": with_m + " " + " UNION ALL ".join(f"SELECT user_key, '{u}' AS unit, {b} AS win_begin, {b} + {step} - INTERVAL 1 MILLISECOND AS win_end, count(*) AS records FROM g GROUP BY ALL" for u, (b, step) in units.items()),
        "window_stats": f"{with_m}, w AS (SELECT *, {_DAY} AS win_begin, (ms - lag(ms) OVER (PARTITION BY user_key, {_DAY} ORDER BY ts, seq)) / 1000.0 AS gap FROM g), x AS (SELECT user_key, win_begin, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS records, count(DISTINCT (ms - epoch_ms(win_begin)) // 30000) AS slots, round(median(CAST(gap AS DOUBLE)), 6) AS median_gap_s, round(1 - count(DISTINCT (ms - epoch_ms(win_begin)) // 30000) / 2880.0, 6) AS missing_rate FROM w GROUP BY ALL) SELECT * {_CLOSED}",
        "mobility_coverage_hourly": f"{with_m}, w AS (SELECT *, {_HOUR} AS win_begin, ms - lag(ms) OVER (PARTITION BY user_key ORDER BY ts, seq) AS gap FROM g), x AS (SELECT user_key, win_begin, round(least(1.0, coalesce(sum(gap) FILTER (gap < 420000), 0) / 3599999.0), 6) AS coverage FROM w GROUP BY ALL) SELECT * {_CLOSED}",
        "activity_time_daily": f"{with_m}, w AS (SELECT *, {_DAY} AS win_begin FROM g), q AS (SELECT *, (ms - lag(ms) OVER o) // 1000 AS gap, lag(mode) OVER o AS was_mode FROM w WINDOW o AS (PARTITION BY user_key, win_begin ORDER BY ts, seq)), x AS (SELECT user_key, win_begin, min(ts) AS first_ts, CAST({seconds("'RUN','WALK','CYCLING'")} AS DOUBLE) AS active_s, CAST({seconds("'STILL','DRIVE'")} AS DOUBLE) AS sedentary_s, CAST({seconds("'DRIVE'")} AS DOUBLE) AS transport_s, CAST({seconds("'RUN','WALK','CYCLING','STILL','DRIVE'")} AS DOUBLE) AS total_s FROM q GROUP BY ALL) SELECT * {_CLOSED}",
        "activity_episodes": f"{with_m}{_EPISODES} SELECT user_key, win_begin, episode, min(ts) AS start, max(ts) AS \"end\", string_agg(DISTINCT mode, ',' ORDER BY mode) AS types, count(*) AS records FROM i GROUP BY user_key, win_begin, episode",
        "geodiameter_daily": f"{with_m}, w AS (SELECT *, {_DAY} AS win_begin FROM g), c AS (SELECT * FROM w QUALIFY win_begin < max(win_begin) OVER (PARTITION BY user_key)), a AS (SELECT * FROM c WHERE lat IS NOT NULL AND accuracy <= 100) SELECT p.user_key, p.win_begin, min(p.ts) AS first_ts, round(max({_metres('p', 'q', 6371009.0 / 1609.344)}), 6) AS miles FROM a p JOIN a q ON p.user_key = q.user_key AND p.win_begin = q.win_begin GROUP BY ALL HAVING count(DISTINCT (p.lat, p.lng)) > 1",
        "place_state": f"{with_m}{_PLACES} SELECT user_key, seq, ts, round(max_m, 3) AS max_m, state FROM s",
        "place_segments": f"{with_m}{_PLACES}, t AS (SELECT *, (state <> lag(state) OVER o) OR (ms - lag(ms) OVER o > {SEGMENT_MS}) AS cut FROM s WINDOW o AS (PARTITION BY user_key ORDER BY ts, seq)), u AS (SELECT *, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY user_key ORDER BY ts, seq) AS segment FROM t), v AS (SELECT * FROM u QUALIFY segment < max(segment) OVER (PARTITION BY user_key)) SELECT user_key, state, min(ts) AS start, max(ts) AS \"end\", count(*) AS points, CASE WHEN state = 'Place' THEN round(median(lat), 4) END AS lat, CASE WHEN state = 'Place' THEN round(median(lng), 4) END AS lng FROM v GROUP BY user_key, segment, state HAVING min(ts) < max(ts)",
        "nearest_place": f"{with_m}, p AS (SELECT CAST(s_suppkey AS BIGINT) AS place_id, 40.70 + s_suppkey * 0.0005E0 AS lat, -74.0 + (s_suppkey % 10) * 0.0005E0 AS lng FROM supplier), a AS (SELECT * FROM m WHERE lat IS NOT NULL AND accuracy <= 100) SELECT a.user_key, a.seq, arg_min(p.place_id, {_metres('a', 'p')}) FILTER ({_metres('a', 'p')} < 30) AS place_id FROM a CROSS JOIN p GROUP BY ALL",
        "home_time": f"{with_m}{_HOME}",
        "segment_dedup": f"{with_m}{_DEDUP} SELECT user_key, seq, {_stamp('a')} AS start, {_stamp('b')} AS \"end\" FROM z",
        "split_by_day": f"{with_m}, s AS (SELECT user_key, seq, ms AS a, ms + seq % 5 * 50000000 AS b FROM m), d AS (SELECT *, unnest(generate_series(a // {day_ms}, b // {day_ms})) AS d FROM s), c AS (SELECT user_key, seq, greatest(a, d * {day_ms}) AS lo, least(b, (d + 1) * {day_ms} - 1) AS hi FROM d) SELECT user_key, seq, {_stamp('lo')} AS start, {_stamp('hi')} AS \"end\" FROM c WHERE lo < hi",
        "clip_to_day": f"{with_m}, s AS (SELECT user_key, seq, greatest(ms, (ms // {day_ms} + seq % 2) * {day_ms}) AS a, least(ms + seq % 5 * 50000000, (ms // {day_ms} + seq % 2 + 1) * {day_ms} - 1) AS b FROM m) SELECT user_key, seq, {_stamp('a')} AS start, {_stamp('b')} AS \"end\" FROM s WHERE a <= b",
        "moves_coverage_hourly": f"{with_m}{_DEDUP}, c AS (SELECT user_key, unnest(generate_series(a // 3600000, b // 3600000)) AS w, a, b FROM z), y AS (SELECT user_key, w, sum(least(b, (w + 1) * 3600000 - 1) - greatest(a, w * 3600000)) AS covered FROM c GROUP BY ALL HAVING sum(least(b, (w + 1) * 3600000 - 1) - greatest(a, w * 3600000)) > 0), x AS (SELECT user_key, {_stamp('w * 3600000')} AS win_begin, round(least(1.0, covered / 3599999.0), 6) AS coverage FROM y) SELECT * {_CLOSED}",
        "moves_activity_daily": f"{with_m}{MOVES}, x AS (SELECT user_key, date_trunc('day', {_stamp('b')}) AS win_begin, min({_stamp('b')}) AS first_ts, round(CAST(sum((b - a) // 1000) AS DOUBLE), 3) AS total_s, round(CAST(sum(CASE WHEN walked THEN (b - a) / 1000.0 ELSE 0 END) AS DOUBLE), 3) AS active_s, round(CAST(sum((b - a) // 1000) - sum(CASE WHEN walked THEN (b - a) / 1000.0 ELSE 0 END) AS DOUBLE), 3) AS sedentary_s, round(CAST(sum(CASE WHEN raw_mode = 'drive' THEN (b - a) / 1000.0 ELSE 0 END) AS DOUBLE), 3) AS transport_s, round(sum(CASE WHEN walked THEN value * 10 * 0.000621371192E0 ELSE 0 END), 3) AS miles, coalesce(CAST(sum(k) FILTER (walked) AS BIGINT), -1) AS steps, count(*) FILTER (walked) AS episodes FROM v GROUP BY ALL) SELECT * {_CLOSED}",
        "moves_home_time": f"{with_m}{_MOVES_HOME}",
        "track_points": f"{with_m}{MOVES}, p AS (SELECT user_key, seq, 0 AS point, CASE WHEN placed THEN b WHEN k % 2 = 0 THEN CAST(floor(a + (b - a) * 0.25E0) AS BIGINT) ELSE b END AS t_ms, CASE WHEN placed THEN 40.70 + (k % 5) * 0.001E0 ELSE 40.7 + k * 0.0001E0 END AS lat FROM v UNION ALL SELECT user_key, seq, 1, CASE WHEN k % 2 = 0 THEN CAST(floor(a + (b - a) * 0.5E0) AS BIGINT) ELSE b END, 40.8 + k * 0.0001E0 FROM v WHERE NOT placed) SELECT user_key, seq, point, {_stamp('t_ms')} AS ts, round(CAST(lat AS DOUBLE), 4) AS lat, CAST(-74.0 AS DOUBLE) AS lng FROM p",
        "latest_credential": f"{with_m}{tokens}, b AS (SELECT CAST(user_key AS VARCHAR) AS user_key, seq, ts, FALSE AS from_requester FROM t WHERE seq % 2 = 0 AND username = '' UNION ALL SELECT username, seq, ts, TRUE FROM t WHERE seq % 2 = 1 AND username <> '') SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY ts DESC, from_requester DESC, seq DESC) = 1",
        "latest_oauth": f"{with_m}{tokens} SELECT user_key, seq, ts, scope FROM t WHERE provider LIKE '%goo%' AND username = CAST(user_key AS VARCHAR) QUALIFY row_number() OVER (PARTITION BY user_key ORDER BY ts DESC, seq DESC) = 1",
        "store_range_topk": f"{with_m} SELECT user_key, seq, ts FROM m WHERE user_key = 0 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC, seq DESC LIMIT 100",
        "stream_scan": f"{with_m} SELECT user_key, seq, ts, mode FROM m WHERE ts >= TIMESTAMP '2024-01-15'",
        "upsert_last": f"{with_m} SELECT user_key, {_HOUR} AS ts, seq, mode FROM m QUALIFY row_number() OVER (PARTITION BY user_key, {_HOUR} ORDER BY seq DESC) = 1",
        "tick_count": f"{with_m}, u AS (SELECT user_key, (min(ms) + 999) // 1000 * 1000 AS f, count(*) AS n FROM m GROUP BY user_key), t AS (SELECT user_key, f + unnest(range(n)) * 1000 AS d FROM u), x AS (SELECT user_key, CAST(date_trunc('hour', make_timestamp(d * 1000)) AS TIMESTAMP) AS win_begin, count(*) AS records FROM t WHERE d % 2000 <> 0 GROUP BY ALL) SELECT * {_CLOSED}",
        "mail_clean": "SELECT doc_id, md5(text || CASE WHEN doc_id % 4 IN (0, 2, 3) THEN chr(10) WHEN doc_id % 8 = 1 THEN chr(10) || '----- Original Message -----' || chr(10) || 'more' ELSE '' END) AS cleaned FROM documents",
        "sent_mail": "SELECT conv_id, md5(coalesce(string_agg(CASE WHEN role <> 'user' THEN text END, '' ORDER BY turn), '')) AS content, bool_or(role = 'user') AS attachment FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id",
        "wifi_scan": f"{with_m} SELECT seq, CASE WHEN k % 7 <> 0 THEN 2 END AS n, CASE WHEN k % 7 <> 0 THEN CAST(112394521856 AS BIGINT) + k + 1 END AS last FROM m",
        "token_map": f"{with_m}{tokens}, k2 AS (SELECT DISTINCT user_key, replace(provider || ':' || scope || '.read', '.', '_') AS key FROM t UNION SELECT DISTINCT user_key, 'extra' FROM t) SELECT user_key, string_agg(key, ';' ORDER BY key) AS keys, bool_or(key = 'google:activity_read') AS both FROM k2 WHERE key <> 'moves:activity_read' GROUP BY user_key",
        "record_json": f"{with_m} SELECT user_key, seq, ts, '-04:00' AS tz, TIMESTAMP '1970-01-01 00:00:01' AS loc_ts, '+01:00' AS loc_tz, raw_mode AS mode FROM m",
        "iso_times": f"{with_m} SELECT seq, ts, CASE WHEN k % 2 = 0 THEN '+05:30' ELSE '-08:00' END AS tz FROM m",
    }
