"""Further registered queries: zones over a change of offset, several streams, tokens, trips; and SQL for recursive operators."""

from __future__ import annotations

import math
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.geo import DRIFT_M_S, LEAST_ACCURACY
from strandline.functions.times import ms
from strandline.functions.values import STATES
from strandline.operators import addresses, blocks, coverage, hmm, ordering, places, segments, windows
from strandline.plans import catalogue as base
from strandline.session import shared_dir
from strandline.sources import records
from strandline.sources.store import Store

#: The events are of January; so many days later they lie around the changes of offset of America/New_York and Europe/Berlin.
SHIFT_DAYS = 69
ZONES = ("America/New_York", "Europe/Berlin")


def _later(c: str | F.Column) -> F.Column:
    return F.timestamp_millis(ms(c) + SHIFT_DAYS * 86_400_000)


def _zoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    zone = F.when(F.col("k") % 2 == 0, ZONES[0]).otherwise(ZONES[1])
    return records.mobility(spark, sf_dir).withColumn("ts", _later("ts")).withColumn("tz", zone)


def zoned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base._ntz(windows.windows_task(_zoned(spark, sf_dir), ("hour", "day", "month"), F.count("*").alias("records")))


def first_zone_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = windows.window_task(_zoned(spark, sf_dir), "day", F.count("*").alias("records"), F.min("ts").alias("first_ts"), first_zone=True)
    return base._ntz(w)


def zoned_split_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _zoned(spark, sf_dir).withColumn("start", F.col("ts"))
    long = m.withColumn("end", F.timestamp_millis(ms("start") + F.col("seq") % 5 * 50_000_000))
    return base._ntz(segments.split_by_day(long).select("user_key", "seq", "start", "end"))


def aligned_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = records.mobility(spark, sf_dir).filter("k % 5 <> 0 or seq % 7 = 0").withColumn("stream", F.col("k") % 5 == 0)
    return base._ntz(windows.aligned_windows(two, "day", F.count("*").alias("records"), streams=2))


def token_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = base._tokens(spark, sf_dir).withColumn("invalid", F.col("seq") % 5 == 0)
    return base._ntz(records.token_store(t).select("user_key", "provider", "scope", "seq", "ts"))


def location_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records.mobility(spark, sf_dir).withColumn("loc_ts", F.timestamp_millis(ms("ts") - F.col("k") % 7 * 1_800_000))
    return base._ntz(places.by_location_time(m).select("user_key", "seq", "ts"))


def trip_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = places.place_segments(base._gated(spark, sf_dir), ahead_ms=base.AHEAD_MS, max_gap_ms=base.SEGMENT_MS, long_split=False, by_day=False)
    ends = [F.round(c, 4).alias(c) for c in ("from_lat", "from_lng", "to_lat", "to_lng")]
    return base._ntz(p.select("user_key", "state", "start", "end", *ends))


def storyline_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records.moves(spark, sf_dir).withColumn("end", F.timestamp_millis(ms("start") + F.col("seq") % 5 * 50_000_000))
    days = m.groupBy("user_key", "tz", F.to_date("start").alias("day")).agg(F.array_sort(F.collect_list(F.struct("start", "end", F.col("seq").alias("id")))).alias("segments"))
    return base._ntz(records.storylines(days, "2024-01-10").select("user_key", "day", "seq", "id", "start", "end"))


def coverage_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _zoned(spark, sf_dir).withColumn("tz", F.lit("+00:00"))
    gaps = coverage.mobility_coverage(m, "month", include_open=True).withColumn("of", F.lit("gaps"))
    long = m.select("user_key", "tz", F.col("ts").alias("start"), F.timestamp_millis(ms("ts") + 3_600_000).alias("end"))
    spans = coverage.segment_coverage(long, "month", include_open=True).withColumn("of", F.lit("spans"))
    return base._ntz(gaps.unionByName(spans).select("user_key", "of", "win_begin", "win_end", F.round("coverage", 6).alias("coverage")))


def sharded_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records.shard(records.mobility(spark, sf_dir), 5)
    return base._ntz(ordering.monotonic_gate(m).select("user_key", "seq", "ts"))


def _half_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user that holds half of all records."""
    m = records.mobility(spark, sf_dir)
    return m.withColumn("user_key", F.when(F.col("seq") % 2 == 0, F.lit(-1)).otherwise(F.col("user_key")).cast("long"))


def split_user_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base._ntz(blocks.split_gate(_half_one(spark, sf_dir), block_rows=1000).select("user_key", "seq", "ts"))


def split_user_coverage_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = coverage.mobility_coverage(blocks.split_gate(_half_one(spark, sf_dir), block_rows=1000), block_rows=1000)
    return base._ntz(c.select("user_key", "win_begin", F.round("coverage", 6).alias("coverage")))


def shared_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every accurate fix of all users, named by one table.
    p = ordering.accurate(base._gated(spark, sf_dir)).select("user_key", F.col("ts").alias("start"), F.col("seq").alias("segment"), "lat", "lng")
    return base._ntz(addresses.with_addresses(p, addresses.new_addresses(p)).select("user_key", "segment", "start", "place_id"))


def store_upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Two writes into a store: in an hour of a user the second one's last record stays, if it has any.
    m = records.mobility(spark, sf_dir).select("user_key", "seq", F.date_trunc("hour", "ts").alias("ts"), "mode")
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", user_parts=4)
    store.upsert(m.filter("seq % 3 <> 0"), 0)
    store.upsert(m.filter("seq % 3 = 0"), 1)
    return base._ntz(store.read(since=datetime(2024, 1, 5), until=datetime(2024, 1, 20)))


QUERIES = [
    store_upserts,
    shared_addresses,
    split_user_gate,
    split_user_coverage_hourly,
    zoned_windows,
    first_zone_windows,
    zoned_split_by_day,
    aligned_counts,
    token_scopes,
    location_order,
    trip_ends,
    storyline_segments,
    coverage_monthly,
    sharded_gate,
]


def queries() -> dict:
    return {q.__name__: q for q in QUERIES}


_ZONED = f""",
z0 AS (SELECT *, ts + INTERVAL {SHIFT_DAYS} DAY AS inst, CASE WHEN k % 2 = 0 THEN '{ZONES[0]}' ELSE '{ZONES[1]}' END AS tz FROM m),
z AS (SELECT *, (inst AT TIME ZONE 'UTC') AT TIME ZONE tz AS wall FROM z0)"""
_UNITS = {"hour": "1 HOUR", "day": "1 DAY", "month": "1 MONTH"}


def _zoned_windows() -> str:
    parts = [
        f"SELECT * FROM (SELECT user_key, '{u}' AS unit, CAST(date_trunc('{u}', wall) AS TIMESTAMP) AS win_begin,"
        f" CAST(date_trunc('{u}', wall) AS TIMESTAMP) + INTERVAL {step} - INTERVAL 1 MILLISECOND AS win_end, count(*) AS records FROM z GROUP BY ALL)"
        " QUALIFY win_begin < max(win_begin) OVER (PARTITION BY user_key)"
        for u, step in _UNITS.items()
    ]
    return " UNION ALL ".join(f"({p})" for p in parts)


_FIRST_ZONE = """,
a AS (SELECT *, date_trunc('day', wall) AS own FROM z),
b AS (SELECT *, first_value(tz) OVER (PARTITION BY user_key, own ORDER BY inst, seq) AS tz1 FROM a),
c AS (SELECT *, CAST(date_trunc('day', (inst AT TIME ZONE 'UTC') AT TIME ZONE tz1) AS TIMESTAMP) AS win_begin FROM b)
SELECT user_key, win_begin, win_begin + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS win_end, count(*) AS records, min(inst) AS first_ts
FROM c GROUP BY user_key, win_begin QUALIFY win_begin < max(win_begin) OVER (PARTITION BY user_key)"""
_ZONED_SPLIT = """,
s AS (SELECT user_key, seq, tz, inst AS a, inst + INTERVAL 1 MILLISECOND * (seq % 5 * 50000000) AS b FROM z WHERE seq % 5 > 0),
w AS (SELECT *, CAST((a AT TIME ZONE 'UTC') AT TIME ZONE tz AS DATE) AS d0, CAST((b AT TIME ZONE 'UTC') AT TIME ZONE tz AS DATE) AS d1 FROM s),
d AS (SELECT *, unnest(generate_series(CAST(d0 AS TIMESTAMP), CAST(d1 AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM w),
c AS (SELECT user_key, seq, greatest(a, (d AT TIME ZONE tz) AT TIME ZONE 'UTC') AS lo,
  least(b, ((d + INTERVAL 1 DAY) AT TIME ZONE tz) AT TIME ZONE 'UTC' - INTERVAL 1 MILLISECOND) AS hi FROM d)
SELECT user_key, seq, lo AS start, hi AS "end" FROM c WHERE lo < hi"""
_ALIGNED = """,
a AS (SELECT *, date_trunc('day', ts) AS win_begin, k % 5 = 0 AS stream FROM m WHERE k % 5 <> 0 OR seq % 7 = 0),
ends_ AS (SELECT user_key, min(reached) AS reached FROM (SELECT user_key, stream, max(win_begin) AS reached FROM a GROUP BY ALL) GROUP BY user_key HAVING count(*) = 2)
SELECT user_key, CAST(win_begin AS TIMESTAMP) AS win_begin, CAST(win_begin AS TIMESTAMP) + INTERVAL 1 DAY - INTERVAL 1 MILLISECOND AS win_end, count(*) AS records
FROM a JOIN ends_ USING (user_key) WHERE win_begin < reached GROUP BY ALL"""
_SCOPES = """,
t AS (SELECT user_key, seq, ts, seq % 5 = 0 AS invalid, CASE WHEN k % 3 = 0 THEN 'google' ELSE 'moves' END AS provider,
  unnest(CASE WHEN k % 2 = 0 THEN ['mail', 'profile'] ELSE ['activity'] END) AS scope FROM m),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY user_key, provider, scope ORDER BY ts DESC, seq DESC) = 1)
SELECT user_key, provider, scope, seq, ts FROM b WHERE NOT invalid"""
_LOCATED = """,
l AS (SELECT user_key, seq, ts, ms - k % 7 * 1800000 AS inst FROM m WHERE lat IS NOT NULL AND lng IS NOT NULL),
o AS (SELECT *, max(inst) OVER (PARTITION BY user_key ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM l)
SELECT user_key, seq, make_timestamp(inst * 1000) AS ts FROM o WHERE was IS NULL OR inst >= was"""
_SEGMENTS = f"""{base._PLACES},
t AS (SELECT *, (state <> lag(state) OVER o) OR (ms - lag(ms) OVER o > {base.SEGMENT_MS}) AS cut FROM s WINDOW o AS (PARTITION BY user_key ORDER BY ts, seq)),
u AS (SELECT *, CAST(sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY user_key ORDER BY ts, seq) AS BIGINT) AS segment FROM t),
v AS (SELECT * FROM u QUALIFY segment < max(segment) OVER (PARTITION BY user_key))"""
_TRIPS = f"""{_SEGMENTS}
SELECT user_key, state, min(ts) AS start, max(ts) AS "end",
  {', '.join(f"CASE WHEN state = 'Moves' THEN round(arg_{f}({c}, (ts, seq)), 4) END AS {n}_{c}" for n, f in (('from', 'min'), ('to', 'max')) for c in ('lat', 'lng'))}
FROM v GROUP BY user_key, segment, state HAVING min(ts) < max(ts)"""
_STORY = """,
s AS (SELECT user_key, seq AS id, ms AS a, ms + seq % 5 * 50000000 AS b, ms // 86400000 AS d FROM m),
n AS (SELECT *, CAST(row_number() OVER (PARTITION BY user_key, d ORDER BY a, b, id) - 1 AS INT) AS seq FROM s),
c AS (SELECT user_key, d, seq, id, a, least(b, (d + 1) * 86400000 - 1) AS b FROM n)
SELECT user_key, CAST(make_timestamp(d * 86400000000) AS DATE) AS day, seq, id, make_timestamp(a * 1000) AS start, make_timestamp(b * 1000) AS "end"
FROM c WHERE a <= b AND b >= epoch_ms(TIMESTAMP '2024-01-10')"""
_MONTHLY = f"""{_ZONED},
g1 AS (SELECT user_key, inst, epoch_ms(inst) AS a, epoch_ms(inst) - lag(epoch_ms(inst)) OVER (PARTITION BY user_key ORDER BY inst, seq) AS gap FROM z),
y AS (SELECT user_key, 'gaps' AS "of", CAST(date_trunc('month', inst) AS TIMESTAMP) AS win_begin, coalesce(sum(gap) FILTER (gap < 420000), 0) AS held FROM g1 GROUP BY ALL),
x AS (SELECT user_key, a, a + 3600000 AS b, unnest(generate_series(CAST(date_trunc('month', inst) AS TIMESTAMP), CAST(date_trunc('month', inst + INTERVAL 1 HOUR) AS TIMESTAMP), INTERVAL 1 MONTH)) AS win_begin FROM g1),
p AS (SELECT user_key, 'spans' AS "of", win_begin, sum(least(b, epoch_ms(win_begin + INTERVAL 1 MONTH) - 1) - greatest(a, epoch_ms(win_begin))) AS held FROM x GROUP BY ALL),
q AS (SELECT * FROM y UNION ALL SELECT * FROM p WHERE held > 0)
SELECT user_key, "of", win_begin, win_begin + INTERVAL 1 MONTH - INTERVAL 1 MILLISECOND AS win_end,
  round(least(1.0, held / CAST(epoch_ms(win_begin + INTERVAL 1 MONTH) - 1 - epoch_ms(win_begin) AS DOUBLE)), 6) AS coverage FROM q"""


def _viterbi() -> str:
    """The likeliest states, by one recursion forwards over the records of all batches and one back."""
    k = len(hmm.START)
    code = f"CASE mode2 {' '.join(f'WHEN {chr(39)}{s}{chr(39)} THEN {i}' for i, s in enumerate(STATES[:k]))} ELSE {k} END"
    emit = lambda s: "[" + ", ".join(repr(math.log(p)) + "::DOUBLE" for p in (*hmm.EMIT[s], 0.25)) + "][o.obs + 1]"
    move = lambda r, s: f"f.s{r} + {math.log(hmm.MOVE[r][s])!r}::DOUBLE"
    steps, back = [], []
    for s in range(k):
        ways = [move(r, s) for r in range(k)]
        best = f"greatest({', '.join(ways)})"
        steps.append(f"{best} + {emit(s)} AS s{s}")
        back.append("CASE " + " ".join(f"WHEN {w} = {best} THEN {r}" for r, w in enumerate(ways)) + " END")
    first = ", ".join(f"{math.log(hmm.START[s])!r}::DOUBLE + {emit(s)} AS s{s}" for s in range(k))
    top = "CASE " + " ".join(f"WHEN s{s} = greatest({', '.join(f's{r}' for r in range(k))}) THEN {s}" for s in range(k)) + " END"
    names = "[" + ", ".join(f"'{s}'" for s in STATES[:k]) + "]"
    return f""",
h0 AS (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY user_key ORDER BY ts, seq) > {base.GAP_S * 1000}, FALSE) AS gap, mode = 'STILL' AS still FROM g WHERE mode <> 'UNKNOWN'),
h1 AS (SELECT *, sum(CASE WHEN gap OR NOT still THEN 1 ELSE 0 END) OVER (PARTITION BY user_key ORDER BY ts, seq) AS run FROM h0),
h2 AS (SELECT *, row_number() OVER (PARTITION BY user_key, run, still ORDER BY ts, seq) AS place FROM h1),
h3 AS (SELECT *, CAST(sum(CASE WHEN gap OR (still AND place > 1 AND (place - 1) % {hmm.MAX_STILL} = 0) THEN 1 ELSE 0 END) OVER (PARTITION BY user_key ORDER BY ts, seq) AS BIGINT) AS batch FROM h2),
h4 AS (SELECT user_key, seq, ts, ms, mode, lat, lng, batch FROM h3 QUALIFY batch < max(batch) OVER (PARTITION BY user_key)),
h5 AS (SELECT *, row_number() OVER (PARTITION BY user_key, batch ORDER BY ms, seq) AS n, count(*) OVER (PARTITION BY user_key, batch) AS size FROM h4),
near AS (SELECT p.user_key, p.batch, p.n, max({base._metres('p', 'q')}) / 1000 AS km, bool_or(q.mode = 'WALK') AS walks FROM h5 p JOIN h5 q ON p.user_key = q.user_key AND p.batch = q.batch
  AND abs(p.ms - q.ms) < {hmm.DRIVE_VERIFY_MS} AND p.lat IS NOT NULL AND q.lat IS NOT NULL AND p.mode = 'DRIVE' AND p.size >= {hmm.MIN_BATCH} GROUP BY ALL),
h6 AS (SELECT h5.*, CASE WHEN km < {hmm.DRIVE_KM} THEN CASE WHEN walks THEN 'WALK' ELSE 'STILL' END ELSE mode END AS mode2 FROM h5 LEFT JOIN near USING (user_key, batch, n)),
o AS (SELECT *, {code} AS obs FROM h6 WHERE size >= {hmm.MIN_BATCH}),
f AS (SELECT o.user_key, o.batch, o.n, o.size, {first}, CAST(NULL AS INT[]) AS back FROM o WHERE n = 1
  UNION ALL SELECT o.user_key, o.batch, o.n, o.size, {', '.join(steps)}, [{', '.join(back)}]::INT[] AS back FROM f JOIN o ON o.user_key = f.user_key AND o.batch = f.batch AND o.n = f.n + 1),
r AS (SELECT user_key, batch, n, back, CAST({top} AS INT) AS state FROM f WHERE n = size
  UNION ALL SELECT f.user_key, f.batch, f.n, f.back, r.back[r.state + 1] FROM r JOIN f ON f.user_key = r.user_key AND f.batch = r.batch AND f.n = r.n - 1)
SELECT h6.user_key, h6.seq, h6.ts, h6.mode, coalesce({names}[r.state + 1], h6.mode) AS rectified FROM h6 LEFT JOIN r USING (user_key, batch, n)"""


#: Fixes of the episodes, smoothed by recursion; miles are those of steps that are not too fast.
_WALKED = f"""{base._EPISODES},
x AS (SELECT user_key, win_begin, episode, ms, lat, lng, greatest(coalesce(accuracy, {LEAST_ACCURACY}), {LEAST_ACCURACY})::DOUBLE AS acc,
  row_number() OVER (PARTITION BY user_key, win_begin, episode ORDER BY ms, seq) AS n FROM i WHERE lat IS NOT NULL AND lng IS NOT NULL AND accuracy < 100),
kf AS (SELECT user_key, win_begin, episode, n, ms, lat::DOUBLE AS lat, lng::DOUBLE AS lng, (acc * acc)::FLOAT AS var FROM x WHERE n = 1
  UNION ALL SELECT user_key, win_begin, episode, n, ms, lat + gain * (y - lat), lng + gain * (z - lng), ((1 - gain)::FLOAT * var1)::FLOAT
  FROM (SELECT *, var1::DOUBLE / (var1::DOUBLE + acc * acc) AS gain FROM (SELECT x.user_key, x.win_begin, x.episode, x.n, x.ms, kf.lat, kf.lng, x.lat AS y, x.lng AS z, x.acc,
    (kf.var::DOUBLE + greatest(0, x.ms - kf.ms) * {DRIFT_M_S}::DOUBLE * {DRIFT_M_S}::DOUBLE / 1000)::FLOAT AS var1
    FROM kf JOIN x ON x.user_key = kf.user_key AND x.win_begin = kf.win_begin AND x.episode = kf.episode AND x.n = kf.n + 1))),
st AS (SELECT p.user_key, p.win_begin, p.episode, {base._metres('p', 'q', 6371009.0 / 1609.344)} AS step, (q.ms - p.ms) / 3600000.0::DOUBLE AS hours
  FROM kf p JOIN kf q ON p.user_key = q.user_key AND p.win_begin = q.win_begin AND p.episode = q.episode AND q.n = p.n + 1),
ml AS (SELECT user_key, win_begin, episode, sum(step) FILTER (hours > 0 AND step / hours < 7) AS miles FROM st GROUP BY ALL),
ep AS (SELECT user_key, win_begin, episode, min(ts) AS start, max(ts) AS "end", (max(ms) - min(ms)) // 1000 AS duration_s FROM i GROUP BY user_key, win_begin, episode),
wk AS (SELECT ep.*, coalesce(miles, 0) AS miles FROM ep LEFT JOIN ml USING (user_key, win_begin, episode))"""
_SUMMARY = f"""{_WALKED}
SELECT user_key, win_begin, round(sum(miles), 6) AS miles, CAST(coalesce(sum(duration_s) FILTER (duration_s % 2 = 0), -1) AS BIGINT) AS steps,
  round(coalesce(max(miles / (duration_s / 3600.0::DOUBLE)) FILTER (duration_s > 300), -1), 6) AS max_mph FROM wk GROUP BY user_key, win_begin"""
_HOUR_MS = 3_600_000
#: Long segments are cut by recursion over their points; a user's places are named by recursion over the places.
_SPLIT = f"""{_SEGMENTS},
a AS (SELECT *, row_number() OVER (PARTITION BY user_key, segment ORDER BY ts, seq) - 1 AS i FROM u),
c AS (SELECT user_key, segment, i, ms AS ms1, ms AS ms0, CAST(0 AS BIGINT) AS begin FROM a WHERE i = 0
  UNION ALL SELECT user_key, segment, i, ms, CASE WHEN far THEN kept ELSE ms0 END, CASE WHEN far THEN i - {places.HELD_POINTS} ELSE begin END
  FROM (SELECT a.user_key, a.segment, a.i, a.ms, c.ms0, c.begin, h.ms AS kept, (c.ms1 - c.ms0) // {_HOUR_MS} > {places.LONG_HOURS} AND a.i - c.begin > {places.LONG_POINTS} AS far
    FROM c JOIN a ON a.user_key = c.user_key AND a.segment = c.segment AND a.i = c.i + 1
    LEFT JOIN a h ON h.user_key = a.user_key AND h.segment = a.segment AND h.i = a.i - {places.HELD_POINTS})),
cuts AS (SELECT DISTINCT user_key, segment, begin FROM c WHERE begin > 0),
all_parts AS (SELECT a.user_key, a.segment, a.state, a.ts, a.seq, a.ms, a.lat, a.lng, CAST(count(cuts.begin) AS INT) AS part
  FROM a LEFT JOIN cuts ON cuts.user_key = a.user_key AND cuts.segment = a.segment AND cuts.begin <= a.i GROUP BY ALL),
parts AS (SELECT * FROM all_parts QUALIFY (segment, part) < max((segment, part)) OVER (PARTITION BY user_key)),
rows_ AS (SELECT user_key, segment, part, state, min(ms) AS lo, max(ms) AS hi, count(*) AS points, median(lat) AS lat, median(lng) AS lng
  FROM parts GROUP BY user_key, segment, part, state HAVING min(ms) < max(ms)),
days AS (SELECT *, unnest(generate_series(lo // 86400000, hi // 86400000)) AS d FROM rows_),
slices AS (SELECT user_key, segment, part, state, points, lat, lng, greatest(lo, d * 86400000) AS lo, least(hi, (d + 1) * 86400000 - 1) AS hi FROM days),
pl AS (SELECT user_key, segment, part, lo, lat, lng, row_number() OVER (PARTITION BY user_key ORDER BY lo, segment, part) AS n FROM slices WHERE lo < hi AND state = 'Place'),
lead_ AS (SELECT user_key, n, segment, part, lo, [{{'lat': lat, 'lng': lng}}] AS seen, CAST(1 AS BIGINT) AS at FROM pl WHERE n = 1
  UNION ALL SELECT user_key, n, segment, part, lo, CASE WHEN found > 0 THEN seen ELSE list_append(seen, {{'lat': lat, 'lng': lng}}) END, CASE WHEN found > 0 THEN found ELSE len(seen) + 1 END
  FROM (SELECT pl.*, l.seen, coalesce(list_position(list_transform(l.seen, lambda x: {base._metres('pl', 'x')} < {places.PLACE_M}), TRUE), 0) AS found
    FROM lead_ l JOIN pl ON pl.user_key = l.user_key AND pl.n = l.n + 1))
SELECT s.user_key, s.segment, s.part, s.state, make_timestamp(s.lo * 1000) AS start, make_timestamp(s.hi * 1000) AS "end", s.points, CAST(l.at - 1 AS BIGINT) AS place_id
FROM slices s LEFT JOIN lead_ l ON s.state = 'Place' AND l.user_key = s.user_key AND l.segment = s.segment AND l.part = s.part AND l.lo = s.lo WHERE s.lo < s.hi"""


#: Fixes of all users are named by recursion over them, in the order of time.
_ADDRESSES = f""",
ao AS (SELECT user_key, seq AS segment, ts, ms AS lo, lat, lng, row_number() OVER (ORDER BY ms, CAST(user_key AS VARCHAR), seq) AS n
  FROM g WHERE lat IS NOT NULL AND lng IS NOT NULL AND accuracy <= 100),
al AS (SELECT n, [{{'lat': lat, 'lng': lng, 'id': n}}] AS seen, n AS at FROM ao WHERE n = 1
  UNION ALL SELECT n, CASE WHEN found > 0 THEN seen ELSE list_append(seen, {{'lat': lat, 'lng': lng, 'id': n}}) END, CASE WHEN found > 0 THEN seen[found].id ELSE n END
  FROM (SELECT ao.n, ao.lat, ao.lng, l.seen, coalesce(list_position(list_transform(l.seen, lambda x: {base._metres('ao', 'x')} < {places.PLACE_M}), TRUE), 0) AS found FROM al l JOIN ao ON ao.n = l.n + 1))
SELECT p.user_key, p.segment, p.ts AS start, f.lo || '/' || f.user_key || '/' || f.segment AS place_id
FROM ao p JOIN al ON al.n = p.n JOIN ao f ON f.n = al.at"""
_HALF = """,
hm AS (SELECT CASE WHEN seq % 2 = 0 THEN CAST(-1 AS BIGINT) ELSE user_key END AS user_key, seq, ts, ms FROM m),
hg AS (SELECT * FROM hm QUALIFY ms > coalesce(max(ms) OVER (PARTITION BY user_key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))"""
_HALF_COVERAGE = f"""{_HALF},
hw AS (SELECT *, date_trunc('hour', ts) AS win_begin, ms - lag(ms) OVER (PARTITION BY user_key ORDER BY ts, seq) AS gap FROM hg),
hc AS (SELECT user_key, win_begin, round(least(1.0, coalesce(sum(gap) FILTER (gap < {coverage.MAX_GAP_MS}), 0) / CAST(3599999 AS DOUBLE)), 6) AS coverage FROM hw GROUP BY ALL)
SELECT user_key, CAST(win_begin AS TIMESTAMP) AS win_begin, coverage FROM hc QUALIFY win_begin < max(win_begin) OVER (PARTITION BY user_key)"""


def oracle_sql() -> dict[str, str]:
    with_m = "WITH RECURSIVE " + base.MOBILITY
    return {
        "store_upserts": f"{with_m}, h AS (SELECT user_key, seq, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts, mode FROM m) SELECT * FROM h WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' QUALIFY row_number() OVER (PARTITION BY user_key, ts ORDER BY seq % 3 = 0 DESC, seq DESC) = 1",
        "shared_addresses": f"{with_m}{_ADDRESSES}",
        "split_user_gate": f"{with_m}{_HALF} SELECT user_key, seq, ts FROM hg",
        "split_user_coverage_hourly": f"{with_m}{_HALF_COVERAGE}",
        "zoned_windows": f"{with_m}{_ZONED} {_zoned_windows()}",
        "first_zone_windows": f"{with_m}{_ZONED}{_FIRST_ZONE}",
        "zoned_split_by_day": f"{with_m}{_ZONED}{_ZONED_SPLIT}",
        "aligned_counts": f"{with_m}{_ALIGNED}",
        "token_scopes": f"{with_m}{_SCOPES}",
        "location_order": f"{with_m}{_LOCATED}",
        "trip_ends": f"{with_m}{_TRIPS}",
        "storyline_segments": f"{with_m}{_STORY}",
        "coverage_monthly": f"{with_m}{_MONTHLY}",
        "sharded_gate": f"{with_m} SELECT user_key, seq, ts FROM g",
        "hmm_rectify": f"{with_m}{_viterbi()}",
        "episode_distance": f"{with_m}{_WALKED} SELECT user_key, win_begin, episode, start, \"end\", duration_s, round(miles, 6) AS miles FROM wk",
        "activity_summary": f"{with_m}{_SUMMARY}",
        "place_segments_split": f"{with_m}{_SPLIT}",
    }
