"""Reading records: JSON decoding, stream scans, storylines, mail, ticks, and the driver tables' views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.times import ms, parse_iso
from strandline.functions.values import body, has_attachment, normal_mode
from strandline.operators.ordering import latest
from strandline.operators.segments import clip_to_day

LOCATION = "latitude double, longitude double, accuracy double, provider string, timestamp string, time long, timezone string"


def shard(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """All of a user's records in one partition; later windows by user reuse it."""
    return df.repartition(partitions, "user_key") if partitions else df.repartition("user_key")


def decode(df: DataFrame, data_schema: str | T.DataType, json: str = "json") -> DataFrame:
    """``(user_key, seq, json)`` -> the envelope and ``data``; unknown fields are ignored, bad JSON gives nulls.

    A location's time is ISO text with its zone, or epoch milliseconds and a zone.
    """
    data = data_schema if isinstance(data_schema, str) else data_schema.simpleString()
    r = F.from_json(F.col(json), f"struct<metadata: struct<timestamp: string, location: struct<{LOCATION.replace(' ', ': ').replace(',:', ',')}>>, data: {data}>")
    df = df.withColumn("_r", r)
    ts, tz = parse_iso(F.col("_r.metadata.timestamp"))
    at = F.col("_r.metadata.location")
    loc_ts, loc_tz = parse_iso(at["timestamp"])
    place = F.struct(F.coalesce(loc_ts, F.timestamp_millis(at["time"])).alias("ts"), F.coalesce(loc_tz, at["timezone"]).alias("tz"), at["latitude"].alias("lat"), at["longitude"].alias("lng"), at["accuracy"].alias("accuracy"), at["provider"].alias("provider"))
    return df.select("user_key", "seq", ts.alias("ts"), tz.alias("tz"), F.when(at.isNotNull(), place).alias("location"), F.col("_r.data").alias("data"))


def encode(df: DataFrame) -> Column:
    """The record as JSON text: user, time with its zone, location, data."""
    from strandline.functions.times import print_iso

    where = F.when(F.col("location").isNotNull(), F.struct(F.col("location.lat").alias("latitude"), F.col("location.lng").alias("longitude"), F.col("location.accuracy").alias("accuracy"), F.col("location.provider").alias("provider"), print_iso(F.col("location.ts"), F.col("location.tz")).alias("timestamp")))
    return F.to_json(F.struct(F.struct(print_iso("ts", "tz").alias("timestamp"), where.alias("location")).alias("metadata"), F.col("data")))


def stream_scan(table: DataFrame, since=None, columns: list[str] | None = None) -> DataFrame:
    """Records from ``since`` on (inclusive), of the columns asked for; both reach the scan."""
    out = table if since is None else table.filter(F.col("ts") >= F.lit(since))
    return out.select(*columns) if columns else out


def range_query(table: DataFrame, user=None, start=None, end=None, *, descending: bool = False, max_rows: int = 0, tie: str = "seq") -> DataFrame:
    """A user's records between two times, both inclusive and each optional, in order, up to ``max_rows`` if over 0."""
    for column, op, value in (("user_key", "=", user), ("ts", ">=", start), ("ts", "<=", end)):
        if value is not None:
            c = F.col(column)
            table = table.filter(c == F.lit(value) if op == "=" else c >= F.lit(value) if op == ">=" else c <= F.lit(value))
    order = [F.col(c).desc() if descending else F.col(c).asc() for c in ("ts", tie)]
    out = table.orderBy(*order)
    return out.limit(max_rows) if max_rows > 0 else out


def storylines(df: DataFrame, since=None) -> DataFrame:
    """Storylines (user_key, tz, day, segments) -> segments, clipped to their day, from ``since`` on."""
    rows = df.select("user_key", "tz", "day", F.posexplode("segments").alias("seq", "s")).select("user_key", "tz", "day", "seq", "s.*")
    out = clip_to_day(rows).withColumn("ts", F.col("end"))
    return out if since is None else out.filter(F.col("ts") >= F.lit(since))


def pages(first, last, days: int = 7) -> list[tuple]:
    """Date ranges of ``days`` days from first to last, the last one cut short."""
    from datetime import timedelta

    out, at = [], first
    while at <= last:
        out.append((at, min(at + timedelta(days=days - 1), last)))
        at += timedelta(days=days)
    return out


def latest_credential(own: DataFrame, requester: DataFrame) -> DataFrame:
    """Each user's latest token: own stream rows with a blank username, requester's rows with the user's name; these win ties."""
    mine = own.filter(F.coalesce("username", F.lit("")) == "").withColumn("from_requester", F.lit(False))
    given = requester.filter(F.coalesce("username", F.lit("")) != "").withColumn("user_key", F.col("username")).withColumn("from_requester", F.lit(True))
    both = mine.withColumn("user_key", F.col("user_key").cast("string")).unionByName(given.withColumn("user_key", F.col("user_key").cast("string")))
    return latest(both, ["user_key"], [F.col("ts").desc(), F.col("from_requester").desc(), F.col("seq").desc()])


def latest_oauth(tokens: DataFrame, provider: str, scope: str) -> DataFrame:
    """Each user's latest token whose provider and scope contain the patterns and whose username is the user's."""
    found = tokens.filter(F.col("provider").rlike(provider) & F.col("scope").rlike(scope) & (F.col("username") == F.col("user_key").cast("string")))
    return latest(found, ["user_key"], [F.col("ts").desc(), F.col("seq").desc()])


def token_store(events: DataFrame) -> DataFrame:
    """Token events (user_key, seq, ts, provider, scope, token, invalid) -> the valid token of each user, provider and single scope.

    An event stands for every scope that it names, between spaces: a token that
    was granted or refreshed, or, if ``invalid``, one that the provider refused.
    The latest event of a scope counts.
    """
    single = events.withColumn("scope", F.explode(F.array_distinct(F.filter(F.split("scope", " "), lambda s: s != ""))))
    best = latest(single, ["user_key", "provider", "scope"], [F.col("ts").desc(), F.col("seq").desc()])
    return best.filter(~F.coalesce("invalid", F.lit(False))).drop("invalid")


#: The folder of what a user has sent; a fixed value.
SENT_FOLDER = "[Gmail]/Sent Mail"


def sent_mail(df: DataFrame, since=None, *, folder: str | None = SENT_FOLDER) -> DataFrame:
    """Mail rows (sent_time, parts) -> content without attachments, and whether there is one.

    Of rows with a ``folder`` only those of the given one count, unless that is None.
    """
    out = df if since is None else df.filter(F.col("sent_time") >= F.lit(since))
    out = out.filter(F.col("folder") == folder) if folder is not None and "folder" in df.columns else out
    return out.withColumn("content", body("parts")).withColumn("attachment", has_attachment("parts")).drop("parts")


def ticks(spark: SparkSession, since_ms: int, count: int, user="tick") -> DataFrame:
    """One record a second from the next whole second; data is its epoch time in milliseconds."""
    first = -(-since_ms // 1000) * 1000
    at = F.col("id") * 1000 + first
    return spark.range(count).select(F.lit(user).alias("user_key"), F.col("id").alias("seq"), F.timestamp_millis(at).alias("ts"), F.lit("+00:00").alias("tz"), at.alias("data"))


def odd(df: DataFrame) -> DataFrame:
    return df.filter(F.col("data") % 2000 != 0)


# --- views of the driver tables --------------------------------------------
def mobility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as mobility records: 75 users each become one, dense enough for minute-scale rules."""
    return as_mobility(spark.read.parquet(f"{sf_dir}/events.parquet"))


def mobility_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``mobility`` over a stream of the table's files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # Given as a pattern, the table may be one file as well as a folder.
    return as_mobility(spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet"))


def as_mobility(events: DataFrame) -> DataFrame:
    e = events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))
    kind = {"view": "still", "click": "walking", "signup": "running", "purchase": "drive"}
    raw = F.when(F.col("k") >= 95, "moonwalk")
    for event, mode in kind.items():
        raw = raw.when(F.col("event_type") == event, mode)
    located = F.col("k") % 10 != 9
    out = e.select(F.floor(F.col("user_id") / 75).cast("bigint").alias("user_key"), F.col("event_id").alias("seq"), F.timestamp_millis(ms(F.col("ts").cast("timestamp"))).alias("ts"), F.lit("+00:00").alias("tz"), raw.otherwise("bike").alias("raw_mode"), F.when(located, 40.70 + F.col("k") * 0.0002).alias("lat"), F.when(located, -74.00 + (F.col("value") % 10) * 0.0005).alias("lng"), F.when(located, F.col("value") % 130).alias("accuracy"), "value", "k")
    return out.withColumn("mode", normal_mode("raw_mode"))


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as segments: places for still and running records, otherwise one activity."""
    m = mobility(spark, sf_dir)
    end = F.timestamp_millis(ms("ts") + F.floor(F.col("value") * 10000).cast("bigint"))
    m = m.withColumn("start", F.col("ts")).withColumn("end", end)
    placed = F.col("raw_mode").isin("still", "running")
    spot = F.struct((F.col("k") % 5).cast("bigint").alias("id"), F.when(F.col("k") % 5 == 0, "Home").otherwise("Other").alias("type"), (40.70 + (F.col("k") % 5) * 0.001).alias("lat"), F.lit(-74.0).alias("lng"))
    group = F.when(F.col("raw_mode") == "walking", "walking").when(F.col("raw_mode") == "drive", "trip").when(F.col("raw_mode") == "bike", "cycling")
    point = lambda frac, lat: F.struct((F.lit(lat) + F.col("k") * 0.0001).alias("lat"), F.lit(-74.0).alias("lng"), F.when(F.col("k") % 2 == 0, F.timestamp_millis(F.floor(ms("start") + (ms("end") - ms("start")) * frac).cast("bigint"))).alias("ts"))
    act = F.struct(group.alias("group"), ((ms("end") - ms("start")) / 1000).alias("duration"), (F.col("value") * 10).alias("distance"), F.col("k").alias("steps"), F.col("start").alias("start"), F.col("end").alias("end"), F.array(point(0.25, 40.7), point(0.5, 40.8)).alias("track_points"))
    return m.select("user_key", "seq", F.col("end").alias("ts"), "tz", "start", "end", F.when(placed, spot).alias("place"), F.when(~placed, F.array(act)).alias("activities"))
