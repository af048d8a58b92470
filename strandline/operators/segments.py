"""Intervals: de-overlapping, cutting by day, clipping, track points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.times import FIXED_MS, local, ms

DAY = FIXED_MS["day"]


def remove_overlap(df: DataFrame) -> DataFrame:
    """Ends each segment where its successor, by end, begins; what has no length left goes.

    The successor is the next to arrive, and segments arrive by their end; one
    that ends when an earlier one did never arrives. Each user's last segment has no
    successor yet and is held back.
    """
    arrival = Window.partitionBy("user_key").orderBy("end", "seq")
    fresh = df.withColumn("_n", F.row_number().over(Window.partitionBy("user_key", ms("end")).orderBy("end", "seq"))).filter("_n = 1").drop("_n")
    nxt, nxt_end = F.lead("start").over(arrival), F.lead("end").over(arrival)
    held = fresh.withColumn("_next", nxt).withColumn("_next_end", nxt_end).filter("_next_end is not null")
    overlaps = (F.col("_next") < F.col("end")) & (F.col("start") < F.col("_next_end"))
    cut = held.withColumn("end", F.when(overlaps, F.greatest("start", "_next")).otherwise(F.col("end")))
    return cut.filter(F.col("end") > F.col("start")).withColumn("ts", F.col("end")).drop("_next", "_next_end")


def midnight_ms(day: Column, tz: str = "tz") -> Column:
    """Epoch milliseconds of the local midnight that begins a day, given in days since 1970-01-01."""
    return ms(F.to_utc_timestamp(F.timestamp_millis(day * DAY), F.col(tz)))


def split_by_day(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Cuts [start, end] at local midnights: up to the day's last millisecond, then on from the next day's first.

    Intervals of no length give no rows.
    """
    spans = df.filter(ms(start) < ms(end))
    days = F.sequence(F.floor(ms(local(start, "tz")) / DAY), F.floor(ms(local(end, "tz")) / DAY))
    days = spans.withColumn("_d", F.explode(days))
    # Each midnight is an instant of its own, since the offset may change within the interval.
    low = F.greatest(ms(start), midnight_ms(F.col("_d")))
    high = F.least(ms(end), midnight_ms(F.col("_d") + 1) - 1)
    cut = days.withColumn("_lo", low).withColumn("_hi", high).filter("_lo < _hi")
    cut = cut.withColumn(start, F.timestamp_millis("_lo")).withColumn(end, F.timestamp_millis("_hi"))
    return cut.drop("_d", "_lo", "_hi")


def clip_to_day(df: DataFrame, day: str = "day") -> DataFrame:
    """Clips start and end to the local ``day`` (a date) and drops what turns around."""
    first = F.to_utc_timestamp(F.col(day).cast("timestamp"), F.col("tz"))
    last = F.timestamp_millis(ms(F.to_utc_timestamp(F.date_add(F.col(day), 1).cast("timestamp"), F.col("tz"))) - 1)
    return df.withColumn("start", F.greatest("start", first)).withColumn("end", F.least("end", last)).filter(F.col("start") <= F.col("end"))


def track_points(df: DataFrame) -> DataFrame:
    """Segments -> points: those of all activities in order, then the place at the segment's end.

    A point without a time has its activity's end. Accuracy is -1, not known.
    """
    of_activity = F.transform(F.coalesce("activities", F.array().cast(df.schema["activities"].dataType)), lambda a: F.transform(F.coalesce(a["track_points"], F.array().cast("array<struct<lat:double,lng:double,ts:timestamp>>")), lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"), F.coalesce(p["ts"], a["end"]).alias("ts"))))
    place = F.when(F.col("place").isNotNull(), F.array(F.struct(F.col("place.lat").alias("lat"), F.col("place.lng").alias("lng"), F.col("end").alias("ts")))).otherwise(F.array().cast("array<struct<lat:double,lng:double,ts:timestamp>>"))
    points = df.select("user_key", "seq", "tz", F.posexplode(F.concat(F.flatten(of_activity), place)).alias("point", "p"))
    return points.select("user_key", "seq", "point", "tz", F.col("p.ts").alias("ts"), F.col("p.lat").alias("lat"), F.col("p.lng").alias("lng"), F.lit(-1.0).alias("accuracy"), F.lit("Moves").alias("provider"))
