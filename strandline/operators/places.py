"""Places and trips from located records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.geo import distance, np_distance
from strandline.functions.times import ms
from strandline.functions.values import is_active
from strandline.operators.ordering import location_gate
from strandline.operators.segments import split_by_day

AHEAD_MS = 600_000
SAME_DEGREES = 1e-4
ACTIVE_M, FAR_M, NEAR_M = 100.0, 2000.0, 50.0
MAX_GAP_MS = 1_200_000
LONG_HOURS, LONG_POINTS, HELD_POINTS = 3, 20, 10
PLACE_M = 30.0


def displacement(df: DataFrame, *, ahead_ms: int = AHEAD_MS) -> DataFrame:
    """Adds ``max_m``: the greatest distance to records that come later, within ``ahead_ms``; -1 without one.

    Only records that are complete, with a later one beyond that span, stay.
    Coordinates at most 1e-4 degrees apart are the same. A range frame holds the
    few records within the span, not the user's history.
    """
    df = df.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull()).withColumn("_ms", ms("ts"))
    user = Window.partitionBy("user_key")
    near = F.collect_list(F.struct("seq", "lat", "lng")).over(user.orderBy("_ms").rangeBetween(0, ahead_ms))
    df = df.withColumn("_near", near).withColumn("_last", F.max("_ms").over(user)).filter(F.col("_last") - F.col("_ms") > ahead_ms)
    same = lambda p: (F.abs(p["lat"] - F.col("lat")) <= SAME_DEGREES) & (F.abs(p["lng"] - F.col("lng")) <= SAME_DEGREES)
    metres = F.transform(F.filter("_near", lambda p: p["seq"] > F.col("seq")), lambda p: F.when(same(p), 0.0).otherwise(distance(F.col("lat"), F.col("lng"), p["lat"], p["lng"])))
    return df.withColumn("max_m", F.coalesce(F.array_max(metres), F.lit(-1.0))).drop("_ms", "_near", "_last")


def by_location_time(df: DataFrame, at: str = "loc_ts") -> DataFrame:
    """Located records in the order of their location's time, which becomes theirs; older locations are left out."""
    return location_gate(df, at=at).withColumn("ts", F.col(at))


def place_state(df: DataFrame, *, ahead_ms: int = AHEAD_MS) -> DataFrame:
    """Adds ``state``, Place or Moves; between the limits, and without a record ahead, it stays what it was, at first Place."""
    df = displacement(df, ahead_ms=ahead_ms)
    m = F.col("max_m")
    own = F.when(is_active("mode") & (m > ACTIVE_M), "Moves").when(m > FAR_M, "Moves").when((m >= 0) & (m < NEAR_M), "Place")
    order = Window.partitionBy("user_key").orderBy("ts", "seq")
    return df.withColumn("state", F.coalesce(F.last(own, ignorenulls=True).over(order), F.lit("Place")))


def with_segments(df: DataFrame, *, max_gap_ms: int = MAX_GAP_MS, include_open: bool = False) -> DataFrame:
    """Adds ``segment``, a new one at a change of state or after a gap of more than ``max_gap_ms``."""
    order = Window.partitionBy("user_key").orderBy("ts", "seq")
    cut = (F.col("state") != F.lag("state").over(order)) | (ms("ts") - F.lag(ms("ts")).over(order) > max_gap_ms)
    df = df.withColumn("segment", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(order)).withColumn("part", F.lit(0))
    if include_open:
        return df
    return df.withColumn("_open", F.max("segment").over(Window.partitionBy("user_key"))).filter("segment < _open").drop("_open")


def split_long(df: DataFrame) -> DataFrame:
    """Numbers the ``part``s of long segments.

    When a further record of the segment arrives after four whole hours and more
    than 20 points of it, all but the last 10 of these are cut off as a part of
    their own, and so on; the segment's last records are never a reason to cut. What
    is cut depends on the cut before, so each segment is gone through in order.
    """
    columns = df.columns

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "seq"])
        t = pdf["ts"].to_numpy("datetime64[ms]").astype(np.int64)
        part, begin, now = np.zeros(len(t), np.int32), 0, 0
        for i in range(1, len(t)):
            if (t[i - 1] - t[begin]) // 3_600_000 > LONG_HOURS and i - begin > LONG_POINTS:
                begin, now = i - HELD_POINTS, now + 1
                part[begin:] = now
        return pdf.assign(part=part)[columns]

    return df.groupBy("user_key", "segment").applyInPandas(cut, df.schema)


def segment_rows(df: DataFrame) -> DataFrame:
    """One row per part of a segment: state, start, end, points, tz; parts of no length have none.

    A place has its median position (lat, lng), a trip its first and last point
    (from_lat, from_lng, to_lat, to_lng); the others' are null.
    """
    order = F.struct("ts", "seq")
    rows = df.groupBy("user_key", "segment", "part", "state").agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.count("*").alias("points"),
        *[F.median(c).alias(c) for c in ("lat", "lng")],
        *[F.min_by(c, order).alias(f"from_{c}") for c in ("lat", "lng")],
        *[F.max_by(c, order).alias(f"to_{c}") for c in ("lat", "lng")],
        F.min_by("tz", order).alias("tz"),
    )

    def of(state: str, *names: str) -> list[Column]:
        return [F.when(F.col("state") == state, F.col(c)).alias(c) for c in names]

    ends = of("Moves", "from_lat", "from_lng", "to_lat", "to_lng")
    at = of("Place", "lat", "lng")
    return rows.filter("start < end").select("user_key", "segment", "part", "state", "start", "end", "points", *at, *ends, "tz")


def place_segments(df: DataFrame, *, ahead_ms: int = AHEAD_MS, max_gap_ms: int = MAX_GAP_MS, long_split: bool = True, by_day: bool = True, include_open: bool = False) -> DataFrame:
    """Located records -> places and trips, cut at local midnights.

    Records with a ``loc_ts`` go by the time of their location.
    """
    df = by_location_time(df) if "loc_ts" in df.columns else df
    if long_split:
        # Parts cut off from the open segment are complete; its last part is not.
        held = split_long(with_segments(place_state(df, ahead_ms=ahead_ms), max_gap_ms=max_gap_ms, include_open=True))
        if not include_open:
            at = F.struct("segment", "part")
            held = held.withColumn("_open", F.max(at).over(Window.partitionBy("user_key"))).filter(at < F.col("_open")).drop("_open")
    else:
        held = with_segments(place_state(df, ahead_ms=ahead_ms), max_gap_ms=max_gap_ms, include_open=include_open)
    rows = segment_rows(held)
    return split_by_day(rows) if by_day else rows


def nearest_place(points: DataFrame, gazetteer: DataFrame, *, metres: float = PLACE_M) -> DataFrame:
    """Adds ``place_id``: the nearest place of ``gazetteer(place_id, lat, lng)`` within ``metres``, ties to the smaller id; else null.

    A grid join: a place is put in the cells around its own, and a point meets
    only the places of its cell. No side is broadcast.
    """
    dlat = metres / 111_000 * 1.01

    def cells(lat, lng):
        row = F.floor(lat / dlat)
        # Columns widen with the parallel of the row, alike for both sides.
        width = F.lit(dlat) / F.greatest(F.cos(F.radians((F.abs(row) + 2) * dlat)), F.lit(0.01))
        return row, width

    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    g = gazetteer.select(F.col("place_id").alias("_id"), F.col("lat").alias("_lat"), F.col("lng").alias("_lng")).withColumn("o", offsets)
    row = F.floor(F.col("_lat") / dlat) + F.col("o.i")
    width = F.lit(dlat) / F.greatest(F.cos(F.radians((F.abs(row) + 2) * dlat)), F.lit(0.01))
    g = g.withColumn("_r", row).withColumn("_c", F.floor(F.col("_lng") / width) + F.col("o.j")).drop("o")
    p_row, p_width = cells(F.col("lat"), F.col("lng"))
    p = points.withColumn("_key", F.monotonically_increasing_id()).withColumn("_r", p_row).withColumn("_c", F.floor(F.col("lng") / p_width))
    d = distance(F.col("lat"), F.col("lng"), F.col("_lat"), F.col("_lng"))
    joined = p.join(g, ["_r", "_c"], "left").withColumn("_d", F.when(d < metres, d))
    best = joined.groupBy(*points.columns, "_key").agg(F.min_by("_id", F.when(F.col("_d").isNotNull(), F.struct("_d", "_id"))).alias("place_id"))
    return best.drop("_key")


def leader_places(segments: DataFrame, *, metres: float = PLACE_M) -> DataFrame:
    """Adds ``place_id`` to a user's places: the first one, in time order, within ``metres``, or a new one.

    Stands in for a geocoder with a cache; ids are numbers from 0 in each user.
    Trips have none.
    """
    schema = T.StructType([*segments.schema.fields, T.StructField("place_id", T.LongType())])

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "segment", "part"])
        lats, lngs, ids = [], [], []
        for lat, lng in zip(pdf["lat"], pdf["lng"]):
            if pd.isna(lat):
                ids.append(pd.NA)
                continue
            near = np.flatnonzero(np_distance(lat, lng, np.array(lats), np.array(lngs)) < metres) if lats else []
            if len(near):
                ids.append(int(near[0]))
            else:
                ids.append(len(lats))
                lats.append(lat)
                lngs.append(lng)
        return pdf.assign(place_id=pd.array(ids, "Int64"))

    return segments.groupBy("user_key").applyInPandas(resolve, schema)
