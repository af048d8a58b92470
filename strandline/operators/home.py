"""When a user left home and came back, day by day."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.times import local, ms
from strandline.operators.windows import closed_only, with_window

LATEST_FIRST_HOUR, EARLIEST_LAST_HOUR, MIN_SPAN_S = 11, 20, 43_200
MIN_SHARE = 0.5
DAY_S = 86_400
_OUT = "win_begin timestamp, at timestamp, leave timestamp, return timestamp, home_s long, home_lat double, home_lng double"


def _stay(home: list[bool]) -> tuple[int, int]:
    """Home rows at the front and at the back, not counting one twice."""
    front = next((i for i, h in enumerate(home) if not h), len(home))
    back = next((i for i, h in enumerate(reversed(home)) if not h), len(home))
    return front, min(back, len(home) - front)


def _row(pdf: pd.DataFrame, at, leave, back, seconds: int, lat, lng) -> pd.DataFrame:
    return pd.DataFrame({"user_key": pdf["user_key"].iloc[:1].to_numpy(), "win_begin": pdf["win_begin"].iloc[:1].to_numpy(), "at": [at], "leave": [leave], "return": [back], "home_s": [seconds], "home_lat": [lat], "home_lng": [lng]})


def _mobility_day(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_a", "_b"]).reset_index(drop=True)
    places = pdf.index[pdf["state"] == "Place"]
    none = pd.DataFrame(columns=["user_key", "win_begin", "at", "leave", "return", "home_s", "home_lat", "home_lng"])
    if not len(places):
        return none
    day = pdf.loc[places[0] : places[-1]].reset_index(drop=True)
    first, last = day.iloc[0], day.iloc[-1]
    spans = sum(int(b - a) // 1000 for a, b in zip(day["_a"], day["_b"]))
    if not (first["_first_hour"] <= LATEST_FIRST_HOUR and last["_last_hour"] >= EARLIEST_LAST_HOUR and spans > MIN_SPAN_S and first["place_id"] == last["place_id"]):
        return none
    home = ((day["state"] == "Place") & (day["place_id"] == first["place_id"])).tolist()
    front, back = _stay(home)
    if front == len(day):
        return _row(pdf, last["end"], pd.NaT, pd.NaT, DAY_S, first["lat"], first["lng"])
    leave, ret = day.iloc[front - 1], day.iloc[len(day) - back]
    inside = sum(int(r["_b"] - r["_a"]) for h, (_, r) in zip(home[front : len(day) - back], day.iloc[front : len(day) - back].iterrows()) if h)
    millis = int(leave["_b"] - leave["_win0"]) + int(ret["_win1"] - ret["_a"]) + inside
    return _row(pdf, last["end"], leave["end"], ret["start"], millis // 1000, first["lat"], first["lng"])


def _day_ends() -> list[Column]:
    """Instants of the window's first and last millisecond; the offset may change between them."""
    at = lambda wall: ms(F.to_utc_timestamp(wall, F.col("tz")))
    return [at(F.col("win_begin")).alias("_win0"), (at(F.timestamp_millis(ms("win_end") + 1)) - 1).alias("_win1")]


def home_time(segments: DataFrame, *, include_open: bool = False) -> DataFrame:
    """Places and trips (state, start, end, place_id, lat, lng) -> one row per user and day at home.

    Trips at both ends of the day do not count. The day needs a first segment
    that begins by hour 11, a last that ends in hour 20 or later, spans of more
    than half a day, and the same place, home, at both ends. Home stretches over
    adjacent stays there. Without any leave the day counts in full. ``at`` is
    the last segment's end. Days that fail have no row.
    """
    held = with_window(segments.withColumn("ts", F.col("start")).withColumn("seq", F.col("segment")), "day", first_zone=False)
    held = held if include_open else closed_only(held)
    held = held.select("user_key", "win_begin", "state", "start", "end", F.coalesce("place_id", F.lit(-1)).alias("place_id"), "lat", "lng", ms("start").alias("_a"), ms("end").alias("_b"), F.hour(local("start", "tz")).alias("_first_hour"), F.hour(local("end", "tz")).alias("_last_hour"), *_day_ends())
    key = segments.schema["user_key"].dataType.simpleString()
    return held.groupBy("user_key", "win_begin").applyInPandas(_mobility_day, f"user_key {key}, {_OUT}")


def _segment_day(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["_b", "seq"]).reset_index(drop=True)
    none = pd.DataFrame(columns=["user_key", "win_begin", "at", "leave", "return", "home_s", "home_lat", "home_lng"])
    size = int(pdf["_win1"].iloc[0] - pdf["_win0"].iloc[0]) // 1000 * 1000
    placed = pdf[pdf["place_id"].notna()]
    if int((pdf["_b"] - pdf["_a"]).sum()) / size <= MIN_SHARE or placed.empty:
        return none
    named = placed[placed["place_type"] == "Home"]
    if len(named):
        home_id = named["place_id"].iloc[-1]
    elif placed["place_id"].iloc[0] == placed["place_id"].iloc[-1]:
        home_id = placed["place_id"].iloc[0]
    else:
        return none
    at_home = ((pdf["place_id"] == home_id) | ((pdf["place_type"] == "Home") & pdf["place_id"].notna())).fillna(False).tolist()
    spot = placed[placed["place_id"] == home_id].iloc[0]
    front, back = _stay(at_home)
    leave = return_ = pd.NaT
    seconds = DAY_S
    if front and back:
        first, last = pdf.iloc[front - 1], pdf.iloc[len(pdf) - back]
        inside = [i for i in range(front, len(pdf) - back) if at_home[i]]
        seconds = int(first["_b"] - first["_win0"]) // 1000 + int(last["_win1"] - last["_a"]) // 1000 + sum(int(pdf["_b"][i] - pdf["_a"][i]) // 1000 for i in inside)
        leave, return_ = first["end"], last["start"]
    return _row(pdf, pdf["ts"].min(), leave, return_, seconds, spot["lat"], spot["lng"])


def segment_home_time(segments: DataFrame, *, include_open: bool = False) -> DataFrame:
    """Segments (start, end, place<id, type, lat, lng>) -> as ``home_time``; ``at`` is the day's first time.

    Segments must cover more than half of the day. Home is the last place typed
    Home, else the first place if it is the last one too. If the user was not
    seen to leave and to return, the day counts in full. Days without a place
    have no row.
    """
    held = with_window(segments, "day", first_zone=False)
    held = held if include_open else closed_only(held)
    held = held.select("user_key", "win_begin", "seq", "ts", "start", "end", F.col("place.id").alias("place_id"), F.col("place.type").alias("place_type"), F.col("place.lat").alias("lat"), F.col("place.lng").alias("lng"), ms("start").alias("_a"), ms("end").alias("_b"), *_day_ends())
    key = segments.schema["user_key"].dataType.simpleString()
    return held.groupBy("user_key", "win_begin").applyInPandas(_segment_day, f"user_key {key}, {_OUT}")
