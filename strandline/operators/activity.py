"""Activity: time by mode, episodes, distances and summaries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.geo import kalman, np_distance
from strandline.functions.times import ms
from strandline.functions.values import ACTIVE, MILES_PER_METRE, group_state, is_active
from strandline.operators.windows import closed_only, some_windows, window_task, with_window

MAX_GAP_S = 330
LINGER_MS = 120_000
MAX_MPH = 7.0
MIN_SPEED_S = 300


def active_count(df: DataFrame, unit: str = "day", *, include_open: bool = False) -> DataFrame:
    """Records with an active mode per window."""
    return window_task(df, unit, F.count_if(is_active("mode")).alias("active_count"), include_open=include_open)


def record_count(df: DataFrame, unit: str = "hour", *, include_open: bool = False) -> DataFrame:
    return window_task(df, unit, F.count("*").alias("records"), include_open=include_open)


def mode_time(df: DataFrame, unit: str = "day", *, max_gap_s: int = MAX_GAP_S, include_open: bool = False) -> DataFrame:
    """Seconds by mode per window: of a gap under ``max_gap_s`` whole seconds, half goes to each end's mode.

    active = WALK, RUN, CYCLING; sedentary = STILL, DRIVE; transport = DRIVE; total = active + sedentary.
    """
    w = with_window(df, unit, first_zone=False)
    prior = Window.partitionBy("user_key", "win_begin").orderBy("ts", "seq")
    gap = F.floor((ms("ts") - F.lag(ms("ts")).over(prior)) / 1000)
    w = w.withColumn("_gap", gap).withColumn("_mode", F.lag("mode").over(prior))
    half = F.when(F.col("_gap") < max_gap_s, F.col("_gap") / 2)

    def seconds(*modes: str):
        return F.coalesce(F.sum(F.when(F.col("mode").isin(*modes), half)), F.lit(0.0)) + F.coalesce(F.sum(F.when(F.col("_mode").isin(*modes), half)), F.lit(0.0))

    out = w.groupBy("user_key", "win_begin", "win_end").agg(F.min("ts").alias("first_ts"), seconds(*ACTIVE).alias("active_s"), seconds("STILL", "DRIVE").alias("sedentary_s"), seconds("DRIVE").alias("transport_s"), seconds(*ACTIVE, "STILL", "DRIVE").alias("total_s"))
    return out if include_open else closed_only(out)


def with_episodes(df: DataFrame, unit: str = "day", *, max_gap_s: int = MAX_GAP_S, linger_ms: int = LINGER_MS, include_open: bool = False) -> DataFrame:
    """The active records, each with its episode's number in its window.

    An episode ends where two records in a row are more than ``max_gap_s`` whole
    seconds apart, or a record without activity comes more than ``linger_ms`` after the
    last active one, and with the window.
    """
    w = with_window(df, unit, first_zone=False)
    w = w if include_open else closed_only(w)
    order = Window.partitionBy("user_key", "win_begin").orderBy("ts", "seq")
    active = is_active("mode")
    gap = ms("ts") - F.lag(ms("ts")).over(order)
    last = F.last(F.when(active, ms("ts")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = (F.floor(gap / 1000) > max_gap_s) | (~active & (ms("ts") - last > linger_ms))
    w = w.withColumn("_active", active).withColumn("_cut", F.sum(F.coalesce(ends, F.lit(False)).cast("int")).over(order))
    return w.filter("_active").withColumn("episode", F.dense_rank().over(order.orderBy("_cut"))).drop("_active", "_cut")


def episodes(df: DataFrame, unit: str = "day", **how) -> DataFrame:
    """One row per episode: start, end, its modes in order, records."""
    return with_episodes(df, unit, **how).groupBy("user_key", "win_begin", "episode").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.array_sort(F.collect_set("mode")).alias("types"), F.count("*").alias("records"))


def _walked(pdf: pd.DataFrame, max_mph: float) -> pd.DataFrame:
    """All episodes of some windows of one user."""
    pdf = pdf.sort_values(["win_begin", "episode", "_ms", "seq"])
    begin, number = pdf["win_begin"].to_numpy(), pdf["episode"].to_numpy()
    new = (begin[1:] != begin[:-1]) | (number[1:] != number[:-1])
    first = np.concatenate([[0], np.flatnonzero(new) + 1])
    ends = np.append(first[1:], len(pdf))
    t, lat, lng, acc = pdf["_ms"].to_numpy(np.int64), *(pdf[c].to_numpy(float) for c in ("lat", "lng", "accuracy"))
    fixed = ~np.isnan(lat) & ~np.isnan(lng) & (acc < 100)
    miles = []
    for a, b in zip(first, ends):
        at = np.flatnonzero(fixed[a:b]) + a
        if len(at) < 2:
            miles.append(0.0)
            continue
        y, x = kalman(lat[at], lng[at], acc[at], t[at])
        step = np_distance(y[:-1], x[:-1], y[1:], x[1:], "mile")
        with np.errstate(divide="ignore", invalid="ignore"):
            mph = step / (np.diff(t[at]) / 3_600_000)
        miles.append(float(step[mph < max_mph].sum()))
    out = pdf[["user_key", "win_begin", "episode"]].iloc[first]
    ts = pdf["ts"].to_numpy()
    return out.assign(start=ts[first], end=ts[ends - 1], duration_s=(t[ends - 1] - t[first]) // 1000, miles=miles)


def episode_distance(df: DataFrame, unit: str = "day", *, max_mph: float = MAX_MPH, **how) -> DataFrame:
    """Per episode: whole seconds, and miles along the Kalman-smoothed fixes of under 100 m, fast steps left out."""
    key = df.schema["user_key"].dataType.simpleString()
    held = with_episodes(df, unit, **how).withColumn("_ms", ms("ts")).select("user_key", "win_begin", "episode", "seq", "ts", "_ms", "lat", "lng", "accuracy")
    return held.groupBy("user_key", some_windows(unit)).applyInPandas(lambda pdf: _walked(pdf, max_mph), f"user_key {key}, win_begin timestamp, episode int, start timestamp, end timestamp, duration_s long, miles double")


def summarise(episodes_: DataFrame, *, min_s: int = MIN_SPEED_S) -> DataFrame:
    """Per window, from episodes(duration_s, miles, steps): miles, steps (-1 if none is known), fastest mph (-1 if none is long)."""
    known = F.col("steps") >= 0
    mph = F.when(F.col("duration_s") > min_s, F.col("miles") / (F.col("duration_s") / 3600))
    return episodes_.groupBy("user_key", "win_begin").agg(F.sum("miles").alias("miles"), F.coalesce(F.sum(F.when(known, F.col("steps"))), F.lit(-1)).alias("steps"), F.coalesce(F.max(mph), F.lit(-1.0)).alias("max_mph"))


def daily_summary(df: DataFrame, unit: str = "day", *, min_s: int = MIN_SPEED_S, include_open: bool = False, **how) -> DataFrame:
    """``mode_time`` of each window beside the miles, fastest mph and number of its episodes (0, -1 and 0 without any).

    The records bring no steps, so these are -1.
    """
    walked = episode_distance(df, unit, include_open=include_open, **how).withColumn("steps", F.lit(-1))
    count = walked.groupBy("user_key", "win_begin").agg(F.count("*").alias("episodes"))
    whole = summarise(walked, min_s=min_s).join(count, ["user_key", "win_begin"])
    out = mode_time(df, unit, include_open=include_open).join(whole, ["user_key", "win_begin"], "left")
    return out.fillna({"miles": 0.0, "steps": -1, "max_mph": -1.0, "episodes": 0})


def segment_summary(df: DataFrame, unit: str = "day", *, include_open: bool = False) -> DataFrame:
    """Per window of segments(start, end, activities): seconds by kind, miles and steps of the active ones, episodes."""
    state = F.transform("activities", lambda a: F.struct(group_state(a["group"]).alias("state"), a["duration"].alias("s"), a["distance"].alias("m"), a["steps"].alias("steps"), a["start"].alias("start"), a["end"].alias("end")))
    held = with_window(df.withColumn("_a", F.coalesce(state, F.array().cast("array<struct<state:string,s:double,m:double,steps:int,start:timestamp,end:timestamp>>"))), unit, first_zone=False)
    walked = F.filter("_a", lambda a: a["state"].isin(*ACTIVE))
    add = lambda column, of: F.aggregate(column, F.lit(0.0), lambda s, a: s + F.coalesce(of(a), F.lit(0.0)))
    steps = F.filter(walked, lambda a: a["steps"] >= 0)
    rows = held.select("user_key", "win_begin", "win_end", "ts", F.floor((ms("end") - ms("start")) / 1000).alias("total"), add(walked, lambda a: a["s"]).alias("active"), add(F.filter("_a", lambda a: a["state"] == "DRIVE"), lambda a: a["s"]).alias("drive"), add(walked, lambda a: a["m"] * MILES_PER_METRE).alias("miles"), F.when(F.size(steps) > 0, F.aggregate(steps, F.lit(0).cast("long"), lambda s, a: s + a["steps"])).alias("steps"), F.size(walked).alias("n"))
    out = rows.groupBy("user_key", "win_begin", "win_end").agg(F.min("ts").alias("first_ts"), F.sum("total").cast("double").alias("total_s"), F.sum("active").alias("active_s"), (F.sum("total") - F.sum("active")).alias("sedentary_s"), F.sum("drive").alias("transport_s"), F.sum("miles").alias("miles"), F.coalesce(F.sum("steps"), F.lit(-1)).alias("steps"), F.sum("n").alias("episodes"))
    return out if include_open else closed_only(out)
