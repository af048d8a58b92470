"""Calendar windows per user, closed by the user's own next record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.times import FIXED_MS, local, ms, window_begin, window_end

#: Slots of sampling in milliseconds.
SLOT_MS = 30_000
#: Windows of one user that go to Python together.
WINDOWS_IN_GROUP = 32


def with_window(df: DataFrame, unit: str = "day", *, n: int = 1, compat_epoch: bool = False, first_zone: bool = True) -> DataFrame:
    """Adds win_begin and win_end, in wall-clock time of the window's zone.

    A window's zone is that of its first record. Where a user's zone is one and
    the same that is the record's own; otherwise the records of the own zone's
    window take the zone of the earliest of them. Windows of more than one unit
    are not supported.
    """
    if n != 1:
        raise ValueError("a window is one unit long")
    tz = F.col("tz")
    begin = window_begin(local("ts", tz), unit, compat_epoch=compat_epoch, tz=tz)
    df = df.withColumn("win_begin", begin)
    if first_zone:
        first = F.min_by("tz", F.struct("ts", "seq")).over(Window.partitionBy("user_key", "win_begin"))
        df = df.withColumn("_tz", first)
        zoned = window_begin(local("ts", "_tz"), unit, compat_epoch=compat_epoch, tz=F.col("_tz"))
        df = df.withColumn("win_begin", zoned).drop("_tz")
    return df.withColumn("win_end", window_end(F.col("win_begin"), unit))


def closed_only(df: DataFrame, *, begin: str = "win_begin") -> DataFrame:
    """Drops each user's last window: no later record has closed it."""
    last = F.max(begin).over(Window.partitionBy("user_key"))
    return df.withColumn("_last", last).filter(F.col(begin) < F.col("_last")).drop("_last")


def last_windows(records: DataFrame, rows: DataFrame, *, begin: str = "win_begin") -> DataFrame:
    """Drops from ``rows`` each user's last window of ``records``.

    The last windows come from an aggregate, so the records are neither sorted nor shuffled.
    """
    last = records.groupBy(F.col("user_key").alias("_user")).agg(F.max(begin).alias("_last"))
    return rows.join(last, F.col("user_key").eqNullSafe(F.col("_user"))).filter(F.col(begin) < F.col("_last")).drop("_user", "_last")


def window_task(df: DataFrame, unit: str, *aggs: Column, include_open: bool = False, n: int = 1, first_zone: bool = False) -> DataFrame:
    """One row per user and window: user_key, win_begin, win_end and the aggregates. Empty windows have none.

    Each record is in the window of its own zone, or, with ``first_zone``, in
    that of the window's first record; this takes one more shuffle.
    """
    out = with_window(df, unit, n=n, first_zone=first_zone).groupBy("user_key", "win_begin", "win_end").agg(*aggs)
    return out if include_open else closed_only(out)


def windows_task(df: DataFrame, units: tuple[str, ...], *aggs: Column, include_open: bool = False) -> DataFrame:
    """``window_task`` for several units in one pass: user_key, unit, win_begin, win_end and the aggregates.

    What comes before is read and sorted once, not once for each unit, and no task holds all units side by side as one of a union does.
    """
    wall = local("ts", "tz")
    begins = F.array(*[F.struct(F.lit(i).alias("_unit"), window_begin(wall, u).alias("win_begin")) for i, u in enumerate(units)])
    rows = df.withColumn("_w", F.explode(begins)).withColumns({"_unit": F.col("_w._unit"), "win_begin": F.col("_w.win_begin")}).drop("_w")
    out = rows.groupBy("user_key", "_unit", "win_begin").agg(*aggs)
    if not include_open:
        last = F.max("win_begin").over(Window.partitionBy("user_key", "_unit"))
        out = out.withColumn("_last", last).filter("win_begin < _last").drop("_last")
    ends = F.coalesce(*[F.when(F.col("_unit") == i, window_end(F.col("win_begin"), u)) for i, u in enumerate(units)])
    unit = F.element_at(F.array(*[F.lit(u) for u in units]), F.col("_unit") + 1)
    values = [c for c in out.columns if c not in ("user_key", "_unit", "win_begin")]
    return out.select("user_key", unit.alias("unit"), "win_begin", ends.alias("win_end"), *values)


def window_apply(df: DataFrame, unit: str, fn: Callable, schema: str, *, include_open: bool = False) -> DataFrame:
    """``fn`` (pandas frame of a window -> pandas frame) over each user's windows; ``schema`` holds user_key and win_begin."""
    windows = with_window(df, unit)
    if not include_open:
        windows = closed_only(windows)
    return windows.groupBy("user_key", "win_begin").applyInPandas(fn, schema)


def some_windows(unit: str) -> Column:
    """A number alike for up to ``WINDOWS_IN_GROUP`` windows in a row, so that short ones do not cost an Arrow group each."""
    return F.floor(ms("win_begin") / (WINDOWS_IN_GROUP * FIXED_MS.get(unit, 31 * FIXED_MS["day"])))


def aligned_windows(df: DataFrame, unit: str, *aggs: Column, streams: int, stream: str = "stream", first_zone: bool = False) -> DataFrame:
    """As ``window_task`` over records of several streams: a window is closed once each of ``streams`` streams has a later record.

    Until a stream has one, the window stays open for its records. Users with
    fewer streams, and their windows still open, have no rows.
    """
    w = with_window(df, unit, first_zone=first_zone)
    ends = w.groupBy("user_key", stream).agg(F.max("win_begin").alias("reached"))
    ends = ends.groupBy("user_key").agg(F.min("reached").alias("reached"), F.count("*").alias("met")).filter(F.col("met") == streams)
    out = w.groupBy("user_key", "win_begin", "win_end").agg(*aggs)
    return out.join(ends, "user_key").filter("win_begin < reached").drop("reached", "met")


def window_stats(df: DataFrame, unit: str = "day", *, include_open: bool = False) -> DataFrame:
    """Per window: first and last time, records, sampling slots in use, median gap (s), share of missing slots."""
    w = with_window(df, unit, first_zone=False)
    gap = (ms("ts") - F.lag(ms("ts")).over(Window.partitionBy("user_key", "win_begin").orderBy("ts", "seq"))) / 1000
    w = w.withColumn("_gap", gap).withColumn("_wall", ms(local("ts", "tz")))
    slot = F.floor((F.col("_wall") - ms("win_begin")) / SLOT_MS)
    size = ms("win_end") - ms("win_begin") + 1
    out = w.groupBy("user_key", "win_begin", "win_end").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("records"), F.count_distinct(slot).alias("slots"), F.median("_gap").alias("median_gap_s"))
    out = out.withColumn("missing_rate", 1 - F.col("slots") / (size / SLOT_MS))
    return out if include_open else closed_only(out)
