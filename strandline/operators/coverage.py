"""Data coverage of windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.times import FIXED_MS, local, ms, window_begin, window_end
from strandline.operators.blocks import with_prior
from strandline.operators.windows import closed_only, with_window

MAX_GAP_MS = 420_000


def clamp(coverage: Column, *, strict: bool = False) -> Column:
    """At most 1; with ``strict`` a coverage over 1.1 is an error."""
    least = F.least(coverage, F.lit(1.0))
    return F.when(coverage > 1.1, F.raise_error(F.lit("coverage over 1.1")).cast("double")).otherwise(least) if strict else least


def mobility_coverage(df: DataFrame, unit: str = "hour", *, max_gap_ms: int = MAX_GAP_MS, include_open: bool = False, strict: bool = False, block_rows: int | None = None) -> DataFrame:
    """Share of each window covered by gaps under ``max_gap_ms`` to the record before.

    A gap counts wholly in its later record's window, even if it began before it. With
    ``block_rows``, users with more records are cut in blocks, so that none is sorted in one task.
    """
    if block_rows:
        df = with_prior(df, ms("ts"), ["ts", "seq"], ms("ts").cast("double"), greatest=False, block_rows=block_rows).withColumn("_gap", ms("ts") - F.col("_prior")).drop("_prior")
    else:
        df = df.withColumn("_gap", ms("ts") - F.lag(ms("ts")).over(Window.partitionBy("user_key").orderBy("ts", "seq")))
    held = with_window(df, unit, first_zone=False)
    out = held.groupBy("user_key", "win_begin", "win_end").agg(F.coalesce(F.sum(F.when(F.col("_gap") < max_gap_ms, F.col("_gap"))), F.lit(0)).alias("_ms"))
    out = out.withColumn("coverage", clamp(F.col("_ms") / (ms("win_end") - ms("win_begin")), strict=strict)).drop("_ms")
    return out if include_open else closed_only(out)


def segment_coverage(df: DataFrame, unit: str = "hour", *, include_open: bool = False, strict: bool = False) -> DataFrame:
    """Share of each window covered by ``[start, end]`` segments; an interval counts in every window it crosses.

    Past a window's last millisecond the interval goes on one millisecond later.
    Windows that nothing covers have no row.
    """
    # Windows are cut in wall-clock time, which is exact for units up to a day.
    a, b = local("start", "tz"), local("end", "tz")
    spans = df.select("user_key", a.alias("a"), b.alias("b")).filter(ms("a") <= ms("b"))
    if unit in FIXED_MS:
        size = FIXED_MS[unit]
        steps = F.sequence(F.floor(ms("a") / size), F.floor(ms("b") / size))
        cut = spans.withColumn("w", F.explode(steps)).withColumn("win_begin", F.timestamp_millis(F.col("w") * size)).drop("w")
    else:
        months = {"month": 1, "year": 12}[unit]
        steps = F.sequence(window_begin(F.col("a"), unit), window_begin(F.col("b"), unit), F.make_interval(months=F.lit(months)))
        cut = spans.withColumn("win_begin", F.explode(steps))
    cut = cut.withColumn("win_end", window_end(F.col("win_begin"), unit))
    held = F.least(ms("b"), ms("win_end")) - F.greatest(ms("a"), ms("win_begin"))
    out = cut.groupBy("user_key", "win_begin", "win_end").agg(F.sum(held).alias("_ms")).filter("_ms > 0")
    share = clamp(F.col("_ms") / (ms("win_end") - ms("win_begin")), strict=strict)
    out = out.select("user_key", "win_begin", "win_end", share.alias("coverage"))
    return out if include_open else closed_only(out)
