"""The widest distance of a day."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.geo import hull, np_distance, widest_pair
from strandline.functions.times import ms
from strandline.operators.ordering import accurate
from strandline.operators.windows import last_windows, some_windows, with_window


def _windows(pdf: pd.DataFrame) -> Iterator[np.ndarray]:
    """Row numbers of each window of each user, in the order of time."""
    group = pdf.groupby(["user_key", "win_begin"], dropna=False, sort=False).ngroup().to_numpy()
    order = np.lexsort((pdf["seq"].to_numpy(), pdf["_ms"].to_numpy(), group))
    yield from np.split(order, np.flatnonzero(np.diff(group[order])) + 1)


def _corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each window in a batch of records, the corners of its convex hull, with the time of its first record."""
    for pdf in batches:
        if not len(pdf):
            continue
        lat, lng, t = (pdf[c].to_numpy() for c in ("lat", "lng", "_ms"))
        first, kept = t.copy(), []
        for at in _windows(pdf):
            corners = at[np.sort(hull(lat[at], lng[at]))]
            first[corners] = t[at[0]]
            kept.append(corners)
        yield pdf.assign(_first=first).iloc[np.concatenate(kept)]


def _apart(lat: np.ndarray, lng: np.ndarray, metres: float) -> np.ndarray:
    """The points that are ``metres`` or more from all points before them that stay."""
    kept: list[int] = []
    for i in range(len(lat)):
        if not kept or np_distance(lat[i], lng[i], lat[kept], lng[kept]).min() >= metres:
            kept.append(i)
    return np.array(kept)


def geodiameter(df: DataFrame, unit: str = "day", *, max_accuracy: float = 100, drop_every: int | None = None, tolerance_m: float = 0, include_open: bool = False) -> DataFrame:
    """Per user and window: the greatest distance in miles between two located, accurate records, and both.

    Hulls merge: the hull of parts is the hull of their corners. So each task reduces the records that it reads to
    corners, and only corners are shuffled; a window of any number of records takes as many tasks as hold it.
    ``earlier`` is the earlier of the two. Windows of fewer than two different places have no row.
    With ``tolerance_m``, corners nearer than that to an earlier one are left out, so the distance
    may fall short by twice as much. ``drop_every=11`` leaves out each eleventh accurate record of a window,
    as a buffer of ten that discards the record that finds it full; this takes the window's records in order.
    """
    windows = with_window(df, unit, first_zone=False)
    key = df.schema["user_key"].dataType.simpleString()
    held = accurate(windows, max_accuracy).select("user_key", "win_begin", F.col("seq").cast("long").alias("seq"), ms("ts").alias("_ms"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    if drop_every:
        place = F.row_number().over(Window.partitionBy("user_key", "win_begin").orderBy("_ms", "seq"))
        held = held.withColumn("_n", place).filter(F.col("_n") % drop_every != 0).drop("_n")
    kind = held.schema["win_begin"].dataType.simpleString()
    corners = held.mapInPandas(_corners, f"user_key {key}, win_begin {kind}, seq long, _ms long, lat double, lng double, _first long")

    def widest(pdf: pd.DataFrame) -> pd.DataFrame:
        """Some windows of one user."""
        lat, lng, seq, first, begin = (pdf[c].to_numpy() for c in ("lat", "lng", "seq", "_first", "win_begin"))
        rows = []
        for at in _windows(pdf):
            start, window = first[at].min(), begin[at[0]]
            if tolerance_m:
                at = at[_apart(lat[at], lng[at], tolerance_m)]
            if ((lat[at] == lat[at[0]]) & (lng[at] == lng[at[0]])).all():
                continue
            miles, i, j = widest_pair(lat[at], lng[at])
            rows.append((window, int(start), miles, int(seq[at[i]]), int(seq[at[j]])))
        out = pd.DataFrame(rows, columns=["win_begin", "first_ms", "miles", "earlier_seq", "later_seq"])
        return out.assign(user_key=pdf["user_key"].iloc[:1].repeat(len(out)).to_numpy())[["user_key", *out.columns]]

    schema = f"user_key {key}, win_begin {kind}, first_ms long, miles double, earlier_seq long, later_seq long"
    out = corners.groupBy("user_key", some_windows(unit)).applyInPandas(widest, schema)
    out = out.select("user_key", "win_begin", F.timestamp_millis("first_ms").alias("first_ts"), "miles", "earlier_seq", "later_seq")
    # Any record closes a window, located or not.
    return out if include_open else last_windows(windows, out)
