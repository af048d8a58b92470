"""Correcting modes with a hidden Markov model."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.geo import np_distance
from strandline.functions.times import ms
from strandline.functions.values import STATES
from strandline.operators.ordering import drop_unknown

#: States STILL, RUN, WALK, DRIVE: start, emission (row: state, column: observed) and transition (row: from). Fixed values.
START = (0.25, 0.25, 0.25, 0.25)
EMIT = ((0.70, 0.005, 0.005, 0.29), (0.20, 0.50, 0.10, 0.20), (0.20, 0.10, 0.50, 0.20), (0.28, 0.01, 0.01, 0.70))
MOVE = ((0.70, 0.14, 0.15, 0.01), (0.10, 0.49, 0.40, 0.01), (0.10, 0.40, 0.49, 0.01), (0.09, 0.01, 0.20, 0.70))
MAX_GAP_S, MAX_STILL, MIN_BATCH = 180, 60, 20
DRIVE_KM, DRIVE_VERIFY_MS = 1.0, 600_000
#: Consecutive batches that one Arrow group holds, so that short ones do not cost a group each.
BATCHES_IN_GROUP = 32


def viterbi(observed: np.ndarray) -> np.ndarray:
    """The likeliest states of observed ones (0-3; CYCLING, 4, says nothing). Ties go to the lower state."""
    with np.errstate(divide="ignore"):
        start, move = np.log(START), np.log(MOVE)
        emit = np.log(np.hstack([np.array(EMIT), np.full((4, 1), 0.25)]))
    best, back = start + emit[:, observed[0]], []
    for o in observed[1:]:
        to = best[:, None] + move
        back.append(to.argmax(axis=0))
        best = to.max(axis=0) + emit[:, o]
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


def with_batches(df: DataFrame, *, max_gap_s: float = MAX_GAP_S, max_still: int = MAX_STILL) -> DataFrame:
    """Adds ``batch``: a new one after a gap of more than ``max_gap_s``, or at a STILL after ``max_still`` of them."""
    order = Window.partitionBy("user_key").orderBy("ts", "seq")
    gap = F.coalesce(ms("ts") - F.lag(ms("ts")).over(order) > max_gap_s * 1000, F.lit(False))
    still = F.col("mode") == "STILL"
    df = df.withColumn("_gap", gap).withColumn("_run", F.sum((F.col("_gap") | ~still).cast("int")).over(order))
    place = F.row_number().over(Window.partitionBy("user_key", "_run", still).orderBy("ts", "seq"))
    # The record that opens a run is either STILL after a gap, or no STILL at all.
    df = df.withColumn("_cut", F.col("_gap") | (still & (place > 1) & ((place - 1) % max_still == 0)))
    return df.withColumn("batch", F.sum(F.col("_cut").cast("int")).over(order)).drop("_gap", "_run", "_cut")


def corrected(modes: np.ndarray, t: np.ndarray, lat: np.ndarray, lng: np.ndarray, drive_verify_ms: int, drive_km: float) -> np.ndarray:
    """One batch in order; first false drives are taken back, then the path is decoded."""
    seen, modes = modes, modes.copy()
    located = ~np.isnan(lat) & ~np.isnan(lng)
    for i in np.flatnonzero(located & (seen == "DRIVE")):
        near = np.flatnonzero(located & (np.abs(t - t[i]) < drive_verify_ms))
        if np_distance(lat[i], lng[i], lat[near], lng[near], "km").max() < drive_km:
            modes[i] = "WALK" if "WALK" in seen[near] else "STILL"
    path = viterbi(np.array([STATES.index(m) for m in modes]))
    return np.array([STATES[s] for s in path], object)


def corrected_batches(pdf: pd.DataFrame, min_batch: int, drive_verify_ms: int, drive_km: float) -> pd.DataFrame:
    """Some batches of one user; those under ``min_batch`` records stay as they are."""
    pdf = pdf.sort_values(["batch", "_ms", "seq"])
    modes, t, batch = pdf["mode"].to_numpy(object), pdf["_ms"].to_numpy(), pdf["batch"].to_numpy()
    lat, lng = (pdf[c].to_numpy(float) for c in ("lat", "lng"))
    out, ends = modes.copy(), [*np.flatnonzero(np.diff(batch)) + 1, len(batch)]
    for a, b in zip([0, *ends], ends):
        if b - a >= min_batch:
            out[a:b] = corrected(modes[a:b], t[a:b], lat[a:b], lng[a:b], drive_verify_ms, drive_km)
    return pdf[["user_key", "seq", "ts", "tz", "lat", "lng", "accuracy", "mode"]].assign(rectified=out)


def rectify(df: DataFrame, *, max_gap_s: float = MAX_GAP_S, max_still: int = MAX_STILL, min_batch: int = MIN_BATCH, drive_verify_ms: int = DRIVE_VERIFY_MS, drive_km: float = DRIVE_KM, include_open: bool = False) -> DataFrame:
    """Records with ``rectified`` modes, decoded by batch; batches under ``min_batch`` records pass unchanged.

    UNKNOWN records are dropped. A located DRIVE that stays within ``drive_km``
    of all records within ``drive_verify_ms`` counts as WALK if one of them
    walks, else as STILL. Zone and accuracy go along, null where there are none. Each user's last batch is still open and has no rows.
    """
    held = with_batches(drop_unknown(df), max_gap_s=max_gap_s, max_still=max_still).withColumn("_ms", ms("ts"))
    if not include_open:
        held = held.withColumn("_last", F.max("batch").over(Window.partitionBy("user_key"))).filter("batch < _last")
    key = df.schema["user_key"].dataType.simpleString()
    for name, kind in (("tz", "string"), ("accuracy", "double")):
        held = held if name in held.columns else held.withColumn(name, F.lit(None).cast(kind))
    held = held.select("user_key", "batch", "seq", "ts", "_ms", "tz", "lat", "lng", "accuracy", "mode")
    schema = f"user_key {key}, seq long, ts timestamp, tz string, lat double, lng double, accuracy double, mode string, rectified string"
    groups = held.groupBy("user_key", F.expr(f"batch div {BATCHES_IN_GROUP}"))
    return groups.applyInPandas(lambda pdf: corrected_batches(pdf, min_batch, drive_verify_ms, drive_km), schema)
