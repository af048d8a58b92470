"""Geography: distances, hulls, and a Kalman filter for positions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean earth radius, and metres in a mile; fixed values.
EARTH_KM = 6371.009
METRES_PER_MILE = 1609.344
UNITS = {"km": EARTH_KM, "m": EARTH_KM * 1000, "mile": EARTH_KM * 1000 / METRES_PER_MILE}
#: Kalman: metres a second by which a position may drift, and the least accuracy in metres.
DRIFT_M_S, LEAST_ACCURACY = 4.0, 1.0


def distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column, unit: str = "m") -> Column:
    """Great-circle distance (haversine)."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * UNITS[unit]) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def np_distance(lat1, lng1, lat2, lng2, unit: str = "m"):
    p1, p2 = np.radians(lat1), np.radians(lat2)
    h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(np.radians(np.subtract(lng2, lng1)) / 2) ** 2
    return 2 * UNITS[unit] * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def hull(lat: np.ndarray, lng: np.ndarray) -> np.ndarray:
    """Indices of the convex hull (monotone chain on a local plane), each different point once."""
    x, y = lng * np.cos(np.radians(np.mean(lat))), lat
    points, first = np.unique(np.column_stack([x, y]), axis=0, return_index=True)
    if len(points) < 3:
        return first

    def chain(order: range) -> list[int]:
        kept: list[int] = []
        for i in order:
            while len(kept) > 1:
                (ax, ay), (bx, by), (cx, cy) = points[kept[-2]], points[kept[-1]], points[i]
                if (bx - ax) * (cy - ay) - (by - ay) * (cx - ax) > 0:
                    break
                kept.pop()
            kept.append(i)
        return kept

    lower, upper = chain(range(len(points))), chain(range(len(points) - 1, -1, -1))
    return first[sorted({*lower, *upper})]


def widest_pair(lat: np.ndarray, lng: np.ndarray) -> tuple[float, int, int]:
    """Greatest distance in miles between any two points, and the two indices; needs two different points."""
    corners = np.sort(hull(lat, lng))
    best = (-1.0, -1, -1)
    for n, i in enumerate(corners[:-1]):
        d = np_distance(lat[i], lng[i], lat[corners[n + 1 :]], lng[corners[n + 1 :]], "mile")
        j = int(np.argmax(d))
        best = max(best, (float(d[j]), int(i), int(corners[n + 1 + j])))
    return best


def kalman(lat: np.ndarray, lng: np.ndarray, accuracy: np.ndarray, ms: np.ndarray, drift: float = DRIFT_M_S) -> tuple[np.ndarray, np.ndarray]:
    """Positions smoothed by a constant-position Kalman filter.

    The variance grows by drift^2 per second between fixes and shrinks by the
    gain var / (var + accuracy^2) at each; it is held in single precision.
    """
    acc2 = (np.maximum(np.where(np.isnan(accuracy), LEAST_ACCURACY, accuracy), LEAST_ACCURACY) ** 2).tolist()
    grown = (np.maximum(0, np.diff(ms)) * drift * drift / 1000).tolist()
    single = np.float32
    y, x, var = float(lat[0]), float(lng[0]), single(acc2[0])
    ys, xs = [y], [x]
    for a2, more, a, b in zip(acc2[1:], grown, lat[1:].tolist(), lng[1:].tolist()):
        var = single(float(var) + more)
        gain = float(var) / (float(var) + a2)
        y, x = y + gain * (a - y), x + gain * (b - x)
        var = single(1 - gain) * var
        ys.append(y)
        xs.append(x)
    return np.array(ys), np.array(xs)
