"""The table of addresses against going through all points in order."""

import math
import random
from datetime import datetime, timedelta

import pytest

from strandline.functions.geo import np_distance
from strandline.operators.addresses import cells_near, extend_addresses, new_addresses, with_addresses

SCHEMA = "user_key string, start timestamp, segment long, lat double, lng double"
T0 = datetime(2024, 1, 1)


def plain(rows, metres=30.0):
    """(start, user, segment, lat, lng) -> the position of each one's address."""
    seen, out = [], {}
    for user, start, segment, lat, lng in sorted(rows, key=lambda r: (r[1], r[0] is not None, r[0] or "", r[2])):
        near = [i for i, (a, b) in enumerate(seen) if np_distance(lat, lng, a, b) < metres]
        if not near:
            seen.append((lat, lng))
        out[user, start, segment] = seen[near[0] if near else -1]
    return out, len(seen)


def made_up(lat0, lng0, n=150, spread=0.0015, seed=1):
    rng = random.Random(seed)
    spots = [(lat0 + rng.uniform(-1, 1) * spread, lng0 + rng.uniform(-1, 1) * spread / math.cos(math.radians(lat0))) for _ in range(60)]
    # Half of the points are at one spot.
    at = lambda: spots[0] if rng.random() < 0.5 else rng.choice(spots)
    return [(rng.choice(["u", "v", None]), T0 + timedelta(seconds=rng.randrange(5000)), i, *at()) for i in range(n)]


@pytest.mark.parametrize("lat0, lng0", [(0.0, 0.0), (-40.7, 74.0), (69.9, -120.0)])
def test_against_going_through_in_order(spark, lat0, lng0):
    rows = made_up(lat0, lng0)
    df = spark.createDataFrame(rows, SCHEMA)
    table = new_addresses(df)
    positions = {r.place_id: (r.lat, r.lng) for r in table.collect()}
    want, n = plain(rows)
    assert len(positions) == n
    assert {(r.user_key, r.start, r.segment): positions[r.place_id] for r in with_addresses(df, table).collect()} == want


def test_two_runs_give_the_ids_of_one(spark, tmp_path):
    rows = made_up(52.5, 13.4, seed=7)
    rows.sort(key=lambda r: r[1])
    whole = extend_addresses(spark.createDataFrame(rows, SCHEMA), f"{tmp_path}/one")
    half = [extend_addresses(spark.createDataFrame(part, SCHEMA), f"{tmp_path}/two") for part in (rows[:75], rows[75:])]
    key = lambda df: sorted((r.segment, r.place_id) for r in df.collect())
    assert key(whole) == sorted(key(half[0]) + key(half[1]))
    again = extend_addresses(spark.createDataFrame(rows[75:], SCHEMA), f"{tmp_path}/two")
    assert key(again) == key(half[1])


def test_points_without_a_position_repeats_and_empty(spark):
    rows = [("u", T0, 1, 1.0, 1.0), ("u", T0, 1, 1.0, 1.0), ("v", T0, 2, None, 1.0), ("v", T0, 3, 1.0, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = with_addresses(df, new_addresses(df)).collect()
    assert sorted((r.segment, r.place_id is None) for r in found) == [(1, False), (1, False), (2, True), (3, True)]
    assert new_addresses(df.filter("false")).collect() == []


def test_cells_near_hold_all_that_is_near(spark):
    from pyspark.sql import functions as F

    from strandline.functions.geo import distance
    from strandline.operators.addresses import cell

    rng = random.Random(3)
    rows = []
    for _ in range(3000):
        lat, lng = rng.uniform(-85, 85), rng.uniform(-170, 170)
        rows.append((lat, lng, lat + rng.uniform(-1, 1) * 0.0003, lng + rng.uniform(-1, 1) * 0.0003 / math.cos(math.radians(lat))))
    df = spark.createDataFrame(rows, "lat double, lng double, y double, x double").filter(distance(F.col("lat"), F.col("lng"), F.col("y"), F.col("x")) < 30)
    near = F.array_contains(cells_near(F.col("lat"), F.col("lng"), 30), cell(F.col("y"), F.col("x"), 30))
    assert df.count() > 500 and df.filter(~near).count() == 0
    same = df.filter(cell(F.col("lat"), F.col("lng"), 30) == cell(F.col("y"), F.col("x"), 30))
    assert same.count() > 50
