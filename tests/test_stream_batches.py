"""Corrected modes and places over streams against the batch operators, over restarts."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions.values import STATES
from strandline.operators import hmm, ordering, places
from strandline.sources.records import mobility
from strandline.streaming.batches import CHUNK_ROWS, Batches, Decoder, stream_places, stream_rectify
from strandline.streaming.stateful import read_stream, run_to_target

SF = "/root/testdata/sf0.01"


def streamed(spark, tmp_path, schema, make, parts):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
        out = make(read_stream(spark, f"{tmp_path}/in/*", schema, max_files=1))
        keyed = out if "ts" in out.columns else out.withColumn("ts", F.col("start")).withColumn("seq", F.col("part"))
        run_to_target(keyed, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    return spark.read.parquet(f"{tmp_path}/out").select(*out.columns)


def same(got, want, digits=9):
    key = lambda r: tuple((x is not None, x) for x in r)
    rows = lambda df: sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.select(*want.columns).collect()), key=key)
    assert rows(got) == rows(want) and want.count() > 3


def table(spark, high=4000):
    return mobility(spark, SF).filter(F.col("seq") < high).select("user_key", "seq", "ts", "tz", "mode", "lat", "lng", "accuracy")


def parts_of(df, size):
    """Files in order of arrival, each with some records of its predecessor again."""
    return [df.filter((F.col("seq") >= i * size - 30) & (F.col("seq") < (i + 1) * size)) for i in range(2)]


@pytest.mark.parametrize("how", [dict(max_gap_s=1800), dict(max_gap_s=7200, drive_verify_ms=5_000_000, drive_km=0.8, max_still=3, min_batch=5)])
def test_rectified_modes(spark, tmp_path, how):
    df = table(spark)
    got = streamed(spark, tmp_path, df.schema, lambda s: stream_rectify(s, **how), parts_of(df, 2010))
    same(got, hmm.rectify(ordering.monotonic_gate(df), **how))


@pytest.mark.parametrize("how", [dict(ahead_ms=3_600_000, max_gap_ms=7_200_000), dict(ahead_ms=1_200_000, max_gap_ms=90_000_000, by_day=False), dict(ahead_ms=3_600_000, max_gap_ms=7_200_000, long_split=False)])
def test_places(spark, tmp_path, how):
    df = table(spark)
    # Fewer places, so that segments get long.
    df = df.withColumn("lat", F.when(F.col("lat").isNotNull(), 40.0 + F.floor(F.col("seq") / 400) * 0.1))
    got = streamed(spark, tmp_path, df.schema, lambda s: stream_places(s, **how), parts_of(df, 2010))
    want = places.place_segments(ordering.monotonic_gate(df), **how)
    same(got, want)
    assert not how.get("long_split", True) or want.filter("part > 1").count() > 0


def test_places_by_the_time_of_locations(spark, tmp_path):
    df = table(spark, 2000).withColumn("loc_ts", F.timestamp_millis(F.unix_millis("ts") - F.col("seq") % 7 * 600_000))
    how = dict(ahead_ms=3_600_000, max_gap_ms=7_200_000)
    got = streamed(spark, tmp_path, df.schema, lambda s: stream_places(s, **how), parts_of(df, 1010))
    same(got, places.place_segments(ordering.monotonic_gate(df), **how))


def test_the_column_carried_on_decodes_as_a_whole():
    rng = random.Random(0)
    for n in (1, 2, 30, 500):
        seen = [rng.choice(STATES[:5]) for _ in range(n)]
        decoder, backs = Decoder(), bytearray()
        for i, m in enumerate(seen):
            if i % 7 == 0 and decoder.column is not None:
                decoder = Decoder(decoder.column.tolist())
            backs.append(decoder.step(m))
        want = hmm.viterbi(np.array([STATES.index(m) for m in seen]))
        assert decoder.path(bytes(backs)) == [STATES[s] for s in want]


class Held:
    """A value or a list in state, which counts how often it is asked for."""

    def __init__(self):
        self.value, self.asked = None, 0

    def exists(self):
        return self.value is not None

    def get(self):
        self.asked += 1
        return self.value or ()

    def update(self, value):
        self.value = value

    def appendList(self, rows):
        self.value = [*(self.value or ()), *rows]

    def appendValue(self, row):
        self.appendList([row])

    def clear(self):
        self.asked, self.value = self.asked + 1, None


class Handle:
    def __init__(self):
        self.states = {}

    def state(self, name, _):
        return self.states.setdefault(name, Held())

    getValueState = getListState = state


def test_short_batches_go_out_together():
    """Frames and calls for state follow the rows, not the number of batches."""
    rng, n = random.Random(1), 3 * CHUNK_ROWS
    modes = [rng.choice(("STILL", "WALK", "DRIVE", "CYCLING", "RUN", "UNKNOWN", None)) for _ in range(n)]
    # A gap ends a batch each 30 records.
    pdf = pd.DataFrame({"seq": range(n), "ms": [i * 1000 + i // 30 * 10**6 for i in range(n)], "tz": "+00:00", "lat": [i % 3 * 1.0 for i in range(n)], "lng": 0.0, "accuracy": np.nan, "mode": modes})
    of, handle = Batches(300_000, 60, 20, 600_000, 1.0), Handle()
    of.init(handle)
    frames = [f for a, b in ((0, n // 2), (n // 2, n)) for f in of.handleInputRows(("u",), iter([pdf[a:b]]), None)]
    got = pd.concat(frames)
    left = handle.states["rows"].value
    assert len(got) + len(left) == sum(m not in ("UNKNOWN", None) for m in modes) and len(left) <= 30
    assert len(frames) <= 5 and handle.states["rows"].asked + handle.states["backs"].asked <= 4
    t = pdf[pdf["mode"].notna() & (pdf["mode"] != "UNKNOWN")].assign(batch=lambda x: x["seq"] // 30, _ms=lambda x: x["ms"], user_key="u", ts=0)
    want = hmm.corrected_batches(t, 20, 600_000, 1.0).set_index("seq")["rectified"]
    assert got["rectified"].tolist() == want.loc[got["seq"]].tolist()
