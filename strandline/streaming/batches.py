"""Modes corrected batch by batch, and places and trips, over a stream.

Both keep in state what is not settled yet and put out what is. The corrected modes of a
batch are known once its boundary arrives; until then its records and, a byte a record, the ways back
through the model lie in lists, and the model's forward column is carried on, so a
micro-batch costs what it brings, however long the batch. A place's record waits
until one beyond its look-ahead has come; then it joins the open segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandline.functions.geo import np_distance
from strandline.functions.times import ms
from strandline.functions.values import ACTIVE, STATES
from strandline.operators import hmm, places
from strandline.operators.segments import split_by_day
from strandline.streaming.stateful import use_rocksdb
from strandline.streaming.windows import in_time, later_only

ROW = ["seq", "ms", "tz", "lat", "lng", "accuracy", "mode"]
#: Rows that go out together when batches end, short ones or parts of a long one.
CHUNK_ROWS = 8192


class Decoder:
    """Viterbi's forward column, carried on; a step's ways back are a byte, two bits for each state.

    For four states plain numbers take a third of the time of arrays; sums and ties are the same.
    """

    with np.errstate(divide="ignore"):
        START = np.log(hmm.START).tolist()
        #: To each state, from all; and what each observed state says of all.
        TO = np.log(hmm.MOVE).T.tolist()
        EMIT = dict(zip(STATES, np.log(np.hstack([np.array(hmm.EMIT), np.full((4, 1), 0.25)])).T.tolist()))

    def __init__(self, column: list[float] | None = None) -> None:
        self.at = list(column) if column else None

    @property
    def column(self) -> np.ndarray | None:
        return None if self.at is None else np.array(self.at)

    def step(self, mode: str) -> int:
        emit = self.EMIT[mode]
        if self.at is None:
            self.at = [s + e for s, e in zip(self.START, emit)]
            return 0
        a, b, c, d = self.at
        column, back = [], 0
        for state, (from_a, from_b, from_c, from_d) in enumerate(self.TO):
            best, way = a + from_a, 0
            if (x := b + from_b) > best:
                best, way = x, 1
            if (x := c + from_c) > best:
                best, way = x, 2
            if (x := d + from_d) > best:
                best, way = x, 3
            column.append(best + emit[state])
            back |= way << 2 * state
        self.at = column
        return back

    def path(self, backs: bytes) -> list[str]:
        at = int(self.column.argmax())
        states = bytearray(len(backs))
        for i in range(len(backs) - 1, -1, -1):
            states[i] = at
            at = backs[i] >> (2 * at) & 3
        return [STATES[s] for s in states]


class Batches(StatefulProcessor):
    """Gate, batches and their corrected modes for one user."""

    def __init__(self, max_gap_ms: float, max_still: int, min_batch: int, verify_ms: int, drive_km: float) -> None:
        self.max_gap_ms, self.max_still, self.min_batch, self.verify_ms, self.drive_km = max_gap_ms, max_still, min_batch, verify_ms, drive_km

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "seen long, last long, still int, n long, column array<double>")
        #: Records that a drive not judged yet may be near to, and how many of them are judged.
        self.near = handle.getValueState("near", "judged int, ms array<long>, lat array<double>, lng array<double>, mode array<string>")
        self.rows = handle.getListState("rows", "seq long, ms long, tz string, lat double, lng double, accuracy double, mode string")
        self.backs = handle.getListState("backs", "steps binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = in_time(rows)
        if pdf is None:
            return
        seen, last, still, n, column = self.open.get() if self.open.exists() else (None, None, 0, 0, None)
        judged, *near = self.near.get() if self.near.exists() else (0, [], [], [], [])
        near = [list(x) for x in near]
        pdf = pdf[later_only(pdf["ms"].to_numpy(), seen)]
        if not len(pdf):
            return
        seen = int(pdf["ms"].iloc[-1])
        # Whether records of the open batch are in the lists; only then are these asked for.
        stored, done = n > 0, []
        decoder, held, backs = Decoder(column), [], bytearray()
        for row in pdf[ROW].astype(object).where(pdf[ROW].notna(), None).itertuples(index=False, name=None):
            t, mode = row[1], row[6]
            if mode is None or mode == "UNKNOWN":
                continue
            if n and (t - last > self.max_gap_ms or (mode == "STILL" and still >= self.max_still)):
                if n >= self.min_batch:
                    self._judge(near, judged, None, decoder, backs)
                for closed in self._closed(n, stored, held, decoder, backs):
                    done.append(closed)
                    if len(done) >= CHUNK_ROWS:
                        yield self._frame(key[0], done)
                        done = []
                stored, decoder, held, backs, judged, near, n, still = False, Decoder(), [], bytearray(), 0, [[], [], [], []], 0, 0
            held.append(row)
            for x, v in zip(near, (t, row[3], row[4], mode)):
                x.append(v)
            last, n, still = t, n + 1, still + 1 if mode == "STILL" else 0
        if n:
            judged = self._judge(near, judged, last, decoder, backs)
        if done:
            yield self._frame(key[0], done)
        self.open.update((seen, last, still, n, None if decoder.column is None else decoder.column.tolist()))
        self.near.update((judged, *near))
        if held:
            self.rows.appendList(held)
        if backs:
            self.backs.appendValue((bytes(backs),))

    def _judge(self, near: list[list], judged: int, now: int | None, decoder: Decoder, backs: bytearray) -> int:
        """Steps of the model for records whose span is complete, all of them if ``now`` is None; forgets what no later one is near to."""
        t, modes = np.array(near[0], np.int64), near[3]
        lat, lng = (np.array([np.nan if v is None else v for v in x], float) for x in near[1:3])
        located = ~np.isnan(lat) & ~np.isnan(lng)
        until = len(t) if now is None else int(np.searchsorted(t, now - self.verify_ms, side="right"))
        for i in range(judged, max(judged, until)):
            mode = modes[i]
            if mode == "DRIVE" and located[i]:
                a, b = np.searchsorted(t, t[i] - self.verify_ms, side="right"), np.searchsorted(t, t[i] + self.verify_ms, side="left")
                at = np.flatnonzero(located[a:b]) + a
                if np_distance(lat[i], lng[i], lat[at], lng[at], "km").max() < self.drive_km:
                    mode = "WALK" if any(modes[k] == "WALK" for k in at) else "STILL"
            backs.append(decoder.step(mode))
        judged = max(judged, until)
        # The next to be judged, or any later record, is near to what is within the span before it.
        gone = int(np.searchsorted(t, t[min(judged, len(t) - 1)] - self.verify_ms, side="right"))
        for x in near:
            del x[:gone]
        return judged - gone

    def _closed(self, n: int, stored: bool, held: list[tuple], decoder: Decoder, backs: bytearray) -> Iterator[tuple]:
        """The rows of a batch that has ended, with their corrected modes; the lists are empty then."""
        if n >= self.min_batch:
            before = b"".join(bytes(x[0]) for x in self.backs.get()) if stored else b""
            path = iter(decoder.path(before + bytes(backs)))
        else:
            path = None
        for source in (self.rows.get() if stored else (), held):
            for row in source:
                yield (*row, row[6] if path is None else next(path))
        if stored:
            self.rows.clear()
            self.backs.clear()

    def _frame(self, user: Any, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*ROW, "rectified"]).assign(user_key=user)[["user_key", *ROW, "rectified"]]

    def close(self) -> None:
        pass


def stream_rectify(df: DataFrame, *, max_gap_s: float = hmm.MAX_GAP_S, max_still: int = hmm.MAX_STILL, min_batch: int = hmm.MIN_BATCH, drive_verify_ms: int = hmm.DRIVE_VERIFY_MS, drive_km: float = hmm.DRIVE_KM) -> DataFrame:
    """``rectify`` of gated records over a stream; a batch's rows come out when the next one begins."""
    use_rocksdb(df.sparkSession)
    for name, kind in (("tz", "string"), ("accuracy", "double")):
        df = df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))
    keyed = df.select("user_key", F.col("seq").cast("long").alias("seq"), ms("ts").alias("ms"), "tz", *[F.col(c).cast("double").alias(c) for c in ("lat", "lng", "accuracy")], "mode")
    key = df.schema["user_key"].dataType.simpleString()
    schema = f"user_key {key}, seq long, ms long, tz string, lat double, lng double, accuracy double, mode string, rectified string"
    out = keyed.groupBy("user_key").transformWithStateInPandas(Batches(max_gap_s * 1000, max_still, min_batch, drive_verify_ms, drive_km), schema, outputMode="Append", timeMode="None")
    return out.select("user_key", "seq", F.timestamp_millis("ms").alias("ts"), "tz", "lat", "lng", "accuracy", "mode", "rectified")


SEGMENT = "segment int, part int, state string, start_ms long, end_ms long, points long, lat double, lng double, from_lat double, from_lng double, to_lat double, to_lng double, tz string"


class Places(StatefulProcessor):
    """Gate, look-ahead, states and segments of one user."""

    def __init__(self, ahead_ms: int, max_gap_ms: int, long_split: bool) -> None:
        self.ahead_ms, self.max_gap_ms, self.long_split = ahead_ms, max_gap_ms, long_split

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "seen long, located long, state string, segment int, part int, n long, first long, last long")
        self.ahead = handle.getValueState("ahead", "ms array<long>, lat array<double>, lng array<double>, mode array<string>, tz array<string>")
        self.points = handle.getListState("points", "ms long, lat double, lng double, tz string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = in_time(rows)
        if pdf is None:
            return
        seen, located, *rest = self.open.get() if self.open.exists() else (None, None, "Place", 0, 0, 0, None, None)
        ahead = [list(x) for x in self.ahead.get()] if self.ahead.exists() else [[], [], [], [], []]
        pdf = pdf[later_only(pdf["ms"].to_numpy(), seen)]
        if not len(pdf):
            return
        seen = int(pdf["ms"].iloc[-1])
        pdf = pdf[pdf["lat"].notna() & pdf["lng"].notna()]
        if len(pdf):
            # Of locations, equal times stay.
            at = pdf["at_ms"].to_numpy()
            pdf = pdf[at >= np.maximum.accumulate(at if located is None else np.maximum(at, located))]
        new: list[tuple] = []
        if len(pdf):
            located = int(pdf["at_ms"].iloc[-1])
            for x, c in zip(ahead, ("at_ms", "lat", "lng", "mode", "tz")):
                x += pdf[c].tolist()
            new = self._settled(ahead)
        out: list[tuple] = []
        segment = _Segment(self, *rest)
        for t, lat, lng, tz, own in new:
            out += segment.add(t, lat, lng, tz, own)
        segment.save()
        self.open.update((seen, located, *segment.fields()))
        self.ahead.update(tuple(ahead))
        if out:
            yield pd.DataFrame([(key[0], *r) for r in out], columns=["user_key", *[f.split()[0] for f in SEGMENT.split(", ")]])

    def _settled(self, ahead: list[list]) -> list[tuple]:
        """Takes the records that one beyond their look-ahead has come for; each with its own state, or None."""
        t, lat, lng = np.array(ahead[0], np.int64), np.array(ahead[1], float), np.array(ahead[2], float)
        done, out = int(np.searchsorted(t, t[-1] - self.ahead_ms, side="left")), []
        for i in range(done):
            b = int(np.searchsorted(t, t[i] + self.ahead_ms, side="right"))
            own, near_lat, near_lng = None, lat[i + 1 : b], lng[i + 1 : b]
            if len(near_lat):
                same = (np.abs(near_lat - lat[i]) <= places.SAME_DEGREES) & (np.abs(near_lng - lng[i]) <= places.SAME_DEGREES)
                m = float(np.where(same, 0.0, np_distance(lat[i], lng[i], near_lat, near_lng)).max())
                if m > places.FAR_M or (m > places.ACTIVE_M and ahead[3][i] in ACTIVE):
                    own = "Moves"
                elif m < places.NEAR_M:
                    own = "Place"
            out.append((int(t[i]), float(lat[i]), float(lng[i]), ahead[4][i], own))
        for x in ahead:
            del x[:done]
        return out

    def close(self) -> None:
        pass


class _Segment:
    """The open segment: its points are in the processor's list and, since this micro-batch began, in ``held``."""

    def __init__(self, processor: Places, state: str, segment: int, part: int, n: int, first: int | None, last: int | None) -> None:
        self.of, self.state, self.segment, self.part, self.n, self.first, self.last = processor, state, segment, part, n, first, last
        self.held: list[tuple] = []

    def fields(self) -> tuple:
        return self.state, self.segment, self.part, self.n, self.first, self.last

    def add(self, t: int, lat: float, lng: float, tz: str, own: str | None) -> list[tuple]:
        """The record joins the segment, or begins the next one, which gives the row of what ended."""
        state, out = own or self.state, []
        if self.n:
            if state != self.state or t - self.last > self.of.max_gap_ms:
                out = self._row(self._take())
                self.segment, self.part, self.n = self.segment + 1, 0, 0
            elif self.of.long_split and (self.last - self.first) // 3_600_000 > places.LONG_HOURS and self.n > places.LONG_POINTS:
                points = self._take()
                out = self._row(points[: -places.HELD_POINTS])
                self.held = points[-places.HELD_POINTS :]
                self.part, self.n, self.first = self.part + 1, len(self.held), self.held[0][0]
        self.first = t if not self.n else self.first
        self.held.append((t, lat, lng, tz))
        self.state, self.n, self.last = state, self.n + 1, t
        return out

    def _take(self) -> list[tuple]:
        points = [tuple(p) for p in self.of.points.get()] + self.held
        self.of.points.clear()
        self.held = []
        return points

    def save(self) -> None:
        if self.held:
            self.of.points.appendList(self.held)

    def _row(self, points: list[tuple]) -> list[tuple]:
        (start, *begin, tz), (end, *stop, _) = points[0], points[-1]
        if start >= end:
            return []
        middle = (float(np.median([p[1] for p in points])), float(np.median([p[2] for p in points])))
        at, ends = (middle, (None,) * 4) if self.state == "Place" else ((None, None), (*begin, *stop))
        return [(self.segment, self.part, self.state, start, end, len(points), *at, *ends, tz)]


def stream_places(df: DataFrame, *, ahead_ms: int = places.AHEAD_MS, max_gap_ms: int = places.MAX_GAP_MS, long_split: bool = True, by_day: bool = True) -> DataFrame:
    """``place_segments`` of gated records over a stream; a segment comes out when the record that ends it is settled."""
    use_rocksdb(df.sparkSession)
    at = ms("loc_ts") if "loc_ts" in df.columns else ms("ts")
    keyed = df.select("user_key", F.col("seq").cast("long").alias("seq"), ms("ts").alias("ms"), at.alias("at_ms"), "tz", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), "mode")
    schema = f"user_key {df.schema['user_key'].dataType.simpleString()}, {SEGMENT}"
    rows = keyed.groupBy("user_key").transformWithStateInPandas(Places(ahead_ms, max_gap_ms, long_split), schema, outputMode="Append", timeMode="None")
    rows = rows.withColumn("start", F.timestamp_millis("start_ms")).withColumn("end", F.timestamp_millis("end_ms")).drop("start_ms", "end_ms")
    return split_by_day(rows) if by_day else rows
