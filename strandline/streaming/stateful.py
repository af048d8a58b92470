"""Per-user state: the gate, thinning, and windows that a user's own next record closes.

Spark's watermark is one for all users. Here each user's state holds the last
accepted time and the open window's sums, so that windows close user by user.
State is in RocksDB and never needs more than a few numbers per user; a
micro-batch that is run again starts from the state before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from strandline.functions.times import local, ms, window_begin
from strandline.functions.values import ACTIVE
from strandline.session import shared_dir, with_workers
from strandline.sources.sinks import batch_writer, wipe

ROCKSDB = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def use_rocksdb(spark: SparkSession) -> None:
    for k, v in ROCKSDB.items():
        spark.conf.set(k, v)


def _batch(rows: Iterator[pd.DataFrame]) -> pd.DataFrame | None:
    parts = [r for r in rows if len(r)]
    return pd.concat(parts, ignore_index=True).sort_values("seq", kind="stable") if parts else None


class Gate(StatefulProcessor):
    """Accepts records later than all before; with an interval, thins them greedily as well."""

    def __init__(self, min_interval_ms: int = 0) -> None:
        self.min_interval_ms = min_interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "seen long, kept long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = _batch(rows)
        if pdf is None:
            return
        seen, kept = self.state.get() if self.state.exists() else (None, None)
        keep = []
        for t in pdf["ms"]:
            ok = seen is None or t > seen
            if ok:
                seen = int(t)
                ok = kept is None or t - kept >= self.min_interval_ms
                kept = int(t) if ok else kept
            keep.append(ok)
        self.state.update((seen, kept))
        yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]

    def close(self) -> None:
        pass


class ActiveWindows(StatefulProcessor):
    """Gate and count of active records; a window's row comes out when the next window's first record arrives."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("open", "seen long, begin long, active long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        pdf = _batch(rows)
        if pdf is None:
            return
        seen, begin, active = self.state.get() if self.state.exists() else (None, None, 0)
        out = []
        for t, b, mode in zip(pdf["ms"], pdf["begin_ms"], pdf["mode"]):
            if seen is not None and t <= seen:
                continue
            if begin is not None and b != begin:
                out.append((key[0], begin, active))
                active = 0
            seen, begin, active = int(t), int(b), active + (mode in ACTIVE)
        self.state.update((seen, begin, active))
        if out:
            yield pd.DataFrame(out, columns=["user_key", "begin_ms", "active_count"])

    def close(self) -> None:
        pass


def stream_gate(df: DataFrame, *, min_interval_ms: int = 0) -> DataFrame:
    """``monotonic_gate`` and ``rate_limit`` over a stream with user_key, seq and ts."""
    use_rocksdb(df.sparkSession)
    keyed = df.withColumn("ms", ms("ts"))
    return keyed.groupBy("user_key").transformWithStateInPandas(Gate(min_interval_ms), keyed.schema, outputMode="Append", timeMode="None").drop("ms")


def stream_active_count(df: DataFrame, unit: str = "day") -> DataFrame:
    """``active_count`` over a stream: user_key, win_begin, active_count of closed windows."""
    use_rocksdb(df.sparkSession)
    keyed = df.select("user_key", "seq", ms("ts").alias("ms"), ms(window_begin(local("ts", "tz"), unit)).alias("begin_ms"), "mode")
    kind = df.schema["user_key"].dataType.simpleString()
    out = keyed.groupBy("user_key").transformWithStateInPandas(ActiveWindows(), f"user_key {kind}, begin_ms long, active_count long", outputMode="Append", timeMode="None")
    return out.select("user_key", F.timestamp_millis("begin_ms").alias("win_begin"), "active_count")


def read_stream(spark: SparkSession, path: str, schema, *, format: str = "parquet", max_files: int | None = None) -> DataFrame:
    """New files of a folder, a bounded number in each micro-batch."""
    reader = spark.readStream.schema(schema).format(format)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def run_to_target(df: DataFrame, target: str, checkpoint: str, *, interval: str | None = None, dry_run: bool = False, cold_start: bool = False):
    """Starts the stream into ``target``: to its present end, or on at each ``interval``.

    It goes on from its checkpoint; a ``cold_start`` forgets that and what was written.
    """
    if cold_start:
        wipe(df.sparkSession, checkpoint, target)
    writer = df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch_writer(target, dry_run=dry_run))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def run_to_end(df: DataFrame) -> DataFrame:
    """All rows that a stream gives up to its present end, as a table in the shared folder.

    A micro-batch has a folder of its own, so one that is tried again replaces itself.
    """
    spark = with_workers(df.sparkSession)
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    # An empty stream has no micro-batch, but a table of no rows.
    spark.createDataFrame([], df.schema).write.parquet(f"{at}/rows/batch=-1")
    writer = df.writeStream.outputMode("append").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(lambda rows, batch: rows.write.mode("overwrite").parquet(f"{at}/rows/batch={batch}")).start().awaitTermination()
    return spark.read.schema(df.schema.add("batch", "long")).parquet(f"{at}/rows").drop("batch")
