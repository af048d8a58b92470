"""The record store: last one wins, whole writes, and what a read leaves out."""

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline.sources.store import Store
from strandline.streaming.stateful import read_stream

SCHEMA = "user_key string, seq long, ts timestamp, v int, note string"
T0 = datetime(2024, 1, 1)


def at(hours):
    return T0 + timedelta(hours=hours)


def rows(df):
    return sorted((r.user_key or "", r.ts, r.v) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"), user_parts=4)


def make(spark, *records):
    return spark.createDataFrame([(u, s, at(h), v, "x") for u, s, h, v in records], SCHEMA)


def test_last_one_wins_across_writes(spark, store):
    store.upsert(make(spark, ("u", 5, 0, 1), ("u", 6, 0, 2), ("v", 1, 30, 7), (None, 1, 0, 9)))
    store.upsert(make(spark, ("u", 1, 0, 3), ("w", 1, 31, 8)))
    assert rows(store.read()) == [("", at(0), 9), ("u", at(0), 3), ("v", at(30), 7), ("w", at(31), 8)]
    assert rows(store.read(user="u")) == [("u", at(0), 3)]
    assert rows(store.read(since=at(30), until=at(30))) == [("v", at(30), 7)]
    store.vacuum()
    assert store.read().count() == 4


def test_a_write_that_fails_leaves_no_row(spark, store):
    store.upsert(make(spark, ("u", 1, 0, 1)), 0)
    bad = make(spark, ("u", 2, 0, 2), ("u", 3, 50, 3)).withColumn("v", F.when(F.col("seq") == 3, F.raise_error(F.lit("lost")).cast("int")).otherwise(F.col("v")))
    with pytest.raises(PySparkException):
        store.upsert(bad, 1)
    assert rows(store.read()) == [("u", at(0), 1)]
    store.upsert(make(spark, ("u", 2, 0, 2)), 1)
    assert rows(store.read()) == [("u", at(0), 2)]


def test_a_write_that_never_commits_leaves_no_row(spark, store, monkeypatch):
    store.upsert(make(spark, ("u", 1, 0, 1)), 0)
    with monkeypatch.context() as m:
        m.setattr(Store, "_commit", lambda *_: (_ for _ in ()).throw(OSError("the driver is gone")))
        with pytest.raises(OSError):
            store.upsert(make(spark, ("u", 2, 0, 2), ("q", 1, 9, 9)), 1)
    assert rows(store.read()) == [("u", at(0), 1)]
    store.upsert(make(spark, ("u", 2, 0, 5)), 1)
    assert rows(store.read()) == [("u", at(0), 5)]


def test_a_batch_written_again_changes_nothing(spark, store):
    store.upsert(make(spark, ("u", 1, 0, 1)), 0)
    store.upsert(make(spark, ("u", 2, 0, 2)), 1)
    store.upsert(make(spark, ("u", 9, 0, 9)), 1)
    store.upsert(make(spark, ("u", 9, 0, 9)), 0)
    assert rows(store.read()) == [("u", at(0), 2)]


def test_a_read_opens_the_files_asked_for(spark, store):
    store.upsert(make(spark, *[(f"u{i}", h, 24 * h, i) for i in range(12) for h in range(6)]))
    every = len(store.read().inputFiles())
    some = store.read(user="u3", since=at(48), until=at(72), columns=["ts", "v"])
    assert every >= 20 and len(some.inputFiles()) == 2 and some.count() == 2
    plan = some._jdf.queryExecution().toString()
    assert "note" not in plan.split("ReadSchema")[-1] and "PushedFilters: [IsNotNull(user_key)" in plan.replace("PushedFilters: [IsNotNull(ts), IsNotNull(user_key)", "PushedFilters: [IsNotNull(user_key)")


def test_untouched_folders_stay(spark, store):
    store.upsert(make(spark, *[("u", h, 24 * h, h) for h in range(4)]))
    before = set(store.read().inputFiles())
    store.upsert(make(spark, ("u", 9, 24, 100)))
    after = set(store.read().inputFiles())
    assert len(before & after) == 3 and rows(store.read(since=at(24), until=at(24))) == [("u", at(24), 100)]


def test_stream_into_the_store(spark, store, tmp_path):
    for i in range(2):
        make(spark, ("u", i, 0, i), ("v", i, i, i)).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
        stream = read_stream(spark, f"{tmp_path}/in/*", make(spark, ("u", 0, 0, 0)).schema, max_files=1)
        stream.writeStream.option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).foreachBatch(store.upsert).start().awaitTermination()
    assert rows(store.read()) == [("u", at(0), 1), ("v", at(0), 0), ("v", at(1), 1)]


def test_empty_writes_and_stores(spark, store):
    with pytest.raises(ValueError):
        store.read()
    store.upsert(make(spark, ("u", 1, 0, 1)).filter("false"))
    store.upsert(make(spark, ("u", 1, 0, 1)))
    assert store.read(user="nobody").count() == 0 and store.read(since=at(900)).count() == 0
