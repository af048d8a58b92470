"""Polls that take a bounded number of records a user and keep offsets in a folder."""

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from strandline.session import with_workers
from strandline.sources.polling import PollingSource
from strandline.streaming.stateful import run_to_target

ZERO = datetime(1970, 1, 1, tzinfo=timezone.utc)


class Meters(PollingSource):
    """A service that is a file: users, records of each (two a second, of one time), the time."""

    def _all(self):
        with open(self.options["at"]) as f:
            return json.load(f)

    def now_ms(self):
        return self._all()["now"]

    def users(self):
        s = self._all()
        return [f"u{i}" for i in range(s["users"])]

    def fetch(self, user, since_ms, until_ms):
        for i in range(self._all()["records"] if user == "u0" else 3):
            t = i // 2 * 1000
            if since_ms <= t <= until_ms:
                yield user, i, ZERO + timedelta(milliseconds=t), "+00:00", str(i)


class Many(Meters):
    """Without a look at the file for each user."""

    def fetch(self, user, since_ms, until_ms):
        for i in range(3):
            if since_ms <= i * 1000 <= until_ms:
                yield user, i, ZERO + timedelta(seconds=i), "+00:00", ""


def start(spark, tmp_path, kind, most):
    import test_bounded_polls
    from pyspark import cloudpickle

    # Workers cannot import a module of tests.
    cloudpickle.register_pickle_by_value(test_bounded_polls)
    with_workers(spark)
    spark.dataSource.register(kind)
    stream = spark.readStream.format(kind.name()).option("at", f"{tmp_path}/service.json").option("state", f"{tmp_path}/state").option("groups", "3").option("max_records", str(most)).load()
    keyed = stream.withColumn("ts", F.timestamp_millis(F.unix_millis("ts") * 1000 + F.col("seq")))
    query = run_to_target(keyed, f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination()
    return query


def test_each_poll_takes_so_many_and_none_twice(spark, tmp_path):
    took = []
    for now in (10_000, 20_000, 20_000, 30_000, 40_000):
        (tmp_path / "service.json").write_text(json.dumps({"users": 5, "records": 11 if now < 40_000 else 13, "now": now}))
        start(spark, tmp_path, Meters, 4)
        out = spark.read.parquet(f"{tmp_path}/out")
        took.append({r.user_key: (r.n, r.different) for r in out.groupBy("user_key").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("different")).collect()})
    # A poll at a time that was polled before brings nothing.
    assert [t["u0"] for t in took] == [(4, 4), (8, 8), (8, 8), (11, 11), (13, 13)]
    assert all(t[f"u{i}"] == (3, 3) for t in took for i in range(1, 5))
    assert len(list((tmp_path / "state").iterdir())) <= 3


def test_a_batch_that_is_run_again_reads_the_same(spark, tmp_path):
    service = lambda now: (tmp_path / "service.json").write_text(json.dumps({"users": 2, "records": 9, "now": now}))
    service(10_000)
    start(spark, tmp_path, Meters, 4)
    # The query ended before it noted that its batch was done.
    (tmp_path / "check" / "commits" / "0").unlink()
    (tmp_path / "check" / "commits" / ".0.crc").unlink(missing_ok=True)
    service(20_000)
    start(spark, tmp_path, Meters, 4)
    start(spark, tmp_path, Meters, 4)
    rows = spark.read.parquet(f"{tmp_path}/out").filter("user_key = 'u0'")
    assert rows.count() == rows.select("seq").distinct().count() == 8


def test_very_many_users(spark, tmp_path):
    (tmp_path / "service.json").write_text(json.dumps({"users": 100_000, "records": 0, "now": 10_000}))
    query = start(spark, tmp_path, Many, 2)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 200_000
    offsets = max((tmp_path / "check" / "offsets").glob("[0-9]*"), key=lambda p: int(p.name))
    assert offsets.stat().st_size < 5_000 and query.exception() is None
    (tmp_path / "service.json").write_text(json.dumps({"users": 100_000, "records": 0, "now": 20_000}))
    start(spark, tmp_path, Many, 2)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 300_000
