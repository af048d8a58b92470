from datetime import datetime

from pyspark.sql import functions as F

from strandline.operators import activity, ordering
from strandline.sources import records
from strandline.sources.records import mobility
from strandline.sources.sinks import batch_writer, read_target
from strandline.streaming.stateful import read_stream, run_to_target, stream_active_count, stream_gate

SF = "/root/testdata/sf0.001"


def test_batch_and_stream_agree(spark, tmp_path):
    table = mobility(spark, SF).select("user_key", "seq", "ts", "tz", "mode")
    for i in range(3):
        # Files in order of arrival, each with some records of its predecessor again.
        table.filter(f"seq >= {i * 300 - 50} and seq < {(i + 1) * 300}").coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
    files = str(tmp_path / "in" / "*")
    part = lambda n: read_stream(spark, files, table.schema, max_files=1)
    arrived = table.filter("seq < 900")
    for name, stream, batch in (
        ("gate", stream_gate(part(0), min_interval_ms=1_800_000).select("user_key", "seq"), ordering.rate_limit(ordering.monotonic_gate(arrived), 1_800_000).select("user_key", "seq")),
        ("count", stream_active_count(part(0)), activity.active_count(ordering.monotonic_gate(arrived)).select("user_key", "win_begin", "active_count")),
    ):
        at = str(tmp_path / name)
        keyed = stream if "seq" in stream.columns else stream.withColumn("seq", stream["active_count"])
        keyed = keyed.withColumn("ts", keyed["win_begin"]) if "win_begin" in keyed.columns else keyed.join(table.select("seq", "ts"), "seq")
        run_to_target(keyed, f"{at}/out", f"{at}/check").awaitTermination()
        got = spark.read.parquet(f"{at}/out").select(*batch.columns)
        assert sorted(got.collect()) == sorted(batch.collect())


def test_hourly_counts_over_restarts(spark, tmp_path):
    """Ticks of three hours in files with repeats: the stream stops and goes on after each, and counts 1800 an hour."""
    ticks = records.odd(records.ticks(spark, 1_356_998_400_000, 3 * 3600 + 60)).withColumn("mode", F.lit("WALK"))
    files = tmp_path / "in"

    def run(**how):
        stream = stream_active_count(read_stream(spark, f"{files}/*", ticks.schema, max_files=1), "hour")
        keyed = stream.withColumn("ts", F.col("win_begin")).withColumn("seq", F.lit(0))
        run_to_target(keyed, f"{tmp_path}/out", f"{tmp_path}/check", **how).awaitTermination()
        return sorted((r.win_begin.hour, r.active_count) for r in read_target(spark, f"{tmp_path}/out").collect())

    for low, high, want in ((0, 4000, [(0, 1800)]), (3500, 8000, [(0, 1800), (1, 1800)]), (7900, 10860, [(0, 1800), (1, 1800), (2, 1800)])):
        ticks.filter(f"seq >= {low} and seq < {high}").coalesce(1).write.parquet(f"{files}/{low}")
        assert run() == want
    assert run() == want
    assert run(cold_start=True) == want


def test_later_batches_replace(spark, tmp_path):
    write = batch_writer(str(tmp_path / "t"))
    rows = lambda *r: spark.createDataFrame(r, "user_key string, seq long, ts timestamp, v int")
    t0 = datetime(2024, 1, 1)
    write(rows(("u", 5, t0, 1), ("v", 1, t0, 7)), 0)
    write(rows(("u", 1, t0, 2), ("u", 3, t0, 3)), 1)
    write(rows(("u", 1, t0, 2), ("u", 3, t0, 3)), 1)
    assert sorted((r.user_key, r.v) for r in read_target(spark, str(tmp_path / "t")).collect()) == [("u", 3), ("v", 7)]
