"""Users cut in blocks, and hulls merged from parts, against the plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.times import ms
from strandline.operators import blocks, coverage, geodiameter, ordering
from strandline.sources.records import mobility

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the records are one user's, some are nobody's."""
    m = mobility(spark, SF)
    user = F.when(F.col("seq") % 2 == 0, F.lit("hot")).when(F.col("seq") % 10 == 1, F.lit(None)).otherwise(F.col("seq").cast("string").substr(-1, 1))
    # Records that arrive late, and some at one time.
    late = F.timestamp_millis(ms("ts") - F.when(F.col("seq") % 9 == 0, 5_000_000).otherwise(0))
    return m.select(user.alias("user_key"), "seq", late.alias("ts"), "tz", "lat", "lng", "accuracy").persist()


def rows(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("block_rows", [7, 100, 10_000])
def test_gate_and_coverage(hot, block_rows):
    want = ordering.monotonic_gate(hot)
    got = blocks.split_gate(hot, block_rows=block_rows)
    assert got.columns == want.columns and rows(got, "user_key", "seq") == rows(want, "user_key", "seq")
    how = dict(max_gap_ms=3_000_000)
    assert rows(coverage.mobility_coverage(hot, block_rows=block_rows, **how), "*") == rows(coverage.mobility_coverage(hot, **how), "*")


def test_a_hot_user_takes_several_tasks(hot):
    """Without adaptive execution: the hot user's records end in many partitions, none with most of them."""
    spark = hot.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = blocks.with_prior(hot, ms("ts"), ["seq"], F.col("seq").cast("double"), greatest=True, block_rows=20)
        # What precedes is read too, else Spark would leave the window out.
        read = out.select("user_key", F.spark_partition_id().alias("task"), "_prior").groupBy("user_key", "task").agg(F.count("*").alias("n"), F.max("_prior"))
        per = [r.n for r in read.collect() if r.user_key == "hot"]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(per) >= 4 and max(per) <= 0.5 * sum(per)


def test_empty(spark, hot):
    assert blocks.split_gate(hot.filter("false")).collect() == []
    assert geodiameter.geodiameter(hot.filter("false")).collect() == []


def test_hulls_of_parts(hot):
    """One record in a batch, or all of them: the same widest pairs."""
    spark, got = hot.sparkSession, []
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for n in ("1", "7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        got.append(rows(geodiameter.geodiameter(hot.repartition(5), "week", include_open=True), "*"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert got[0] == got[1] == got[2] and len(got[0]) > 5


def test_only_corners_are_shuffled(hot):
    corners = next(geodiameter._corners(iter([hot.filter("lat IS NOT NULL and user_key = 'hot'").select("user_key", F.lit(0).alias("win_begin"), "seq", ms("ts").alias("_ms"), "lat", "lng").toPandas()])))
    assert 3 <= len(corners) < 60 and corners["_first"].nunique() == 1


def test_tolerance(hot):
    exact, near = (geodiameter.geodiameter(hot, "month", include_open=True, tolerance_m=m).select("user_key", "miles").collect() for m in (0, 50))
    exact, near = ({r.user_key: r.miles for r in x} for x in (exact, near))
    assert all(0 <= exact[u] - near[u] <= 100 / 1609 for u in near) and len(near) == len(exact)
    assert list(geodiameter._apart(np.array([0.0, 0.0001, 0.1]), np.zeros(3), 50)) == [0, 2]
