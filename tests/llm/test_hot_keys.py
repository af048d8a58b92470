"""A third of all rows under one key: the last joins deal them over tasks, without adaptive execution."""

import pytest
from pyspark.sql import functions as F

from strandline.llm import exact_dedup as exact
from strandline.llm import mixing, simhash, spread


@pytest.fixture
def plain_plans(spark, monkeypatch):
    monkeypatch.setattr(spread, "LEAST_ROWS", 40)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def per_task(df, hot):
    """Rows of the hot key by the task that the last join leaves them in."""
    return sorted(r["count"] for r in df.withColumn("_task", F.spark_partition_id()).filter(hot).groupBy("_task").count().collect())


def rows(n=1200):
    return [(i, "the same words again" if i % 3 == 0 else f"other words {i} and {i * 7}") for i in range(n)]


def test_simhash(docs, plain_plans):
    groups = simhash.simhash_groups(docs(rows()))
    per = per_task(groups, "doc_id % 3 = 0")
    assert sum(per) == 400 and len(per) >= 3 and per[-1] <= 0.6 * sum(per)
    assert {r.component_id for r in groups.filter("doc_id % 3 = 0").collect()} == {0}


def test_exact_dedup(spark, docs, plain_plans, tmp_path):
    docs(rows()).repartition(3).write.parquet(f"{tmp_path}/d")
    found = exact.exact_dedup(spark, f"{tmp_path}/d")
    per = per_task(found, "doc_id % 3 = 0")
    assert sum(per) == 400 and len(per) >= 3 and per[-1] <= 0.6 * sum(per)
    assert {(r.keep_id, r.group_size) for r in found.filter("doc_id % 3 = 0").collect()} == {(1197, 400)}


def test_mixing_sums(spark):
    """Places in the streams of sources are without gaps whatever the buckets; null is a source."""
    rows = [(i, None if i % 7 == 0 else "hot" if i % 3 else f"s{i % 11}", i * 37 % 23, i) for i in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, source string, size long, tie long")
    places = {}
    for bucket_rows in (3, 1024):
        placed = mixing.place_documents(table, bucket_rows).collect()
        assert len(placed) == 600
        for source in {r.source for r in placed}:
            at = sorted((r["at"], r.size) for r in placed if r.source == source)
            assert at[0][0] == 0 and all(a + size == b for (a, size), (b, _) in zip(at, at[1:]))
        places[bucket_rows] = sum(r.size for r in placed)
    assert places[3] == places[1024] == sum(r[2] for r in rows)


def test_sums_before(spark):
    rows = [(s, at, at % 5 + 1) for s in ("a", None) for at in range(0, 90, 2)]
    sums = spark.createDataFrame(rows, "source string, bucket long, held long")
    got = {(r.s, r.bucket): r.base for r in mixing.sums_before(sums, "bucket", "held", 7).collect()}
    assert got == {(s, at): sum(v for t, b, v in rows if t == s and b < at) for s, at, _ in rows}
