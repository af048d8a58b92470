"""Writing records. A later record of the same millisecond replaces an earlier one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.times import ms
from strandline.operators.ordering import latest


def upsert_last(df: DataFrame, *, order: str = "seq") -> DataFrame:
    """One row per user and millisecond: the last to arrive."""
    return latest(df.withColumn("_at", ms("ts")), ["user_key", "_at"], [F.col(order).desc()]).drop("_at")


def write_stream(df: DataFrame, path: str | None, *, dry_run: bool = False, mode: str = "overwrite", format: str = "parquet") -> None:
    """A target stream: last records win, compressed; nothing is written without a target or in a dry run."""
    if path is None or dry_run:
        return
    upsert_last(df).write.mode(mode).format(format).option("compression", "zstd" if format == "parquet" else "gzip").save(path)


def batch_writer(path: str, *, dry_run: bool = False) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch has its own folder, so one that is tried again replaces itself.

    A record that comes again in a later batch replaces the earlier one for ``read_target``.
    """

    def write(df: DataFrame, batch: int) -> None:
        if not dry_run:
            upsert_last(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def read_target(spark: SparkSession, path: str, *, order: str = "seq") -> DataFrame:
    """What ``batch_writer`` wrote: of records of one user and millisecond the last, by batch and then ``order``."""
    rows = spark.read.parquet(path).withColumn("_at", ms("ts"))
    return latest(rows, ["user_key", "_at"], [F.col("batch").desc(), F.col(order).desc()]).drop("_at", "batch")


def wipe(spark: SparkSession, *paths: str) -> None:
    """A cold start: delete state and what was written with it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
