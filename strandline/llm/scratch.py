"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from strandline.session import with_workers


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only where that is unset, in local mode, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="strandline-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Lets Spark delete a plan's shuffle files as soon as the plan has run.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Folders of the open ``made_within`` blocks.
_open: list[list[Scratch]] = []


@contextmanager
def made_within() -> Iterator[None]:
    """Delete, at the end, the tables of all operators that begin within; their results must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        for scratch in _open.pop():
            scratch.delete()


class Scratch:
    """A folder of parquet tables for one run of an operator.

    A saved table is read again from storage, so losing an executor never
    makes Spark repeat what came before it. With ``clean`` the shuffle files of
    a table's plan go once it is saved, and not when the driver's garbage is collected.
    """

    def __init__(self, spark: SparkSession, name: str, *, clean: bool = False) -> None:
        self.spark, self.clean = with_workers(spark), clean
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        if _open:
            _open[-1].append(self)

    def delete(self) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def place(self, name: str) -> str:
        self.count += 1
        return f"{self.path}/{self.count:03d}-{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        at = self.place(name)
        before = self.spark.conf.get(CLEANUP)
        if self.clean:
            self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(at)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._strandline_path = at
        return out

    def exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            at = jvm.org.apache.hadoop.fs.Path(table._strandline_path)
            at.getFileSystem(conf).delete(at, True)
