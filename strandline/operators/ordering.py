"""Order of arrival, gates and thinning."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.times import ms


def _before(*order: str | Column) -> Window:
    return Window.partitionBy("user_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def monotonic_gate(df: DataFrame, *, order: tuple = ("seq",)) -> DataFrame:
    """Keeps a record only if it is later than all that arrived before it; ties go too.

    The greatest time of all records is that of the accepted ones, so one window is enough.
    """
    last = F.max(ms("ts")).over(_before(*order))
    return df.withColumn("_last", last).filter(F.col("_last").isNull() | (ms("ts") > F.col("_last"))).drop("_last")


def location_gate(df: DataFrame, *, at: str = "loc_ts") -> DataFrame:
    """Keeps located records whose location is not older than an earlier one's; equal times stay."""
    located = df.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return located.withColumn("_last", F.max(ms(at)).over(_before("ts", "seq"))).filter(F.col("_last").isNull() | (ms(at) >= F.col("_last"))).drop("_last")


def accurate(df: DataFrame, metres: float = 100, *, inclusive: bool = True) -> DataFrame:
    """Located records of an accuracy up to (or under) so many metres; -1, not known, passes."""
    near = F.col("accuracy") <= metres if inclusive else F.col("accuracy") < metres
    return df.filter(F.col("lat").isNotNull() & F.col("lng").isNotNull() & near)


def drop_unknown(df: DataFrame) -> DataFrame:
    return df.filter(F.col("mode") != "UNKNOWN")


def rate_limit(df: DataFrame, min_interval_ms: int = 30_000) -> DataFrame:
    """Greedy thinning: the first record, then each that is ``min_interval_ms`` after the last one kept.

    What is kept depends on what was kept, which no window can say. Partitions
    sorted by user and time are passed through in batches; a task carries one
    time stamp from row to row, so a user of any length needs no more memory.
    Records without a user are those of one user.
    """
    keyed = df.withColumn("_ms", ms("ts")).repartition("user_key").sortWithinPartitions("user_key", "_ms", "seq")

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, last = object(), 0
        for pdf in batches:
            users = pdf["user_key"].astype(object).where(pdf["user_key"].notna(), None)
            keep = []
            for u, t in zip(users, pdf["_ms"].to_numpy()):
                ok = u != user or t - last >= min_interval_ms
                if ok:
                    user, last = u, t
                keep.append(ok)
            yield pdf[pd.Series(keep, index=pdf.index, dtype=bool)]

    return keyed.mapInPandas(thin, keyed.schema).drop("_ms")


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
