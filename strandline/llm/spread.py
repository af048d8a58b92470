"""Joins that deal the rows of a hot key over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of all rows; so there are fewer hot keys than its inverse.
HOT_KEYS = 20_000
#: Keys with fewer rows are never hot.
LEAST_ROWS = 64


def hot_edge(total: int) -> int:
    """Keys with more rows than this are hot; fewer than ``HOT_KEYS`` can be."""
    return max(LEAST_ROWS, total // HOT_KEYS)


def join_spread(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``groups``, one row per key, whose ``size`` is the key's count in rows.

    The row of a hot key is repeated once for every ``hot_edge`` rows that it
    meets, and these are dealt over the repeats. Only hot keys and their numbers
    of repeats are broadcast: at most ``HOT_KEYS``, by their share of ``total``.
    """
    edge = hot_edge(total)
    repeats = F.greatest(F.lit(1), F.ceil(F.col(size) / edge)).cast("int")
    hot = groups.filter(F.col(size) > edge).select(*keys, repeats.alias("_repeats"))
    dealt = F.pmod(F.xxhash64(*rows.columns), F.coalesce("_repeats", F.lit(1))).cast("int")
    left = rows.join(F.broadcast(hot), keys, "left").withColumn("_deal", dealt).drop("_repeats")
    right = groups.withColumn("_deal", F.explode(F.sequence(F.lit(0), repeats - 1))).drop(size)
    return left.join(right, [*keys, "_deal"]).drop("_deal")
