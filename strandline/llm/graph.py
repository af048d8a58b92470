"""Connected components by alternating large-star and small-star steps.

Each step is two aggregations and a join on one key (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Minima are aggregated map-side
before the shuffle, and no neighbour list is ever gathered, so a node with very
many links needs no more memory than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.scratch import Scratch


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"] or 0


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges(u, v)`` of comparable ids -> ``(u, v)``: v is the smallest id that u reaches.

    Self links and repeats are ignored; ids that are their component's smallest
    have no row. An empty input gives an empty result.
    """
    hi, lo = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    now = scratch.save(edges.filter("u <> v").select(hi, lo).distinct(), "edges")
    before = _signature(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.save(large, "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = scratch.save(small.select("e.u", "e.v").filter("u <> v").distinct(), "small")
        scratch.drop(now, large)
        now, signature = after, _signature(after)
        if signature == before:
            break
        before = signature
    return now
