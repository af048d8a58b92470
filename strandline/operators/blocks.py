"""What came before a record, for users of any length: prefix scans over blocks of a user's records.

A user with very many records is cut in blocks by time. A block's summary (its greatest value, or its last one) is
aggregated where the records are read; a scan over the summaries, a row each, says
what precedes each block; and that row goes in front of the block's records, so that one window
over (user, block) does the rest. No user is sorted in one task, and the records are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Users with more records are cut, in blocks of about as many.
BLOCK_ROWS = 1_000_000
#: Blocks are made larger where more users than this would be cut; their numbers are broadcast.
MOST_CUT = 20_000


def with_block(df: DataFrame, at: Column, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``_block``, from 0: ranges of ``at``, of equal width, of each user with more than ``block_rows`` records.

    The users that are cut are broadcast: fewer than ``MOST_CUT``, as each has more than that share of all records.
    """
    sizes = df.groupBy("user_key").agg(F.count("*").alias("_n"), F.min(at).alias("_low"), F.max(at).alias("_high"))
    least = max(block_rows, (sizes.agg(F.sum("_n")).first()[0] or 0) // MOST_CUT)
    cut = sizes.filter(F.col("_n") > least).select(F.col("user_key").alias("_user"), F.ceil(F.col("_n") / least).alias("_blocks"), "_low", "_high")
    share = (at - F.col("_low")) / (F.col("_high") - F.col("_low") + 1)
    out = df.join(F.broadcast(cut), F.col("user_key").eqNullSafe(F.col("_user")), "left")
    block = F.coalesce(F.least(F.floor(share * F.col("_blocks")), F.col("_blocks") - 1), F.lit(0)).cast("int")
    return out.withColumn("_block", block).drop("_user", "_blocks", "_low", "_high")


def with_prior(df: DataFrame, value: Column, order: list[str], at: Column, *, greatest: bool, name: str = "_prior", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds the ``greatest`` value of all records before a record in ``order``, or else the value of the one before it; null at the first.

    ``at``, a number, must not fall in ``order``; records of one ``at`` are in one block. ``order`` must be total.
    """
    rows = with_block(df.withColumn("_value", value), at, block_rows)
    of = F.max("_value") if greatest else F.max_by("_value", F.struct(*order))
    blocks = rows.groupBy("user_key", "_block").agg(of.alias("_value"))
    scan = Window.partitionBy("user_key").orderBy("_block")
    before = F.max("_value").over(scan.rowsBetween(Window.unboundedPreceding, -1)) if greatest else F.lag("_value").over(scan)
    heads = blocks.withColumn("_value", before).filter("_value IS NOT NULL").withColumn("_head", F.lit(True))
    own = Window.partitionBy("user_key", "_block").orderBy(F.col("_head").desc(), *order)
    prior = F.max("_value").over(own.rowsBetween(Window.unboundedPreceding, -1)) if greatest else F.lag("_value").over(own)
    both = rows.withColumn("_head", F.lit(False)).unionByName(heads, allowMissingColumns=True)
    return both.withColumn(name, prior).filter(~F.col("_head")).drop("_value", "_head", "_block")


def split_gate(df: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``monotonic_gate`` in the order of ``seq``, for users of any length."""
    held = with_prior(df, F.unix_millis("ts"), ["seq"], F.col("seq").cast("double"), greatest=True, name="_last", block_rows=block_rows)
    return held.filter(F.col("_last").isNull() | (F.unix_millis("ts") > F.col("_last"))).drop("_last")
