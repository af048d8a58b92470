"""Mixing sources to target weights with a low-discrepancy schedule.

Each source's documents, in a fixed pseudo-random order, are one stream of
words, which is cut into blocks of equal size and may be gone through up to
``repeat`` times. The schedule has 2**m slots; slot j's van der Corput point
(the bits of j mirrored) falls into one source's interval of the cumulative
block counts, and the rank of the slot among its source's slots says which
block it plays. 2**m equispaced points hit an interval of length w at least
w * 2**m - 1 times, so with 2**m at least twice the number of blocks every
block is played, and any run of slots holds the sources in proportion.

DataFrame operations only. Offsets in a stream come from three-level prefix sums
(runs of buckets of a source, buckets of a run, then rows of a bucket), so a hot
source is never in one task: of 2**40 rows the largest window holds 2**20 sums; slots and pieces join on (source, block), which spreads it evenly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.scratch import Scratch
from strandline.llm.words import WORD

REPEAT = 3
CYCLE = (1, 2, 3)
BLOCK_WORDS = 8192
MIN_BLOCKS = 1 << 15
BUCKET_ROWS = 1024


def source_targets(docs: DataFrame, *, cycle: tuple[int, ...] = CYCLE, repeat: int = REPEAT) -> DataFrame:
    """``docs(source, size)`` -> ``(source, source_size, docs, weight, target)``, one row per source.

    Sources in code point order, null last, weigh ``cycle`` over and over. A
    target is the weight's share of all sizes but at most ``repeat`` times its
    source's; what is above is shared out by weight among the others until none
    is. That fixed point is min(repeat * size, level * weight) for the one level
    at which the targets sum to all sizes: with sources ordered by size / weight
    it follows from running sums. One row per source reaches the windows here,
    never the documents.
    """
    by = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("weight", F.element_at(F.lit(list(cycle)), (place % len(cycle) + 1).cast("int")))
    ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    below, all_ = ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    capped = F.coalesce(F.sum("source_size").over(below), F.lit(0)) * repeat
    heavier = F.sum("weight").over(all_) - F.coalesce(F.sum("weight").over(below), F.lit(0))
    by = by.withColumn("level", (F.sum("source_size").over(all_) - capped) / heavier)
    # The first source, in this order, that its level leaves below its cap sets the level of all.
    free = F.col("level") * F.col("weight") <= F.col("source_size") * repeat
    level = F.min_by("level", F.when(free, F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source")))
    by = by.withColumn("level", F.coalesce(level.over(all_), F.lit(float("inf"))))
    return by.withColumn("target", F.least(F.col("source_size") * float(repeat), F.col("level") * F.col("weight")).cast("double")).drop("level")


def sums_before(sums: DataFrame, at: str, value: str, run: int = BUCKET_ROWS) -> DataFrame:
    """``sums(source, at, value)`` -> ``(s, at, base)``: the values of the source before each ``at``.

    In two levels, runs of ``run`` numbers and the numbers of a run. Null sources are one.
    """
    cut = sums.select("source", at, value, F.expr(f"{at} div {run}").alias("run"))
    runs = cut.groupBy("source", "run").agg(F.sum(value).alias("held_run"))
    ahead = Window.partitionBy("source").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(F.col("source").alias("s"), F.col("run").alias("r"), F.coalesce(F.sum("held_run").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "run").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("base", F.coalesce(F.sum(value).over(within), F.lit(0)))
    joined = cut.join(runs, cut["source"].eqNullSafe(runs["s"]) & (cut["run"] == runs["r"]))
    return joined.select("s", at, (F.col("ahead") + F.col("base")).alias("base"))


def place_documents(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``at``: the words before a document in its source's shuffled stream."""
    buckets = F.greatest(F.ceil(F.lit(docs.count()) / bucket_rows), F.lit(1))
    docs = docs.withColumn("order", F.xxhash64("doc_id", F.lit("mixing"))).withColumn("bucket", F.pmod("order", buckets))
    sums = docs.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    sums = sums_before(sums, "bucket", "held", bucket_rows).withColumnRenamed("bucket", "b")
    within = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = docs.join(sums, docs["source"].eqNullSafe(sums["s"]) & (docs["bucket"] == sums["b"]))
    return joined.withColumn("at", F.col("base") + F.col("inner")).drop("s", "b", "base", "inner", "order", "bucket")


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """``(source, target)`` -> ``(slot, source, block)``: which block each slot plays."""
    spark = targets.sparkSession
    blocks = targets.select("source", F.ceil(F.col("target") / block).cast("long").alias("blocks"))
    order = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    marks = blocks.select("source", "blocks", F.coalesce(F.sum("blocks").over(order), F.lit(0)).alias("low")).filter("blocks > 0")
    total = marks.agg(F.sum("blocks")).first()[0] or 0
    m = max(1, (2 * total - 1).bit_length())
    # A source's points are those j with low <= mirrored(j) * total / 2**m < low + blocks: count
    # them by the mirrored index, which is an interval, and no slot has to look its source up.
    lo = F.ceil(F.col("low") / F.lit(total) * F.lit(2**m)).cast("long")
    hi = F.ceil((F.col("low") + F.col("blocks")) / F.lit(total) * F.lit(2**m)).cast("long")
    chunk = 1 << 14
    spans = marks.withColumn("lo", lo).withColumn("hi", hi).filter("hi > lo")
    spans = spans.withColumn("c", F.explode(F.sequence(F.expr(f"lo div {chunk}"), F.expr(f"(hi - 1) div {chunk}"))))
    points = spans.repartition(F.col("c")).select("source", "blocks", F.explode(F.sequence(F.greatest("lo", F.col("c") * chunk), F.least("hi", (F.col("c") + 1) * chunk) - 1)).alias("x"))
    slot = F.conv(F.reverse(F.lpad(F.bin("x"), m, "0")), 2, 10).cast("long")
    # Ranks per source, again by levels: slots in equal ranges, then within a range.
    points = points.select("source", "blocks", slot.alias("slot")).withColumn("range", F.expr(f"slot div {chunk}"))
    held = points.groupBy("source", "range").agg(F.count("*").alias("n"))
    held = sums_before(held, "range", "n").withColumnRenamed("range", "r")
    ranked = points.withColumn("inner", F.row_number().over(Window.partitionBy("source", "range").orderBy("slot")) - 1)
    ranked = ranked.join(held, ranked["source"].eqNullSafe(held["s"]) & (ranked["range"] == held["r"]))
    return ranked.withColumn("block", F.col("base") + F.col("inner")).filter("block < blocks").select("slot", "source", "block")


def block_words(total: int, block: int = BLOCK_WORDS, min_blocks: int = MIN_BLOCKS) -> int:
    """Blocks of ``block`` words, smaller ones where that would give too few."""
    return max(1, min(block, total // min_blocks))


def mix_sources(docs: DataFrame, *, cycle: tuple[int, ...] = CYCLE, repeat: int = REPEAT) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text, source, ...)`` -> (placed documents, pieces in schedule order).

    Documents: doc_id, source, size, source_size, target, at, row_key. Pieces:
    slot, source, block, row_key, doc_id, round, first, words: slot plays
    ``words`` words of the document from its word ``first`` on, in that round
    through the source. A source's pieces hold round(target) words, and no
    document more than ``repeat`` times its size.

    Size is the number of words; null texts have 0 and are in no piece. A null
    source is a source, apart from ''. Repeated rows are documents each by
    itself, and ties are broken by the text's hash; only equal rows can swap
    places. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("tie"))
    sized = scratch.save(sized, "sizes")
    targets = scratch.save(source_targets(sized, cycle=cycle, repeat=repeat), "targets")
    block = block_words(targets.agg(F.sum("source_size")).first()[0] or 0)
    placed = place_documents(sized)
    goals = targets.select(F.col("source").alias("s"), "source_size", "target")
    placed = placed.join(goals, placed["source"].eqNullSafe(goals["s"])).drop("s")
    placed = scratch.save(placed.withColumn("row_key", F.when(F.col("size") > 0, F.col("at"))), "placed")

    end = F.round("target").cast("long")
    rounds = placed.filter("size > 0 and target > 0").withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))).withColumn("begin", F.col("at") + F.col("round") * F.col("source_size"))
    rounds = rounds.withColumn("stop", F.least(F.col("begin") + F.col("size"), end)).filter("begin < stop")
    cut = rounds.withColumn("block", F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(stop - 1) div {block}"))))
    low, high = F.greatest("begin", F.col("block") * block), F.least("stop", (F.col("block") + 1) * block)
    cut = cut.select("source", "block", "row_key", "doc_id", "round", (low - F.col("begin")).alias("first"), (high - low).alias("words"))
    plan = schedule(targets, block).withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    pieces = plan.join(cut, plan["s"].eqNullSafe(cut["source"]) & (plan["b"] == cut["block"])).drop("s", "b")
    return placed, pieces


def mixed_counts(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target and ``taken``: the words of each document that the mix plays."""
    placed, pieces = mix_sources(docs, **how)
    taken = pieces.groupBy("source", "row_key", "doc_id").agg(F.sum("words").alias("taken")).select(F.col("source").alias("s"), F.col("row_key").alias("k"), F.col("doc_id").alias("d"), "taken")
    same = placed["source"].eqNullSafe(taken["s"]) & (placed["row_key"] == taken["k"]) & placed["doc_id"].eqNullSafe(taken["d"])
    return placed.join(taken, same, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """Whole documents as the mix repeats them, with the columns of ``docs``.

    A document comes as many times as the mix plays its first word; documents
    without words come once.
    """
    placed, pieces = mix_sources(docs, **how)
    starts = pieces.filter("first = 0").groupBy("source", "row_key", "doc_id").agg(F.count("*").alias("times")).select(F.col("source").alias("s"), F.col("row_key").alias("k"), F.col("doc_id").alias("d"), "times")
    same = placed["source"].eqNullSafe(starts["s"]) & (placed["row_key"] == starts["k"]) & placed["doc_id"].eqNullSafe(starts["d"])
    counts = placed.join(starts, same, "left").withColumn("times", F.when(F.col("size") == 0, 1).otherwise(F.coalesce("times", F.lit(0))))
    # Repeated rows (equal id, source and text) pool their times and share them evenly, rounded up.
    counts = counts.groupBy("doc_id", "source", "tie").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    counts = counts.select("doc_id", "source", "tie", F.ceil(F.col("times") / F.col("rows")).cast("int").alias("copies")).filter("copies > 0")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("d"), F.col("source").alias("s"), F.xxhash64("text").alias("t"))
    same = rows["d"].eqNullSafe(counts["doc_id"]) & rows["s"].eqNullSafe(counts["source"]) & (rows["t"] == counts["tie"])
    return rows.join(counts, same).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
