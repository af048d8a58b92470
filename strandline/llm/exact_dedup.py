"""Exact deduplication as a stateful stream.

The documents are read as a stream. The state, kept in RocksDB on disk and
never expired, holds for each content digest the stable identifier of the row
that stays, its content locator (file and row number) and the count of rows.
Every micro-batch aggregates map-side before it meets the state, so a text that
a third of the rows share sends one row per task.

A hit, that is a digest with more than one row, is not trusted: the full bytes
of all its rows are compared (their least and greatest text must be equal).
Digests whose texts differ are regrouped by the text itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.scratch import Scratch
from strandline.llm.spread import join_spread

#: Hits up to this number (32 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_HITS = 100_000
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Many small stores: no space set aside in advance.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def stream_state(spark: SparkSession, source: DataFrame, scratch: Scratch, digest=sha256) -> DataFrame:
    """Run the stream to its present end -> ``(digest, keep struct<doc_id, file, row>, n)``."""
    text = F.coalesce("text", F.lit(""))
    keep = F.struct("doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    state = source.select(digest(text).alias("digest"), keep.alias("keep")).groupBy("digest").agg(F.max("keep").alias("keep"), F.count("*").alias("n"))
    at = scratch.place("state")
    old = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        # A batch that is tried again overwrites its own folder.
        query = state.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", scratch.place("stream")).foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{at}/batch={i}")).start()
        query.awaitTermination()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = state.schema.add("batch", "long")
    # An empty source runs no batch and leaves no folder.
    empty = query.lastProgress is None or not scratch.exists(at)
    told = spark.createDataFrame([], schema) if empty else spark.read.schema(schema).parquet(at)
    # Both the kept row and the count only ever grow, so the latest is the greatest.
    return told.groupBy("digest").agg(F.max("keep").alias("keep"), F.max("n").alias("n"))


def exact_dedup(spark: SparkSession, path: str, *, max_files: int | None = None, max_bytes: int = 1 << 36, digest=sha256, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """The parquet documents under ``path`` -> one row for each of their rows.

    doc_id, keep_id (doc_id of the row that stays), group_size, kept, digest.
    Texts are equal when identical, a null counts as empty; of equal texts the
    largest doc_id stays, of equal doc_ids too the later file and row, and null
    doc_ids come last. Other columns are not read. An empty table gives no rows.
    ``max_files`` or ``max_bytes`` bound a micro-batch.
    """
    scratch = Scratch(spark, "exact-dedup")
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.select("doc_id", "text").schema)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)
    # Given as a pattern, a path may be one file as well as a folder.
    path = path.rstrip("/")
    source = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    state = scratch.save(stream_state(spark, source, scratch, digest), "groups")

    text = F.coalesce("text", F.lit(""))
    docs = table.select("doc_id", text.alias("text"), digest(text).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    hits = state.filter("n > 1").select("digest")
    few = F.broadcast if hits.count() <= broadcast_hits else lambda df: df
    texts = docs.select("digest", "text").join(few(hits), "digest", "left_semi")
    mixed = scratch.save(texts.groupBy("digest").agg(F.min("text").alias("a"), F.max("text").alias("b")).filter("a <> b").select("digest"), "collisions")

    slim, total = docs.select("doc_id", "digest", "file", "row"), table.count()
    sized = state.withColumn("copies", F.col("n"))
    if not mixed.isEmpty():
        clash = docs.join(mixed, "digest", "left_semi")
        groups = clash.groupBy("digest", "text").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n"))
        clash = clash.join(groups, ["digest", "text"]).select("doc_id", "digest", "file", "row", "keep", "n")
        out = join_spread(slim.join(mixed, "digest", "left_anti"), sized, ["digest"], "copies", total).select("doc_id", "digest", "file", "row", "keep", "n").unionByName(clash)
    else:
        out = join_spread(slim, sized, ["digest"], "copies", total)
    kept = (F.col("keep.file") == F.col("file")) & (F.col("keep.row") == F.col("row"))
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"), "digest")
