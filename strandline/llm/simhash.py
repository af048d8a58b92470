"""SimHash near-duplicates through covering locality-sensitive hashing (``covering``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.covering import BUCKET_ROWS, RADIUS, covering_masks, hamming_links  # noqa: F401
from strandline.llm.graph import components
from strandline.llm.scratch import Scratch
from strandline.llm.similar import SHINGLE, SIMILARITY, similar_nodes
from strandline.llm.spread import join_spread
from strandline.llm.words import word_runs


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit set, lowest bit first."""
    bits = np.unpackbits(hashes.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """SimHash of the XXH64 (seed 42) of every word shingle; 0 for a text without words."""
    digest, ones, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0
    for run in word_runs(text or b"", shingle - 1):
        if shingle == 3 and len(run) >= 3:
            hashes = [digest(b"%b %b %b" % g, 42) for g in zip(run, run[1:], run[2:])]
        else:
            hashes = [digest(b" ".join(run[i : i + shingle]), 42) for i in range(max(1, len(run) - shingle + 1))]
        n += len(hashes)
        ones += bit_counts(np.array(hashes, np.uint64))
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def _fingerprints(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps.view(np.int64))], ["doc_id", "text_key", "fp"])


def simhash_groups(docs: DataFrame, **how) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, fp long, component_id)``, one row for each input row.

    A null text counts as empty; texts without words have fingerprint 0 and link
    like any others. Texts with fewer words than a shingle are one shingle.
    Repeated rows stay repeated. A null doc_id keeps its row and never is a
    component's id, unless all of the component's are null.
    """
    return _groups(docs, **how).drop("text_key", "root")


def _groups(docs: DataFrame, *, shingle: int = 3, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """As ``simhash_groups``, with ``text_key``, a hash of the text, and ``root``, the component."""
    scratch = Scratch(docs.sparkSession, "simhash")
    slim = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    fps = scratch.save(slim.mapInArrow(lambda it: _fingerprints(it, shingle), slim.schema["doc_id"].dataType.simpleString().join(["doc_id ", ", text_key long, fp long"])), "fingerprints")
    nodes = scratch.save(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "nodes")
    roots = components(hamming_links(nodes, scratch, radius, bucket_rows), scratch)
    member = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first_id", "copies", F.coalesce("v", "fp").alias("root"))
    least = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = member.join(least, "root").select("fp", "copies", "component_id", "root")
    return join_spread(fps, named, ["fp"], "copies", fps.count()).select("doc_id", "text_key", "fp", "component_id", "root")


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``groups(doc_id, text_key, root)`` for all rows of ``docs`` -> one row for each root: the smallest doc_id, null ones last, then text_key."""
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("at"))
    # Equal structs may hold nulls. One key of one type for both steps, so whole texts are shuffled once.
    first = first.select(F.struct(F.col("at.doc_id").alias("id"), F.col("at.text_key").alias("key")).alias("own"))
    own = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key")).cast(first.schema["own"].dataType)
    rows = docs.select(F.struct("*").alias("row"), own.alias("own"))
    # What is left under one id and text is one text, and a single row of it is enough.
    return rows.join(first, "own", "left_semi").dropDuplicates(["own"]).select("row.*")


def keep_one(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float | None = SIMILARITY, **how) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the smallest doc_id stays.

    Texts are linked at a shingle similarity of ``similarity`` or more, or, if it
    is None, by fingerprints as in ``simhash_groups``. Columns stay as they are.
    Each component keeps exactly one row, whether its doc_id is null or is
    another text's too. Texts without words are one component.
    """
    if similarity is None:
        return one_of_each(docs, _groups(docs, shingle=shingle, **how))
    return one_of_each(docs, similar_nodes(docs, shingle=shingle, similarity=similarity))
