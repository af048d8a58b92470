"""Covering locality-sensitive hashing of 64-bit fingerprints.

Every bit position i gets a non-zero vector phi(i) of GF(2)^(r+1). Table v (any
non-zero vector) keeps the bits with <phi(i), v> = 1. For r or fewer differing
positions the r equations <phi(i), v> = 0 in r + 1 unknowns have a non-zero
solution, and in that table the differing bits are all masked out: the pair
collides for certain (Pagh, "CoveringLSH", 2016).

A bucket with more than ``bucket_rows`` different fingerprints is split by a
second and third covering family over the bits that the first has masked out.
After three levels at most 2**9 fingerprints can share a bucket, so no bucket
is ever large and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.scratch import Scratch

RADIUS = 3
BUCKET_ROWS = 2048


def _span(bits: list[int], radius: int) -> list[list[int]]:
    """For each table of a covering family over ``bits``: the bits that it keeps."""
    k = radius + 1
    phi = {b: i % (2**k - 1) + 1 for i, b in enumerate(bits)}
    return [[b for b in bits if bin(phi[b] & v).count("1") % 2] for v in range(1, 2**k)]


def covering_masks(level: int, radius: int = RADIUS) -> list[int]:
    """Masks of all paths of ``level`` nested families, as signed 64-bit numbers."""
    paths: list[tuple[int, list[int]]] = [(0, list(range(64)))]
    for _ in range(level):
        paths = [(mask | sum(1 << b for b in kept), [b for b in rest if b not in set(kept)]) for mask, rest in paths for kept in _span(rest, radius)]
    return [m - (1 << 64) if m >> 63 else m for m, _ in paths]


def _stars(batches: Iterator[pa.RecordBatch], radius: int, trees: bool) -> Iterator[pa.RecordBatch]:
    """Rows (path, key, fp) with equal buckets in a row -> links from each class's first fingerprint, or with ``trees`` from the one that a fingerprint is near.

    Within a bucket a breadth-first search compares fingerprints in whole
    arrays; a class of n gives n - 1 links, not all its pairs.
    """
    us: list[int] = []
    vs: list[int] = []

    def close(fps: np.ndarray) -> None:
        left = np.unique(fps)
        while len(left) > 1:
            seed, front, left = left[0], left[:1], left[1:]
            while len(front) and len(left):
                near, parents = np.zeros(len(left), bool), np.full(len(left), seed)
                for at in range(0, len(front), 256):
                    found = np.bitwise_count(front[at : at + 256, None] ^ left[None, :]) <= radius
                    new = found.any(axis=0) & ~near
                    if trees:
                        parents[new] = front[at + found[:, new].argmax(axis=0)]
                    near |= new
                us.extend(parents[near].tolist())
                front, left = left[near], left[~near]
                vs.extend(front.tolist())

    kept: list[np.ndarray] = []
    last: tuple | None = None
    for batch in batches:
        path, key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        if not len(fp):
            continue
        fp = fp.view(np.uint64)
        cuts = np.flatnonzero((path[1:] != path[:-1]) | (key[1:] != key[:-1])) + 1
        for part, start in zip(np.split(fp, cuts), [0, *cuts.tolist()]):
            bucket = (path[start], key[start])
            if bucket != last and kept:
                close(np.concatenate(kept))
                kept = []
            last = bucket
            kept.append(part)
        if us:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)], ["u", "v"])
            us.clear()
            vs.clear()
    if kept:
        close(np.concatenate(kept))
    if us:
        yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (us, vs)], ["u", "v"])


def hamming_links(nodes: DataFrame, scratch: Scratch, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, trees: bool = False) -> DataFrame:
    """Distinct ``nodes(fp)`` -> ``(u, v)``: links whose components are those of all pairs within ``radius``; with ``trees`` each is such a pair."""
    tables, links, rows = 2 ** (radius + 1) - 1, None, nodes.select(F.lit(0).alias("path"), "fp")
    for level in (1, 2, 3):
        masks = F.lit(covering_masks(level, radius))
        rows = rows.select(F.explode(F.sequence(F.col("path") * tables, F.col("path") * tables + tables - 1)).alias("path"), "fp")
        rows = rows.select("path", F.element_at(masks, F.col("path") + 1).bitwiseAND(F.col("fp")).alias("key"), "fp")
        sizes = rows.groupBy("path", "key").agg(F.count("*").alias("size")).filter("size > 1")
        shared = scratch.save(rows.join(sizes, ["path", "key"]), f"buckets{level}")
        small = shared if level == 3 else shared.filter(F.col("size") <= bucket_rows)
        found = small.select("path", "key", "fp").repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(lambda it: _stars(it, radius, trees), "u long, v long")
        links = found if links is None else links.unionByName(found)
        rows = shared.filter(F.col("size") > bucket_rows).select("path", "fp")
        if level == 3 or rows.isEmpty():
            break
    return links
