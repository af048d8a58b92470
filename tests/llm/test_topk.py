import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm.topk import exact_top_k


def brute_force(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            w = [int(np.floor(64 * float(np.float32(x)))) for x in v]
            good[i] = max(good.get(i, w), w)
    out = []
    for q in good:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("size, scale", [(700, 1), (60, 1e4), (15, 1)])
def test_against_all_scores(spark, size, scale):
    rng = random.Random(size)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [scale * (c + rng.gauss(0, 0.2)) for c in rng.choice(centres)]) for i in range(size)]
    rows += [(1000, None), (1020, [float("nan")] * 8), (1040, [float("inf")] + [0.0] * 7), (1060, [0.0] * 8), (1080, [0.0] * 8), (1081, rows[0][1]), (1082, rows[0][1]), (1100, [1.0, -1.0]), (1120, []), (None, [1.0] * 8), (1140, [None] * 8), (0, rows[0][1])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("v", F.lit(1)).withColumn("block", F.lit(2))
    got = exact_top_k(table, F.col("vec_id") % 20 == 0, block_rows=16, window_blocks=3, sample_rows=40, group_bytes=640)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute_force(rows, 20)


def test_empty(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_top_k(table, F.col("vec_id") % 20 == 0).count() == 0


def test_blocks_are_ruled_out(spark):
    """On planted clusters under a quarter of the pairs of query and block are scored, with the same rows."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (40, 16))
    rows = [(i, [float(x) for x in centres[i % 40] * 4 + rng.normal(0, 0.1, 16)]) for i in range(8000)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = exact_top_k(table, F.col("vec_id") % 400 == 0, block_rows=64).collect()
    assert 0 < got[0].scored_share < 0.25
    v = np.floor(64 * np.array([x for _, x in rows], np.float32).astype(float)).astype(np.int64)
    want = []
    for q in range(0, 8000, 400):
        best = sorted((-int(v[q] @ v[c]), c) for c in range(8000) if c != q)[:20]
        want += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    assert sorted(tuple(r)[:4] for r in got) == want
