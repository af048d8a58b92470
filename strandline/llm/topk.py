"""Exact top-k inner products by block-at-a-time pruning.

Vectors are put in order (by the nearest of a few centres fitted on a bounded
sample, which only makes blocks alike and has no part in the result) and cut
into range blocks. A block keeps the greatest and least value of each
component, and its vectors as a forward index. A query's bound for a block is
the sum over its components of the better of value x greatest and value x least:
no vector of the block scores higher.

Queries come in groups of bounded size, each broadcast to the blocks, which stay
where they are. A task takes its blocks by the window. For each query it puts
them in order of their bounds and scores them in rounds of growing size; after a
round the k-th score so far may have risen, and the query stops at the first
block whose bound is below it. A k-th score among the sampled vectors, which are
vectors of the table too, is what a query sets out with. Bounds that equal the
k-th score stay in, since ties go to the smaller id.

A task sends at most k rows for each query that a block of it could matter to.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.scratch import Scratch

BLOCK_ROWS = 256
#: Blocks that a task puts in order at once.
WINDOW_BLOCKS = 64
#: Bytes of the queries of a group, as 64-bit numbers.
GROUP_BYTES = 1 << 25
#: Queries that a task scores at once.
QUERY_ROWS = 512
CENTRES = 64
SAMPLE_ROWS = 8192
LEAST = -(2**63)


def integer_vectors(table: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(vec_id, v array<bigint>)``: floor(scale * x) in double arithmetic; unusable vectors are left out.

    Those are null vectors, and vectors with a null, NaN or infinite component.
    Components of 2**62 and more are not distinguished.
    """
    x = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists("x", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = F.transform("x", lambda x: F.floor(F.greatest(F.lit(-(2.0**62)), F.least(F.lit(2.0**62), x * float(scale)))).cast("bigint"))
    return table.select(F.col(id_col).cast("bigint").alias("vec_id"), x.alias("x")).filter("vec_id is not null and x is not null").filter(~bad).select("vec_id", v.alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of whole numbers as rows; shorter ones end in zeros."""
    out = np.zeros((len(column), width), np.int64)
    lengths = np.diff(column.offsets.to_numpy())
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: through floats only where these are exact."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    return (a.astype(kind) @ b.T.astype(kind)).astype(np.int64)


def fit_centres(sample: np.ndarray, centres: int, rounds: int = 8) -> np.ndarray:
    x = sample.astype(float)
    c = x[np.linspace(0, len(x) - 1, min(centres, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ c.T - 0.5 * (c * c).sum(axis=1)).argmax(axis=1)
        for i in np.unique(near):
            c[i] = x[near == i].mean(axis=0)
    return c


def _nearest(batches: Iterator[pa.RecordBatch], centres: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gain = _matrix(batch.column(1), width) @ centres.T - 0.5 * (centres * centres).sum(axis=1)
        nearest = [pa.array(gain.argmax(axis=1).astype(np.int64)), pa.array(gain.max(axis=1, initial=-np.inf))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *nearest], ["vec_id", "v", "centre", "gain"])


def _blocks(batches: Iterator[pa.RecordBatch], rows: int, width: int, kind: np.dtype) -> Iterator[pa.RecordBatch]:
    """Rows in order -> blocks of up to ``rows``: greatest and least values, ids and vectors as bytes."""
    ids, vectors = np.empty(0, np.int64), np.empty((0, width), np.int64)

    def out(i: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(i, kind="stable")
        values = [x.astype(kind).tobytes() for x in (v.max(axis=0), v.min(axis=0))]
        values += [i[order].tobytes(), v[order].astype(kind).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in values], ["most", "least", "ids", "vectors"])

    for batch in batches:
        ids = np.concatenate([ids, batch.column(0).to_numpy()])
        vectors = np.concatenate([vectors, _matrix(batch.column(1), width)])
        while len(ids) >= rows:
            yield out(ids[:rows], vectors[:rows])
            ids, vectors = ids[rows:], vectors[rows:]
    if len(ids):
        yield out(ids, vectors)


class Best:
    """The k best of each query so far, by score and then the smaller id, and the score that the next must reach."""

    def __init__(self, q_ids: np.ndarray, floors: np.ndarray, k: int) -> None:
        self.q_ids, self.floors, self.k = q_ids, floors.copy(), k
        self.rows, self.ids, self.scores = (np.empty(0, np.int64) for _ in range(3))
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Scores of the queries ``rows`` with the vectors ``ids``."""
        at, of = np.nonzero(score >= self.floors[rows][:, None])
        other = ids[of] != self.q_ids[rows[at]]
        at, of = at[other], of[other]
        self.new.append((rows[at], ids[of], score[at, of]))
        self.waiting += len(at)
        if self.waiting > 1 << 20:
            self.settle()

    def settle(self) -> None:
        """Keep the k best of each query, and raise its floor to the k-th."""
        parts = [(self.rows, self.ids, self.scores), *self.new]
        rows, ids, scores = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((ids, -scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.searchsorted(rows, rows)
        place = np.arange(len(rows)) - first
        keep = place < self.k
        full = place == self.k - 1
        self.floors[rows[full]] = np.maximum(self.floors[rows[full]], scores[full])
        self.rows, self.ids, self.scores = rows[keep], ids[keep], scores[keep]
        self.new, self.waiting = [], 0


def search(best: Best, queries: np.ndarray, window: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> int:
    """Take the blocks (greatest, least, ids, vectors) of a window into ``best``; gives the pairs of query and block that were scored."""
    most, least = (np.stack([b[i] for b in window]) for i in (0, 1))
    bound = _product(np.maximum(queries, 0), most) + _product(np.minimum(queries, 0), least)
    order = np.argsort(-bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    done, low, size = 0, 0, 1
    while low < len(window):
        ranks = order[:, low : low + size]
        wanted = bound[:, low : low + size] >= best.floors[:, None]
        if not wanted.any():
            break
        for at in np.unique(ranks[wanted]):
            rows = np.flatnonzero((wanted & (ranks == at)).any(axis=1))
            best.add(rows, window[at][2], _product(queries[rows], window[at][3]))
            done += len(rows)
        best.settle()
        low, size = low + size, 2 * size
    return done


def sample_floors(q_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, sample: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score among the sampled vectors other than itself."""
    if len(ids) <= k:
        return np.full(len(q_ids), LEAST)
    score = _product(queries, sample)
    score[q_ids[:, None] == ids] = LEAST
    return np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k]


def _search(batches: Iterator[pa.RecordBatch], shared, width: int, kind: np.dtype, k: int, window_blocks: int) -> Iterator[pa.RecordBatch]:
    q_ids, queries, s_ids, sample = shared.value
    chunks = [slice(a, a + QUERY_ROWS) for a in range(0, len(q_ids), QUERY_ROWS)]
    bests: list[Best] = []
    scored = blocks = 0
    window: list = []

    def take() -> int:
        if not bests:
            bests.extend(Best(q_ids[c], sample_floors(q_ids[c], queries[c], s_ids, sample, k), k) for c in chunks)
        return sum(search(b, queries[c], window) for b, c in zip(bests, chunks))

    for batch in batches:
        for most, least, ids, vectors in zip(*[batch.column(n) for n in ("most", "least", "ids", "vectors")]):
            one = [np.frombuffer(x.as_py(), kind).astype(np.int64) for x in (most, least)]
            rows = np.frombuffer(vectors.as_py(), kind).reshape(-1, width).astype(np.int64)
            window.append((*one, np.frombuffer(ids.as_py(), np.int64), rows))
            blocks += 1
            if len(window) == window_blocks:
                scored += take()
                window = []
    if window:
        scored += take()
    for b in bests:
        names = ["query_id", "vec_id", "score", "scored", "all"]
        zero = np.zeros(len(b.rows), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (b.q_ids[b.rows], b.ids, b.scores, zero, zero)], names)
    # One row says how much the task had to score.
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64())] * 3 + [pa.array([scored]), pa.array([blocks * len(q_ids)])], ["query_id", "vec_id", "score", "scored", "all"])


def _scores(table: DataFrame, queries: Column, scratch: Scratch, k: int, id_col: str, vector_col: str, scale: int, block_rows: int, window_blocks: int, sample_rows: int, group_bytes: int) -> list[DataFrame]:
    """For each group of queries a saved table: query_id, vec_id, score, and in one row a task scored and all (pairs of query and block)."""
    sc = table.sparkSession.sparkContext
    vectors = integer_vectors(table, id_col, vector_col, scale).groupBy("vec_id").agg(F.max("v").alias("v"))
    vectors = scratch.save(vectors, "vectors")
    biggest = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    count, asked, width, biggest = vectors.agg(F.count("*"), F.count_if(queries), F.max(F.size("v")), biggest).first()
    if not asked:
        return []
    width, biggest = max(1, width), biggest or 0
    kind = np.dtype(np.int16 if biggest < 2**15 else np.int32 if biggest < 2**31 else np.int64)

    def gathered(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        got = rows.select("vec_id", "v").toArrow().combine_chunks()
        columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in got.columns]
        return columns[0].to_numpy(), _matrix(columns[1], width)

    share = min(1.0, sample_rows / count)
    s_ids, sample = gathered(vectors.filter(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))))
    centres = fit_centres(sample, CENTRES) if len(sample) else np.zeros((1, width))
    placed = vectors.mapInArrow(lambda it: _nearest(it, centres, width), "vec_id long, v array<bigint>, centre long, gain double")
    placed = placed.repartitionByRange("centre", "gain", "vec_id").sortWithinPartitions("centre", "gain", "vec_id").select("vec_id", "v")
    blocks = placed.mapInArrow(lambda it: _blocks(it, block_rows, width, kind), "most binary, least binary, ids binary, vectors binary")
    blocks = scratch.save(blocks, "blocks")

    groups = -(-asked * width * 8 // group_bytes)
    group, out = F.pmod(F.xxhash64("vec_id", F.lit("group")), F.lit(groups)), []
    for g in range(groups):
        q_ids, q = gathered(vectors.filter(queries).filter(group == g))
        shared = sc.broadcast((q_ids, q, s_ids, sample))
        found = blocks.mapInArrow(lambda it, shared=shared: _search(it, shared, width, kind, k, window_blocks), "query_id long, vec_id long, score long, scored long, all long")
        out.append(scratch.save(found, f"group{g}"))
        shared.unpersist()
    return out


def exact_top_k(
    table: DataFrame,
    queries: Column,
    *,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 64,
    block_rows: int = BLOCK_ROWS,
    window_blocks: int = WINDOW_BLOCKS,
    sample_rows: int = SAMPLE_ROWS,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """Of ``table(vec_id, embedding, ...)``: query_id, rank, vec_id, score, scored_share for the rows where ``queries`` (on vec_id) holds.

    Each query gets its k highest inner products with every other row, ties to
    the smaller vec_id, or all if there are fewer. Unusable vectors take no part
    (``integer_vectors``); missing components of shorter vectors count 0. Rows
    that repeat a vec_id count once, with the greatest vector. Empty tables, or
    no queries, give no rows. scored_share tells, for the group of queries,
    which share of the pairs of query and block the bounds left to be scored.
    """
    scratch, out = Scratch(table.sparkSession, "top-k"), None
    for found in _scores(table, queries, scratch, k, id_col, vector_col, scale, block_rows, window_blocks, sample_rows, group_bytes):
        share = found.agg((F.sum("scored") / F.sum("all")).alias("share")).first()["share"]
        found = found.filter("query_id is not null").select("query_id", "vec_id", "score", F.lit(share).cast("double").alias("scored_share"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long, scored_share double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "scored_share")
