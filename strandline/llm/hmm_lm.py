"""A hidden Markov language model.

Symbols are the ``vocabulary`` most frequent words of the training documents,
an end symbol, and classes of rarer words by their last letters. Latent states
emit symbols; a rare or unknown word w of class C has the probability of C in
the state times (c(w) + 1) / (N_C + V_C + 1), with the counts of all training
documents. Every round of Baum-Welch goes over all training documents: each task
sums the expected counts of its documents, and Spark sums them across tasks, of
which there is one per core, whatever the size of the data. Scoring is the scaled forward
recursion over the whole text.

Documents are whole in training too. Of a group of documents, the forward states are
kept where a segment of ``SEGMENT_CELLS`` symbols begins; the backward pass goes through
the segments from the last, computes the forward states of one anew, and hands its
own state on. So a worker's memory for states is bounded, whatever the lengths.

Each document is encoded once, into a saved table. What reaches the driver has
a size given by parameters, whatever the number of partitions: vocabulary x
(states - 1) numbers a round, as the expected counts of a symbol in all states sum
to its count, which is known. Counts of rare words stay in Spark and are joined by
word, summed per document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.scratch import Scratch
from strandline.llm.words import RUN_BYTES

VOCABULARY = 1 << 16
STATES = 8
CLASSES = 512
SUFFIX = 3
#: Rounds of Baum-Welch, all of them over all training documents; the first ten once saw a sample.
SAMPLE_ROUNDS = 10
ROUNDS = 2
#: Tasks a core of a round, since each sends its own sums for every symbol.
CORE_TASKS = 1
#: Rows of a block of sums; a core's worth of blocks with one number meet in one task.
BLOCK_SYMBOLS = 256
#: Times between the forward states that are kept, at most, and symbols of all documents of a group in between.
SEGMENT = 1 << 16
SEGMENT_CELLS = 1 << 18
#: Times between two scalings.
BLOCK = 16
PRIOR = 200.0
#: Bytes of text whose words are counted at once.
COUNT_BYTES = 1 << 22
GROUP_DOCS = 512


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit  # (K,), (K, K), (symbols, K)


def word_class(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX:]) % CLASSES


def _groups(seqs: list[np.ndarray], cells: int = 1 << 22) -> Iterator[np.ndarray]:
    """Indices of sequences of like length, longest first, a bounded number of cells at once."""
    order = np.argsort([-len(s) for s in seqs], kind="stable")
    at = 0
    while at < len(order):
        longest = max(1, len(seqs[order[at]]))
        size = max(1, min(GROUP_DOCS, cells // longest))
        yield order[at : at + size]
        at += size


class _Group:
    """Documents of like length, longest first, and their time in segments of blocks.

    A block has up to ``BLOCK`` times of all documents alive at its first; those
    that end within go on with symbol 0, which no sum sees. A segment has up to
    ``segment`` times and, where a block is smaller, ``SEGMENT_CELLS`` symbols.
    """

    def __init__(self, seqs: list[np.ndarray], segment: int) -> None:
        lengths = np.array([len(s) for s in seqs])
        self.symbols = np.zeros((len(seqs), lengths[0]), np.int32)
        for row, seq in zip(self.symbols, seqs):
            row[: len(seq)] = seq
        times = np.arange(1, lengths[0] + 2)
        #: How many documents are alive at each time, and none after the last.
        self.alive = (len(seqs) - np.searchsorted(lengths[::-1], times, side="left")).tolist()
        self.segments: list[list[tuple[int, int, int]]] = []  # blocks: first time, times, documents
        low, steps, cells = 0, segment, 0
        while low < lengths[0]:
            if steps >= segment or cells + BLOCK * self.alive[low] > SEGMENT_CELLS:
                self.segments.append([])
                steps = cells = 0
            size = int(min(BLOCK, segment - steps, lengths[0] - low))
            self.segments[-1].append((low, size, self.alive[low]))
            low, steps, cells = low + size, steps + size, cells + size * self.alive[low]

    def ids(self, blocks: list[tuple[int, int, int]]) -> np.ndarray:
        """The symbols of a segment, block by block, time by document."""
        return np.concatenate([self.symbols[:n, low : low + size].T.ravel() for low, size, n in blocks]).astype(np.intp)


class _Steps:
    """Scaled forward states of one segment after another, in memory that is taken once.

    Emissions are divided by a symbol's greatest over the states, which changes
    no expected count, so that states keep their size over the times of a block;
    they are scaled to a sum of one where a block begins.
    """

    def __init__(self, model: Model) -> None:
        self.model = model
        self.greatest = model.emit.max(axis=1)
        self.emit = model.emit / self.greatest[:, None]
        self.seen = self.states = np.empty((0, len(model.start)))

    def forward(self, blocks: list[tuple[int, int, int]], ids: np.ndarray, a: np.ndarray | None, keep: bool = True) -> Iterator[tuple]:
        """From ``a``, the states before: the scale and the scaled states before each block, emissions and states in it.

        Unless told to ``keep`` them, a block's emissions and states last until the next, and stay in the processor's cache.
        """
        most = len(ids) if keep else max(size * n for _, size, n in blocks)
        if most > len(self.seen):
            self.seen, self.states = (np.empty((most, len(self.model.start))) for _ in range(2))
        at = to = 0
        for _, size, n in blocks:
            scale = None
            if a is not None:
                scale = a[:n].sum(axis=1, keepdims=True)
                a = a[:n] / scale
            before = a
            np.take(self.emit, ids[at : at + size * n], axis=0, out=self.seen[to : to + size * n], mode="clip")
            seen, states = (x[to : to + size * n].reshape(size, n, -1) for x in (self.seen, self.states))
            for now, by in zip(states, seen):
                if a is None:
                    np.multiply(self.model.start, by, out=now)
                else:
                    np.matmul(a, self.model.move, out=now)
                    now *= by
                a = now
            yield scale, before, seen, states
            at += size * n
            to = at if keep else 0


def log_likelihoods(seqs: list[np.ndarray], model: Model, segment: int = SEGMENT) -> np.ndarray:
    """log10 probability of each sequence, by the scaled forward recursion."""
    out = np.zeros(len(seqs))
    steps = _Steps(model)
    logs = np.log10(steps.greatest)
    for order in _groups(seqs):
        group, a = _Group([seqs[i] for i in order], segment), None
        total = np.array([logs[seqs[i]].sum() for i in order])
        for blocks in group.segments:
            for (low, size, n), (scale, _, _, states) in zip(blocks, steps.forward(blocks, group.ids(blocks), a, keep=False)):
                if scale is not None:
                    total[:n] += np.log10(scale[:, 0])
                for t in range(size):
                    if (stay := group.alive[low + t + 1]) < (end := group.alive[low + t]):
                        total[stay:end] += np.log10(states[t, stay:end].sum(axis=1))
                a = states[-1].copy()
        out[order] = total
    return out


def expected_counts(seqs: list[np.ndarray], model: Model, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch: expected starts (K,), moves (K, K) and emissions (symbols, K)."""
    k = len(model.start)
    starts, moves, emits = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.T.shape)
    steps, backward = _Steps(model), np.ascontiguousarray(model.move.T)
    # Memory that is taken once: weights of a segment, and of a block what follows its symbols and its states.
    weights, rights, afters = (np.empty(0) for _ in range(3))
    for order in _groups(seqs):
        group = _Group([seqs[i] for i in order], segment)
        edges: list[np.ndarray | None] = [None]
        for blocks in group.segments[:-1]:
            for *_, states in steps.forward(blocks, group.ids(blocks), edges[-1], keep=False):
                pass
            edges.append(states[-1].copy())
        # What follows a time, given the state in it; of a document that has ended, zero.
        back = np.zeros((len(order), k))
        for i in range(len(group.segments) - 1, -1, -1):
            blocks = group.segments[i]
            ids = group.ids(blocks)
            done = list(steps.forward(blocks, ids, edges[i]))
            if k * len(ids) > len(weights):
                weights = np.empty(k * len(ids))
            weight, at = weights[: k * len(ids)].reshape(k, -1), len(ids)
            for (low, size, n), (scale, before, seen, states) in zip(reversed(blocks), reversed(done)):
                if seen.size > len(rights):
                    rights, afters = np.empty(seen.size), np.empty(seen.size)
                right, after = (x[: seen.size].reshape(seen.shape) for x in (rights, afters))
                after[-1] = now = back[:n]
                for t in range(size - 1, -1, -1):
                    if (stay := group.alive[low + t + 1]) < (end := group.alive[low + t]):
                        after[t, stay:end] = 1 / states[t, stay:end].sum(axis=1, keepdims=True)
                    np.multiply(seen[t], after[t], out=right[t])
                    np.matmul(right[t], backward, out=after[t - 1] if t else now)
                np.multiply(states, after, out=seen)  # the probability of each state
                if size > 1:
                    moves += model.move * (states[:-1].reshape(-1, k).T @ right[1:].reshape(-1, k))
                if before is None:
                    starts += seen[0].sum(axis=0)
                else:
                    moves += model.move * (before.T @ right[0])
                    now /= scale
                weight[:, at - size * n : at] = seen.reshape(-1, k).T
                at -= size * n
            for s in range(k):
                emits[s] += np.bincount(ids, weight[s], emits.shape[1])
    return starts, moves, np.ascontiguousarray(emits.T)


def maximised(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, unigram: np.ndarray) -> Model:
    """The M step; emissions have a prior of ``PRIOR`` observations spread like the unigrams."""
    emit = emits + PRIOR * unigram[:, None]
    return Model((starts + 0.1) / (starts + 0.1).sum(), (moves + 0.1) / (moves + 0.1).sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def initial(unigram: np.ndarray, states: int, seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    emit = unigram[:, None] * np.exp(rng.normal(0, 1, (len(unigram), states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(axis=0))


def _word_arrays(texts: pa.Array, size: int) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """Words of rows low to high, as one array, and how many each row has; rows of ``size`` bytes at once, one at least.

    Arrow's kernels part at the same six bytes as ``bytes.split`` and change A-Z
    alone, but leave an empty word where a text begins or ends with one of them.
    """
    texts = texts.cast(pa.binary()).fill_null(b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + size, side="right")))
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.slice(low, high - low).view(pa.string())))
        words, lengths = lists.flatten(), pc.list_value_length(lists).to_numpy()
        del lists
        empty = np.flatnonzero(pc.equal(words, "").to_numpy(zero_copy_only=False))
        if len(empty):
            lengths = lengths - np.bincount(np.searchsorted(np.cumsum(lengths), empty, side="right"), minlength=high - low)
            words = words.filter(pc.not_equal(words, ""))
        yield low, high, words.view(pa.binary()), lengths
        low = high


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, words, _ in _word_arrays(batch.column(0), COUNT_BYTES):
            counts = words.value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])
    pa.default_memory_pool().release_unused()


def _word_classes(words: pa.Array) -> np.ndarray:
    """``word_class`` of each word."""
    suffixes = pc.binary_slice(words, -SUFFIX).dictionary_encode()
    classes = np.array([word_class(w) for w in suffixes.dictionary.to_pylist()], np.int32)
    return classes[suffixes.indices.to_numpy()]


def _encode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(key, trains, text) -> the symbols, and what the known counts give already."""
    frequent, end, known_log, class_log = shared.value
    frequent = pa.array(frequent, pa.binary())
    for batch in batches:
        for low, high, words, lengths in _word_arrays(batch.column(2), RUN_BYTES):
            n = high - low
            rows = np.repeat(np.arange(n), lengths)
            ids = pc.index_in(words, value_set=frequent).fill_null(-1).to_numpy(zero_copy_only=False).copy()
            known = ids >= 0
            rare, rare_rows = words.filter(pa.array(~known)), rows[~known]
            classes = _word_classes(rare)
            ids[~known] = end + 1 + classes
            known_logs = np.bincount(rows[known], known_log[ids[known]], n) + known_log[end]
            class_logs = np.bincount(rare_rows, class_log[classes], n)

            # A row's symbols are followed by its end.
            lengths = lengths + 1
            symbols = np.full(len(ids) + n, end, "<i4")
            symbols[np.arange(len(ids)) + rows] = ids
            texts = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(_offsets(lengths * 4)), pa.py_buffer(symbols)])

            n_rare = np.bincount(rare_rows, minlength=n)
            rare = pa.ListArray.from_arrays(pa.array(_offsets(n_rare)), rare)
            numbers = [pa.array(lengths, pa.int64()), pa.array(n_rare, pa.int64()), pa.array(known_logs), pa.array(class_logs)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(low, n) for i in range(2)], *numbers, texts, rare], schema=_ENCODED)


def _offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)


_ENCODED = pa.schema([("key", pa.int64()), ("trains", pa.bool_()), ("n_tokens", pa.int64()), ("n_rare", pa.int64()), ("known_log", pa.float64()), ("class_log", pa.float64()), ("symbols", pa.binary()), ("rare", pa.list_(pa.binary()))])


def _sequences(batch: pa.RecordBatch, name: str = "symbols") -> list[np.ndarray]:
    return [np.frombuffer(s.as_py(), "<i4") for s in batch.column(batch.schema.get_field_index(name))]


SUMS = "block int, sums binary"


def _expect(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """Expected counts of a task's documents, a row for each of emissions, moves and the start, in blocks of ``BLOCK_SYMBOLS`` rows.

    Emissions come without the last state's: a symbol's sum over the states is its number.
    """
    model: Model = shared.value
    sums = None
    for batch in batches:
        got = expected_counts(_sequences(batch), model)
        sums = got if sums is None else tuple(a + b for a, b in zip(sums, got))
    if sums is not None:
        starts, moves, emits = sums
        blocks = [table[at : at + BLOCK_SYMBOLS].astype("<f8").tobytes() for table in (emits[:, :-1], np.vstack([moves, starts])) for at in range(0, len(table), BLOCK_SYMBOLS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["block", "sums"])


def _summed(group: pa.Table) -> pa.Table:
    """A block's sums over tasks, of which there is one a core."""
    total = sum(np.frombuffer(x.as_py(), "<f8") for x in group["sums"])
    return pa.table([group["block"][:1], pa.array([total.tobytes()], pa.binary())], names=["block", "sums"])


def _forward(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log_likelihoods(_sequences(batch), shared.value))], ["key", "log_symbols"])


def frequent_words(counts: DataFrame, most: int) -> list:
    """Rows of ``counts(word, n)`` with the highest n: as many as ``most`` at most, equal ones all or none.

    The least n comes from a histogram of logarithms, so no more than ``most``
    rows leave the executors, whatever the number of partitions.
    """
    step = F.floor(F.log2("n") * 16).cast("int")
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()
    taken, least = 0, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        taken += r["words"]
        if taken > most:
            break
        least = r["step"]
    return [] if least is None else sorted(counts.filter(step >= least).collect(), key=lambda r: (-r["n"], bytes(r["word"])))


def baum_welch(encoded: DataFrame, model: Model, unigram: np.ndarray, numbers: np.ndarray, rounds: int) -> Model:
    """``rounds`` rounds over all rows of ``encoded(symbols)``, which hold each symbol ``numbers`` times."""
    sc, states = encoded.sparkSession.sparkContext, len(model.start)
    for _ in range(rounds):
        now = sc.broadcast(model)
        sums = encoded.select("symbols").mapInArrow(lambda it, now=now: _expect(it, now), SUMS)
        got = sums.groupBy("block").applyInArrow(_summed, SUMS).toArrow().sort_by("block")
        emits, moves, starts = np.split(np.frombuffer(b"".join(x.as_py() for x in got["sums"]), "<f8"), np.cumsum([len(numbers) * (states - 1), states * states]))
        emits = emits.reshape(len(numbers), states - 1)
        # Rounding may leave a little less than nothing.
        last = np.maximum(numbers - emits.sum(axis=1), 0.0)
        model = maximised(starts, moves.reshape(states, states), np.column_stack([emits, last]), unigram)
        now.unpersist()
    return model


def train_and_score(
    docs: DataFrame,
    trains,
    *,
    vocabulary: int = VOCABULARY,
    states: int = STATES,
    rounds: int = ROUNDS,
    sample_rounds: int = SAMPLE_ROUNDS,
) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, trains, n_tokens, n_known, train_tokens, base_score, score.

    ``trains`` is a condition on doc_id: the documents to learn from. Tokens are
    a text's words and one end; base_score is the add-one unigram model's log10
    probability, score the hidden Markov model's. Null texts count as empty,
    very long ones are read whole. Repeated rows count, and are scored, each by
    itself. Without training documents all words are unknown. An empty table
    gives no rows. The model has ``sample_rounds`` + ``rounds`` rounds over all
    documents to learn from; the two names are left from when the first saw a sample.
    """
    scratch = Scratch(docs.sparkSession, "hmm")
    sc = docs.sparkSession.sparkContext
    slim = docs.select("doc_id", F.coalesce(trains, F.lit(False)).alias("trains"), F.col("text").cast("binary").alias("text"))
    words = slim.filter("trains").select("text").mapInArrow(_count_words, "word binary, n long")
    counts = scratch.save(words.groupBy("word").agg(F.sum("n").alias("n")), "counts")
    ends = slim.filter("trains").count()
    total, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, types = total + ends, types + (ends > 0)
    norm = total + types + 1

    top = frequent_words(counts, vocabulary)
    top_counts = np.array([r["n"] for r in top] + [ends], float)
    frequent, end = [bytes(r["word"]) for r in top], len(top)
    # What the frequent words leave of each class, without a second look at them.
    suffix = F.crc32(F.expr(f"substring(word, -{SUFFIX}, {SUFFIX})")) % CLASSES
    of_class = np.zeros((2, CLASSES))
    for r in counts.groupBy(suffix.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        of_class[:, r["c"]] = r["n"], r["v"]
    for r, word in zip(top, frequent):
        of_class[:, word_class(word)] -= r["n"], 1
    class_norm = of_class.sum(axis=0) + 1
    numbers = np.concatenate([top_counts, of_class[0]])
    unigram = np.concatenate([top_counts + 1, class_norm])
    unigram /= unigram.sum()

    shared = sc.broadcast((frequent, end, np.log10(top_counts + 1), np.log10(class_norm)))
    keyed = slim.select(F.monotonically_increasing_id().alias("key"), "*")
    encoded_type = "key long, trains boolean, n_tokens long, n_rare long, known_log double, class_log double, symbols binary, rare array<binary>"
    kind = docs.schema["doc_id"].dataType.simpleString()

    def with_id(batches):
        for batch in batches:
            rest = batch.select(["key", "trains", "text"])
            at = 0
            for out in _encode(iter([rest]), shared):
                yield pa.RecordBatch.from_arrays([*out.columns, batch.column("doc_id").slice(at, len(out))], [*out.schema.names, "doc_id"])
                at += len(out)

    encoded = scratch.save(keyed.mapInArrow(with_id, f"{encoded_type}, doc_id {kind}"), "encoded")

    model = initial(unigram, states)
    if ends:
        learn = encoded.filter("trains").select("symbols").coalesce(CORE_TASKS * sc.defaultParallelism)
        model = baum_welch(learn, model, unigram, numbers, sample_rounds + rounds)

    # Rare words are joined with the counts of all, and summed by document.
    joined = encoded.select("key", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = joined.groupBy("key").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("rare_log"), F.count_if(F.col("n").isNull()).alias("unknown"))
    final = sc.broadcast(model)
    scores = encoded.select("key", "symbols").mapInArrow(lambda it: _forward(it, final), "key long, log_symbols double")
    rows = encoded.drop("symbols", "rare").join(scores, "key").join(rare, "key", "left")
    rare_log, unknown = F.coalesce("rare_log", F.lit(0.0)), F.coalesce("unknown", F.lit(0)) + (F.lit(0) if ends else F.lit(1))
    base = F.col("known_log") + rare_log - F.col("n_tokens") * float(np.log10(norm))
    return rows.select("doc_id", "trains", "n_tokens", (F.col("n_tokens") - unknown).cast("long").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (F.col("log_symbols") + rare_log - F.col("class_log")).alias("score"))
