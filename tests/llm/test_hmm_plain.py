"""The hidden Markov language model against plain loops over words, states and places."""

import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import hmm_lm


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return out


def plain_counts(seq, model):
    """Expected counts of one sequence by unscaled forward and backward probabilities."""
    k, n = len(model.start), len(seq)
    f = [[model.start[s] * model.emit[seq[0], s] for s in range(k)]]
    for x in seq[1:]:
        f.append([sum(f[-1][r] * model.move[r, s] for r in range(k)) * model.emit[x, s] for s in range(k)])
    b = [[1.0] * k]
    for x in reversed(seq[1:]):
        b.insert(0, [sum(model.move[s, r] * model.emit[x, r] * b[0][r] for r in range(k)) for s in range(k)])
    whole = sum(f[-1])
    starts = np.array([f[0][s] * b[0][s] / whole for s in range(k)])
    moves, emits = np.zeros((k, k)), np.zeros_like(model.emit)
    for t in range(n):
        for s in range(k):
            emits[seq[t], s] += f[t][s] * b[t][s] / whole
            for r in range(k):
                if t + 1 < n:
                    moves[s, r] += f[t][s] * model.move[s, r] * model.emit[seq[t + 1], r] * b[t + 1][r] / whole
    return starts, moves, emits, math.log10(whole)


@pytest.mark.parametrize("segment", [1, 3, 7, 1024])
def test_counts_whatever_the_segments(segment):
    rng = np.random.default_rng(2)
    model = hmm_lm.initial(np.full(9, 1 / 9), 3)
    seqs = [rng.integers(0, 9, n).astype(np.int32) for n in (1, 2, 3, 6, 7, 8, 21, 22, 40, 40)]
    want = [sum(x) for x in list(zip(*[plain_counts(s, model) for s in seqs]))[:3]]
    for got, plain in zip(hmm_lm.expected_counts(seqs, model, segment), want):
        assert np.allclose(got, plain)
    assert np.allclose(hmm_lm.log_likelihoods(seqs, model), [plain_counts(s, model)[3] for s in seqs])


def test_scores_against_loops(spark, docs):
    rng = random.Random(6)
    words = ["The", "cat", "sat.", "DER", "hund", "é", "rare1", "x"]
    text = lambda: rng.choice(" \t\n").join(rng.choices(words, [9, 8, 7, 6, 2, 1, 0.4, 0.2], k=rng.randrange(1, 12)))
    rows = [(i, text()) for i in range(30)] + [(40, None), (2, ""), (3, "unseen The"), (5, "  cat")]
    got = hmm_lm.train_and_score(docs(rows), F.col("doc_id") < 20, vocabulary=5, states=2, rounds=2, sample_rounds=3).collect()

    trained = [plain_words(t) for d, t in rows if d < 20]
    counts = Counter(w for t in trained for w in t)
    total, types = sum(counts.values()) + len(trained), len(counts) + 1
    log2 = lambda n: math.floor(math.log2(n) * 16)
    least = min((log2(n) for n in counts.values() if sum(log2(m) >= log2(n) for m in counts.values()) <= 5), default=None)
    top = sorted((w for w in counts if least is not None and log2(counts[w]) >= least), key=lambda w: (-counts[w], w.encode()))
    assert top
    held = Counter({c: 1 for c in range(hmm_lm.CLASSES)})
    for w in counts:
        if w not in top:
            held[hmm_lm.word_class(w.encode())] += counts[w] + 1
    unigram = np.array([counts[w] + 1 for w in top] + [len(trained) + 1] + [held[c] for c in range(hmm_lm.CLASSES)], float)
    unigram /= unigram.sum()
    code = lambda w: top.index(w) if w in top else len(top) + 1 + hmm_lm.word_class(w.encode())
    model = hmm_lm.initial(unigram, 2)
    for _ in range(5):
        sums = [sum(x) for x in list(zip(*[plain_counts([code(w) for w in t] + [len(top)], model) for t in trained]))[:3]]
        model = hmm_lm.maximised(*sums, unigram)
    want = []
    for d, t in rows:
        t = plain_words(t)
        base = sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in t) + math.log10((len(trained) + 1) / (total + types + 1))
        rare = sum(math.log10((counts[w] + 1) / held[hmm_lm.word_class(w.encode())]) for w in t if w not in top)
        score = plain_counts([code(w) for w in t] + [len(top)], model)[3] + rare
        want.append((d, len(t) + 1, sum(w in counts for w in t) + 1, total, round(base, 6), round(score, 4)))
    assert sorted(want) == sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 4)) for r in got)


def test_every_round_sees_all_documents(spark, docs):
    """More documents than 1500: how the rounds are named makes no difference."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(["the", "cat", "sat", "der", "hund"], k=rng.randrange(1, 6)))) for i in range(2000)]
    table = docs(rows)
    learn = lambda **how: sorted((r.doc_id, r.score) for r in hmm_lm.train_and_score(table, F.col("doc_id") < 1900, vocabulary=4, states=2, **how).collect())
    one, two = learn(sample_rounds=3, rounds=2), learn(sample_rounds=0, rounds=5)
    assert len(one) == 2000 and np.allclose([s for _, s in one], [s for _, s in two], rtol=1e-9)


def test_frequent_words_are_bounded(spark):
    rows = [(bytes([65 + i]), n) for i, n in enumerate([90, 70, 70, 70, 8, 8, 1, 1, 1])]
    counts = spark.createDataFrame(rows, "word binary, n long").repartition(4)
    for most in range(11):
        got = [r.n for r in hmm_lm.frequent_words(counts, most)]
        assert got == [[], [90], [90], [90], [90, 70, 70, 70], [90, 70, 70, 70], [90, 70, 70, 70, 8, 8], [90, 70, 70, 70, 8, 8], [90, 70, 70, 70, 8, 8]][most] if most < 9 else len(got) == 9


def test_rare_words_share_their_class(spark, docs):
    """All words of a class, met or not, have no more than the class's probability together."""
    rows = [(i, "one two two three three three") for i in range(5)]
    got = hmm_lm.train_and_score(docs(rows + [(10, "one"), (11, "unmet"), (12, "")]), F.col("doc_id") < 5, vocabulary=1, states=2).collect()
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(10 ** r.score for r in got if r.doc_id >= 10) < 1


def test_memory_of_states_is_bounded():
    """Whatever the lengths, what a batch takes above its own size has a bound."""
    rng = np.random.default_rng(3)
    model = hmm_lm.initial(np.full(50, 1 / 50), 8)
    seqs = [rng.integers(0, 50, 700).astype(np.int32) for _ in range(1100)]
    for work in (hmm_lm.expected_counts, hmm_lm.log_likelihoods):
        tracemalloc.start()
        work(seqs, model)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80e6


def test_blocks_keep_their_size():
    """Symbols that nearly fix the state, and moves that are nearly impossible: no state is lost within a block."""
    move = np.array([[1 - 1e-12, 1e-12], [1e-12, 1 - 1e-12]])
    model = hmm_lm.Model(np.array([0.5, 0.5]), move, np.array([[1e-3, 1e-16], [1e-16, 1e-3], [1e-13, 1e-13]]))
    seqs = [np.array([0, 1] * n + [2] * 5, np.int32) for n in (1, 4, 8, 40)]
    want = []
    for seq in seqs:
        a, total = model.start * model.emit[seq[0]], 0.0
        for x in seq[1:]:
            total += math.log10(a.sum())
            a = (a / a.sum()) @ move * model.emit[x]
        want.append(total + math.log10(a.sum()))
    assert np.allclose(hmm_lm.log_likelihoods(seqs, model), want)
    starts, moves, emits = hmm_lm.expected_counts(seqs, model)
    symbols = sum(map(len, seqs))
    assert np.isclose(starts.sum(), 4) and np.isclose(moves.sum(), symbols - 4) and np.allclose(emits.sum(axis=1), np.bincount(np.concatenate(seqs)))
