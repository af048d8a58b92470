"""Words and symbols of the hidden Markov language model, made by Arrow, against plain loops over bytes."""

import random
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from strandline.llm import hmm_lm


def odd_texts():
    rng = random.Random(3)
    spaces, letters = b" \t\n\x0b\x0c\r", b"aAZz\xc3\xa9\xff\x00\x1c\x1f\x85\xa0"
    texts = [bytes(rng.choice(spaces + letters) for _ in range(rng.randrange(40))) for _ in range(400)]
    return [*texts, None, b"", b" ", b"\n\r", b" The the THE ", "é É  x".encode(), b"x" * 300, None]


def plain_words(text):
    out, word = [], b""
    for c in text or b"":
        if c in b" \t\n\x0b\x0c\r":
            out += [word] if word else []
            word = b""
        else:
            word += bytes([c + 32 if 65 <= c <= 90 else c])
    return out + ([word] if word else [])


@pytest.mark.parametrize("size", [1, 64, 1 << 20])
def test_encoded_as_by_loops(monkeypatch, size):
    """Whatever number of texts is split at once: symbols, sums of logarithms, and rare words in order."""
    monkeypatch.setattr(hmm_lm, "RUN_BYTES", size)
    monkeypatch.setattr(hmm_lm, "COUNT_BYTES", size)
    texts = odd_texts()
    counts = Counter(w for t in texts for w in plain_words(t))
    for most in (0, 5):
        top = [w for w, _ in counts.most_common(most)]
        known, classes = np.arange(most + 1) + 0.25, np.arange(hmm_lm.CLASSES) / 8
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([True] * len(texts)), pa.array(texts, pa.binary())], ["key", "trains", "text"])
        shared = SimpleNamespace(value=(top, most, known, classes))
        rows = [r for out in hmm_lm._encode(iter([batch.slice(0, 7), batch.slice(7), batch.slice(0, 0)]), shared) for r in out.to_pylist()]
        assert [r["key"] for r in rows] == list(range(len(texts)))
        for r, text in zip(rows, texts):
            words = plain_words(text)
            rare = [w for w in words if w not in top]
            symbols = [top.index(w) if w in top else most + 1 + hmm_lm.word_class(w) for w in words] + [most]
            assert np.frombuffer(r["symbols"], "<i4").tolist() == symbols and r["n_tokens"] == len(symbols) and r["n_rare"] == len(rare)
            assert np.isclose(r["known_log"], sum(known[s] for s in symbols if s <= most))
            assert np.isclose(r["class_log"], sum(classes[hmm_lm.word_class(w)] for w in rare))
            assert r["rare"] == rare
    got = Counter()
    for out in hmm_lm._count_words(iter([batch.select(["text"])])):
        for r in out.to_pylist():
            got[r["word"]] += r["n"]
    assert got == counts


def test_scoring_keeps_one_block():
    """Scoring needs the states of a block only, not of a whole segment."""
    rng = np.random.default_rng(3)
    model = hmm_lm.initial(np.full(50, 1 / 50), 8)
    seqs = [rng.integers(0, 50, 700).astype(np.int32) for _ in range(1100)]
    tracemalloc.start()
    hmm_lm.log_likelihoods(seqs, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6


def test_sums_leave_out_what_is_known(spark):
    """A task sends no sums of the last state, and the rounds go as with all sums."""
    rng = np.random.default_rng(4)
    unigram, numbers = np.full(600, 1 / 600), np.zeros(600)
    seqs = [rng.integers(0, 600, n).astype("<i4") for n in rng.integers(1, 60, 80)]
    for s in seqs:
        numbers += np.bincount(s, minlength=600)
    for states in (1, 3):
        start = hmm_lm.initial(unigram, states)
        batch = pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in seqs], pa.binary())], ["symbols"])
        (sent,) = hmm_lm._expect(iter([batch]), type("Shared", (), {"value": start}))
        assert sum(len(x.as_py()) for x in sent["sums"]) == 8 * (600 * (states - 1) + states * states + states)
        want = start
        for _ in range(4):
            want = hmm_lm.maximised(*hmm_lm.expected_counts(seqs, want), unigram)
        table = spark.createDataFrame([(bytes(s.tobytes()),) for s in seqs], "symbols binary").repartition(3)
        got = hmm_lm.baum_welch(table, start, unigram, numbers, 4)
        for a, b in ((got.start, want.start), (got.move, want.move), (got.emit, want.emit)):
            assert np.allclose(a, b, rtol=1e-9)
