"""Toxicity by multiple-instance learning.

Labels are of documents, offences of sentences. A sentence's probability is a
logistic function of its words and word beginnings; a document's is the
noisy-or of its sentences, 1 - prod(1 - p). Training on document labels alone
pushes the blame to the sentences that tell toxic documents from others, and
the same sentence scores locate the offence afterwards.

The classifier is fitted on a bounded sample of labelled rows. Scoring is one
narrow pass over whole texts with a model of at most ``features`` weights.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.scratch import Scratch

#: Bounds of the sample: rows of each label, and the length of a text taken into it.
SAMPLE_ROWS = 4000
SAMPLE_CHARS = 200_000
FEATURES = 4096
PREFIXES = (4, 5, 6)
_SENTENCE = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"\w+")
KNOWN_WORDS = 200_000


def features_of(word: str) -> list[str]:
    """A word and its beginnings, which inflected forms share."""
    return [word, *(f"{n}:{word[:n]}" for n in PREFIXES if len(word) >= n)]


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each part between full stops, marks and line ends that has a word."""
    out, at = [], 0
    for m in _SENTENCE.finditer(text):
        if _WORD.search(text, at, m.start()):
            out.append((at, m.start()))
        at = m.end()
    if _WORD.search(text, at):
        out.append((at, len(text)))
    return out


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def known_labels(labels: DataFrame, label: str, allowed: Column | None) -> DataFrame:
    """``(doc_id, y)`` of the allowed rows, one per document: of repeated labels the largest; null labels and ids are left out."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known if allowed is None else known.filter(allowed)
    return known.groupBy("doc_id").agg(F.max(label).alias("y"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column | None, rows: int, chars: int) -> DataFrame:
    """``(doc_id, text, y)``: of each label up to ``rows`` rows, in hash order of their ids.

    At most 2 * rows ids are broadcast. Repeated labels count by their largest;
    labels or ids that are null are left out.
    """
    known = known_labels(labels, label, allowed)
    hashed, picked = F.xxhash64("doc_id"), None
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    for y in (1, 0):
        # Twice the share that is wanted, so that what is sorted does not grow with the labels.
        share = min(1.0, 2 * rows / max(1, counts.get(y, 0)))
        few = known.filter(F.col("y") == y).filter(hashed <= min(int(share * 2**64) - 2**63, 2**63 - 1))
        few = few.orderBy(hashed, "doc_id").limit(rows).select(F.col("doc_id").alias("picked_id"), "y")
        picked = few if picked is None else picked.unionByName(few)
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.length("text") <= chars)
    return slim.join(F.broadcast(picked), F.col("doc_id") == F.col("picked_id")).select("doc_id", "text", "y")


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, ys = [], []
        for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
            own = {f for w in set(_WORD.findall(text.as_py().lower())) for f in features_of(w)}
            names.extend(own)
            ys.extend([y] * len(own))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ys, pa.int32())], ["feature", "y"])


def _sentence_rows(batches: Iterator[pa.RecordBatch], index: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ys, empty, lists = [], [], []
        for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
            low = text.as_py().lower()
            own = [sorted({index[f] for w in _WORD.findall(low, a, b) for f in features_of(w) if f in index}) for a, b in sentences(low)]
            ys.append(y)
            empty.append(sum(not s for s in own))
            lists.append([s for s in own if s])
        yield pa.RecordBatch.from_arrays([pa.array(ys, pa.int32()), pa.array(empty, pa.int64()), pa.array(lists, pa.list_(pa.list_(pa.int32())))], ["y", "empty", "sentences"])


def fit_noisy_or(y: np.ndarray, empty: np.ndarray, bags: list[list[list[int]]], n: int, weight: np.ndarray, steps: int = 400, rate: float = 0.1, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the documents' log loss, by full-batch Adam."""
    doc = np.array([d for d, bag in enumerate(bags) for _ in bag], np.int64)
    flat = [s for bag in bags for s in bag]
    row = np.array([i for i, s in enumerate(flat) for _ in s], np.int64)
    col = np.array([c for s in flat for c in s], np.int64)
    w, b = np.zeros(n), -4.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], len(flat)), -30, 30)))
        p0 = 1 / (1 + np.exp(-b))
        log_q = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + empty * np.log1p(-p0)
        q = np.exp(log_q)
        slope = weight * np.where(y == 1, -q / np.maximum(1 - q, 1e-9), 1.0)
        of_row = slope[doc] * p
        g = np.append(np.bincount(col, of_row[row], n) + ridge * w, of_row.sum() + (slope * empty).sum() * p0) / weight.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, *, allowed: Column | None = None, label: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, features: int = FEATURES) -> tuple[dict[str, float], float]:
    """``({feature: weight}, bias)``; without labels of both kinds there are no weights, and all scores are near 0."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    sample = scratch.save(labelled_sample(docs, labels, label, allowed, rows, chars), "sample")
    totals = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return {}, -30.0
    of_all = {r["y"]: r["n"] for r in known_labels(labels, label, allowed).groupBy("y").agg(F.count("*").alias("n")).collect()}
    seen = sample.select("text", "y").mapInArrow(_feature_rows, "feature string, y int").groupBy("feature").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    lift = (F.col("a") + 0.5) / pos / ((F.col("b") + 0.5) / neg)
    chosen = seen.filter(F.col("a") >= max(3, pos // 500)).filter(lift >= 3).orderBy((F.col("a") * F.log(lift)).desc(), "feature").limit(features)
    names = sorted(r["feature"] for r in chosen.select("feature").collect())
    if not names:
        return {}, -30.0
    index = {f: i for i, f in enumerate(names)}
    table = sample.select("text", "y").mapInArrow(lambda it: _sentence_rows(it, index), "y int, empty long, sentences array<array<int>>").toArrow()
    y = table.column("y").to_numpy()
    weight = np.where(y == 1, 1.0, max(1.0, min(10.0, of_all.get(0, 0) / max(1, of_all.get(1, 0)) * pos / neg)))
    w, b = fit_noisy_or(y, table.column("empty").to_numpy(), table.column("sentences").to_pylist(), len(names), weight)
    return {f: float(x) for f, x in zip(names, w) if abs(x) > 1e-3}, b


def score_text(text: str, weights: dict[str, float], bias: float, known: dict[str, float]) -> tuple[float, int, int, int, float]:
    """(score, offending sentences, start, end, score of the worst sentence); an empty text scores 0.

    ``known`` remembers the sum of weights of words met before.
    """
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length; spans must be of the text as it is
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans = sentences(low)
    if not spans:
        return 0.0, 0, 0, 0, 0.0
    bad = set()
    for w in set(_WORD.findall(low)):
        s = known.get(w)
        if s is None:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            s = known[w] = float(any(f in weights for f in features_of(w)))
        if s:
            bad.add(w)
    log_q, worst, count, base = 0.0, (0.0, 0, 0), 0, 1 / (1 + np.exp(-bias))
    quiet = len(spans)
    if bad:
        for a, b in spans:
            hit = bad.intersection(_WORD.findall(low, a, b))
            if not hit:
                continue
            quiet -= 1
            z = bias + sum(weights.get(f, 0.0) for f in {f for w in hit for f in features_of(w)})
            p = min(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))), 1 - 1e-12)
            log_q += np.log1p(-p)
            count += p >= 0.5
            worst = max(worst, (p, -a, -b))
    log_q += quiet * np.log1p(-base)
    return float(1 - np.exp(log_q)), int(count), -worst[1], -worst[2], float(worst[0])


def _scores(batches: Iterator[pa.RecordBatch], weights: dict[str, float], bias: float) -> Iterator[pa.RecordBatch]:
    known: dict[str, float] = {}
    for batch in batches:
        rows = [score_text(t.as_py() or "", weights, bias, known) for t in batch.column(1)]
        score, count, start, end, worst = zip(*rows) if rows else ((),) * 5
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array(count, pa.int64()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(worst, pa.float64())], ["doc_id", "score", "offending", "worst_start", "worst_end", "worst_score"])


def score(docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, score, offending, worst_start, worst_end, worst_score.

    offending counts sentences of probability 0.5 or more; the worst sentence is
    given by its span in characters, (0, 0) if no sentence has a known feature.
    Null and empty texts score 0. Repeated rows are scored each by itself.
    """
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(lambda it: _scores(it, weights, bias), f"doc_id {kind}, score double, offending long, worst_start long, worst_end long, worst_score double")
