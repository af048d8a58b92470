"""The quality classifier and the toxicity score against plain versions."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import kneser_ney, toxicity
from strandline.llm.scratch import Scratch


class PlainModel:
    """Interpolated modified Kneser-Ney over characters, by dictionaries of tuples."""

    def __init__(self, texts, order=4, symbols=128):
        by = Counter(c for t in texts for c in t)
        self.known = {c: i + 2 for i, c in enumerate(sorted(by, key=lambda c: (-by[c], ord(c)))[: symbols - 2])}
        self.order, self.symbols = order, symbols
        counts = Counter()
        for t in texts:
            s = [0] * (order - 1) + [self.known.get(c, 1) for c in t]
            counts.update(tuple(s[i : i + order]) for i in range(len(s) - order + 1))
        self.tables = {}
        for n in range(order, 0, -1):
            of = Counter(counts.values())
            if of[1] and of[2] and of[3]:
                y = of[1] / (of[1] + 2 * of[2])
                d = [min(max(i - (i + 1) * y * of[i + 1] / of[i], 0.05), i - 0.05) for i in (1, 2, 3)]
            else:
                d = [0.5, 0.75, 0.9]
            total, held = Counter(), Counter()
            for g, c in counts.items():
                total[g[:-1]] += c
                held[g[:-1]] += d[min(c, 3) - 1]
            share = {g: (c - d[min(c, 3) - 1]) / total[g[:-1]] for g, c in counts.items()}
            self.tables[n] = share, {h: held[h] / total[h] for h in total}
            counts = Counter(g[1:] for g in counts)

    def p(self, gram):
        if not gram:
            return 1 / self.symbols
        share, gamma = self.tables[len(gram)]
        return share.get(gram, 0.0) + gamma.get(gram[:-1], 1.0) * self.p(gram[1:])

    def bits(self, text):
        s = [0] * (self.order - 1) + [self.known.get(c, 1) for c in text]
        return sum(-math.log2(self.p(tuple(s[i : i + self.order]))) for i in range(len(s) - self.order + 1))


def prose(rng, n, words=("river", "stone", "wall", "the", "and", "green", "field", "along", "quiet", "old")):
    return " ".join(rng.choice(words) for _ in range(n))


def percentile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    low = math.floor(at)
    return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])


def plain_quality(rows, trusted, quantile=0.99, factor=1.1, prior=200, least=50):
    """rows (doc_id, text, lang) -> {row: (bits, perplexity, threshold, kept)}."""
    trains = {d for d in trusted if zlib.crc32(f"{d}/quality".encode()) % 2 == 0}
    model = PlainModel([t or "" for d, t, _ in rows if d in trains])
    bits = [model.bits(t or "") for _, t, _ in rows]
    others = (trusted - trains) or trusted
    own = [(lang, len(t), b, round(b / len(t), 3)) for (d, t, lang), b in zip(rows, bits) if d in others and t]
    of = defaultdict(list)
    for lang, _, _, m in own:
        of[lang].append(m)
    middles = {lang: percentile(m, 0.5) for lang, m in of.items() if len(m) >= least}
    middle_all = percentile([m for *_, m in own], 0.5) if own else None

    def drawn(lang, chars, b):
        middle = middles.get(lang, middle_all)
        return 0.0 if middle is None else (b + prior * middle) / (chars + prior)

    level = defaultdict(list)
    for lang, n, b, _ in own:
        level[lang].append(round(drawn(lang, n, b), 3))
    edges = {lang: percentile(v, quantile) for lang, v in level.items() if len(v) >= least}
    edge_all = percentile([x for v in level.values() for x in v], quantile) if own else None
    out = []
    for (_, t, lang), b in zip(rows, bits):
        edge = edges.get(lang, edge_all)
        threshold = math.inf if edge is None else factor * 2**edge
        perplexity = 2 ** drawn(lang, len(t or ""), b)
        out.append((b, perplexity, threshold, not t or perplexity <= threshold))
    return out


@pytest.fixture(scope="module")
def quality_rows():
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 40)), "en") for i in range(150)]
    rows += [(200 + i, prose(rng, rng.randrange(1, 30), ("fluss", "stein", "der", "und")), "de") for i in range(130)]
    rows += [(400 + i, prose(rng, 12), "xx") for i in range(6)] + [(450, prose(rng, 9), None), (451, "é" * 40, "en")]
    rows += [(500 + i, "".join(chr(rng.randrange(33, 500)) for _ in range(300)), ("en", "de", None)[i % 3]) for i in range(6)]
    rows += [(600, None, "en"), (601, "", "de"), (3, prose(rng, 10), "en"), (None, prose(rng, 10), "en")]
    trusted = {d for d, *_ in rows if d is not None and d < 450}
    return rows, trusted


@pytest.mark.parametrize("broadcast_grams", [2_000_000, 0])
def test_quality_against_loops(spark, docs, quality_rows, broadcast_grams):
    rows, trusted = quality_rows
    table = docs([(d, t, lang, "a") for d, t, lang in rows])
    for name in ("key", "text_key", "middle", "edge", "their_lang", "picked_id", "mean"):
        table = table.withColumn(name, F.lit(1))
    labels = spark.createDataFrame([(d, 1, 0) for d in trusted] + [(500, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, kneser_ney._scores(table, labels, broadcast_grams=broadcast_grams).select("doc_id", "lang", "chars", "bits", "perplexity", "threshold", "kept").collect()), key=str)
    want = plain_quality(rows, trusted)
    wanted = sorted(((d, lang, len(t or ""), *w) for (d, t, lang), w in zip(rows, want)), key=str)
    key = lambda r: (str(r[0]), str(r[1]), r[2], round(r[3], 2))
    for g, w in zip(sorted(got, key=key), sorted(wanted, key=key)):
        assert g[:3] == w[:3] and abs(g[3] - w[3]) < 0.01
        assert math.isclose(g[4], w[4], rel_tol=1e-3) and math.isclose(g[5], w[5], rel_tol=1e-3) and g[6] == w[6]
    assert {w[6] for w in wanted} == {True, False}
    kept = kneser_ney.keep_quality(table, labels)
    assert kept.columns == table.columns and kept.count() == sum(w[6] for w in wanted)


def test_quality_learns_from_all_trusted_texts(spark, docs):
    """More texts than 4000 that fit, and one beyond 200 000 characters: all of them count in the model."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 3) + f" {i}", "en") for i in range(8500)]
    long = next(i for i in range(9000, 9100) if zlib.crc32(f"{i}/quality".encode()) % 2 == 0)
    rows.append((long, "zebra qux " * 20_500, "en"))
    fit = [(i, t) for i, t, _ in rows if zlib.crc32(f"{i}/quality".encode()) % 2 == 0]
    assert len(fit) > 4000
    rows.append((9999, "zebra qux river", "en"))
    labels = spark.createDataFrame([(i, 1) for i, *_ in rows if i != 9999], "doc_id long, quality int")
    got = {r.doc_id: r.bits for r in kneser_ney.score_quality(docs([(*r, "a") for r in rows]), labels).collect()}
    plain = PlainModel([t for _, t in fit])
    for i, t, _ in [*rows[:50], rows[-1]]:
        assert math.isclose(got[i], plain.bits(t), rel_tol=1e-6)


def test_discounts_and_back_off(spark, docs):
    rng = random.Random(1)
    texts = [prose(rng, 60) + rng.choice("!?.,;é") for _ in range(20)]
    plain = PlainModel(texts)
    chars, orders = kneser_ney.train(docs(list(enumerate(texts))), Scratch(spark, "kn"))
    assert [chr(c) for c in chars] == sorted(plain.known, key=plain.known.get)
    for n, table in enumerate(orders, 1):
        share, gamma = plain.tables[n]
        for r in table.collect():
            gram = tuple(r.gram >> 7 * i & 127 for i in reversed(range(n)))
            assert math.isclose(r.share, share[gram]) and math.isclose(r.gamma, gamma[gram[:-1]])


def test_quality_without_rows_or_labels(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert kneser_ney.keep_quality(docs([]), labels).count() == 0
    assert kneser_ney.keep_quality(docs([(1, "x" * 50), (1, None)]), labels).count() == 2


def test_toxicity_is_the_noisy_or(spark, docs):
    """The score of each document against 1 - prod(1 - p) over sentences, computed plainly."""
    rng = random.Random(7)
    weights = {"foul": 3.0, "4:idio": 4.5, "5:rotte": 2.0, "rot": 1.5, "kind": -2.0}
    words = ["foul", "Idiot", "idiotic", "rotten", "rot", "kind", "is", "you", "İ", "x1"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", " ", ". ", "!", "\n", "?!"]) for _ in range(rng.randrange(25)))) for i in range(200)]
    table = docs(rows + [(900, None), (901, ""), (901, "...\n")])
    for name in ("score", "offending", "picked_id", "y"):
        table = table.withColumn(name, F.lit(1))
    got = {r.doc_id: r for r in toxicity.score(table, weights, -3.0).collect()}
    for d, text in rows:
        low, rest, at, spans = "".join(c.lower() if len(c.lower()) == 1 else c for c in text), 1.0, 0, []
        for i, c in enumerate(low + "."):
            if c in ".!?\n":
                spans.append((at, i))
                at = i + 1
        probabilities = []
        for a, b in spans:
            found = set("".join(c if c.isalnum() or c == "_" else " " for c in low[a:b]).split())
            if found:
                parts = {f for w in found for f in [w, *(f"{n}:{w[:n]}" for n in (4, 5, 6) if len(w) >= n)]}
                z = -3.0 + sum(weights.get(f, 0) for f in parts)
                probabilities.append(1 / (1 + math.exp(-z)))
                rest *= 1 - probabilities[-1]
        assert math.isclose(got[d].score, 1 - rest if probabilities else 0.0, abs_tol=1e-9)
        assert got[d].offending == sum(p >= 0.5 for p in probabilities)
    assert got[900].score == got[901].score == 0


def test_label_samples_are_bounded(spark, docs):
    labels = spark.createDataFrame([(i, i % 5 == 0) for i in range(4000)] + [(7, True), (None, True)], "doc_id long, b boolean").selectExpr("doc_id", "int(b) y1")
    table = docs([(i, f"t{i}") for i in range(4000)])
    got = toxicity.labelled_sample(table, labels, "y1", None, 100, 1000).collect()
    assert Counter(r.y for r in got) == {1: 100, 0: 100} and all(r.y == int(r.doc_id % 5 == 0 or r.doc_id == 7) for r in got)
    few = toxicity.labelled_sample(table, labels, "y1", None, 5000, 1000).collect()
    assert Counter(r.y for r in few) == {1: 801, 0: 3199}


def test_grams_of_long_texts(monkeypatch):
    """Chunks of a text give the counts of the whole."""
    rng = random.Random(2)
    table = kneser_ney.symbol_table([ord(c) for c in "abc "])
    for n in (0, 1, 3, 50):
        text = "".join(rng.choice("abc d") for _ in range(n))
        s = [0, 0, 0] + [dict(zip("abc ", range(2, 6))).get(c, 1) for c in text]
        want = Counter(s[i] << 21 | s[i + 1] << 14 | s[i + 2] << 7 | s[i + 3] for i in range(n))
        for chunk in (1, 4, 1 << 20):
            monkeypatch.setattr(kneser_ney, "CHUNK", chunk)
            got = Counter()
            for g, c in zip(*kneser_ney.counted_grams(text, table)):
                got[int(g)] += int(c)
            assert +got == want


@pytest.mark.parametrize("broadcast_grams", [2_000_000, 0])
def test_every_character_counts_by_itself(spark, docs, broadcast_grams):
    """More characters than 7 bits hold, some beyond the basic plane: those beyond the 126 most frequent were one symbol before."""
    rng = random.Random(4)
    alphabet = [chr(0x4E00 + i) for i in range(400)] + [chr(0x20000 + i) for i in range(60)]
    texts = ["".join(rng.choice(alphabet[: 100 + 20 * i]) for _ in range(300)) for i in range(30)]
    plain = PlainModel(texts, symbols=len(set("".join(texts))) + 2)
    assert len(plain.known) > 300
    chars, orders = kneser_ney.train(docs(list(enumerate(texts))), Scratch(spark, "kn"))
    asked = [texts[3], texts[29], alphabet[299] * 9, alphabet[298] * 9, "neither"]
    table = spark.createDataFrame(list(enumerate(asked)), "text_key long, text string")
    got = {r.text_key: r.bits for r in kneser_ney.joined_bits(table, chars, orders, broadcast_grams).collect()}
    for i, t in enumerate(asked):
        assert math.isclose(got[i], plain.bits(t), rel_tol=1e-6)


def test_pairs_where_characters_outnumber_symbols(monkeypatch):
    monkeypatch.setattr(kneser_ney, "WIDE", 8)
    monkeypatch.setattr(kneser_ney, "PARTS", 8)
    chars = list(range(0x4E00, 0x4E00 + 300))
    table = kneser_ney.symbol_table(chars)
    each = [tuple(kneser_ney.symbols(chr(c), table).tolist()) for c in chars]
    assert len(set(each)) == 300 and [len(x) for x in each] == [1] * 246 + [2] * 54
    assert all(2 <= x[0] < 248 if len(x) == 1 else min(x) >= 248 and max(x) < 256 for x in each)
    text = "".join(chr(random.Random(1).choice(chars)) for _ in range(50)) + "x" + chr(chars[-1])
    assert kneser_ney.symbols(text, table).tolist() == [s for c in text for s in kneser_ney.symbols(c, table).tolist()]
    (keys,) = kneser_ney.gram_keys(text, table)
    assert (keys & 255).tolist() == kneser_ney.symbols(text, table).tolist()
