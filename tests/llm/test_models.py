import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import hmm_lm, pii, toxicity


def plain_base(text):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and pii.luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans():
    rng = random.Random(1)
    parts = ["a@b.c", "x.y@", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (555) 555-0100", ".", " ", "7", "é", "-", "+", "a", "001.2.3.4"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randrange(9)))
        assert pii.base_spans(text) == plain_base(text)
    assert pii.base_spans("a" * 300_000 + "@") == []


def test_long_instances_differ_by_their_ends():
    long = "a1b2" * 40
    assert pii.instance("AB@c.D") == "ab@c.d"
    assert len({pii.instance(long + end) for end in "xyz"}) == 3 and len(pii.instance(long)) == 64


def test_find_pii(spark, docs):
    rows = [(i, f"please call me at user{i}@mail.example now") for i in range(5)] + [(9, "please call me at user9-AT-mail77 now"), (10, None), (11, ""), (11, "")]
    got = {r.doc_id: r for r in pii.find_pii(docs(rows).withColumn("key", F.lit(1))).collect()}
    assert got[0].base == got[0].spans == "email:18:36" and got[0].n == [1, 0, 0, 0]
    word = rows[5][1].index("user9"), rows[5][1].index(" now")
    assert got[9].base == "" and got[9].spans == f"email:{word[0]}:{word[1]}"
    assert got[10].spans == "" and got[11].n == [0, 0, 0, 0]
    assert pii.find_pii(docs([])).count() == 0


def test_forward_against_all_paths():
    rng = np.random.default_rng(3)
    model = hmm_lm.initial(np.full(6, 1 / 6), 3)
    for n in (1, 2, 5):
        seq = rng.integers(0, 6, n).astype(np.int32)
        total = 0.0
        for path in itertools.product(range(3), repeat=n):
            p = model.start[path[0]] * model.emit[seq[0], path[0]]
            for a, b, o in zip(path, path[1:], seq[1:]):
                p *= model.move[a, b] * model.emit[o, b]
            total += p
        longer = rng.integers(0, 6, 9).astype(np.int32)
        assert np.allclose(hmm_lm.log_likelihoods([seq, longer, seq], model)[[0, 2]], np.log10(total))
    starts, moves, emits = hmm_lm.expected_counts([seq, longer], model)
    assert np.isclose(starts.sum(), 2) and np.isclose(emits.sum(), len(seq) + 9) and np.isclose(moves.sum(), len(seq) + 7)


def test_hmm_scores(spark, docs):
    rows = [(i, "The cat sat. " * 5 if i % 2 else "der hund lief " * 4) for i in range(40)] + [(50, None), (51, ""), (51, ""), (None, "cat unseen" * 2)]
    got = hmm_lm.train_and_score(docs(rows).withColumn("n", F.lit(1)), F.col("doc_id") < 30, vocabulary=4, states=2).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {15 * 16 + 15 * 13}
    held = [r for r in got if r.doc_id is not None and 30 <= r.doc_id < 50]
    assert all(r.n_known == r.n_tokens for r in held) and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert hmm_lm.train_and_score(docs([]), F.col("doc_id") < 3).count() == 0


def test_toxicity(spark, docs):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        said = [" ".join(f"w{rng.randrange(50)}" for _ in range(6)) for _ in range(4)] + (["you are a foul" + rng.choice("abc") + " one"] if bad else [])
        rows.append((i, ". ".join(said)))
        labels.append((i, int(bad)))
    table, marks = docs(rows + [(900, None), (901, "")]), spark.createDataFrame(labels, "doc_id long, toxic int")
    weights, bias = toxicity.train(table, marks, allowed=F.col("doc_id") < 180)
    got = {r.doc_id: r for r in toxicity.score(table, weights, bias).collect()}
    assert all((got[i].score >= 0.5) == bool(t) for i, t in labels if i >= 180)
    assert rows[180][1][got[180].worst_start : got[180].worst_end].strip().startswith("you are")
    assert got[900].score == got[901].score == 0
    assert toxicity.train(table, marks.limit(0)) == ({}, -30.0)


def test_toxicity_learns_no_held_out_label(spark, docs):
    rows = [(i, "you are a foul one. all is well" if i % 4 == 0 else "all is well today. the sun shines") for i in range(80)]
    table = docs(rows)
    marks = [(i, int(i % 4 == 0)) for i in range(80)]
    others = [(i, 1 - y) for i, y in marks if i >= 60] + [(1000 + i, 0) for i in range(900)]
    schema, allowed = "doc_id long, toxic int", F.col("doc_id") < 60
    plain = toxicity.train(table, spark.createDataFrame(marks, schema), allowed=allowed)
    flipped = toxicity.train(table, spark.createDataFrame([m for m in marks if m[0] < 60] + others, schema), allowed=allowed)
    assert plain[0] and plain == flipped
