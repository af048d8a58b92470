import hashlib
import random
import time
from collections import Counter

from strandline.llm import pii
from strandline.llm.queries import op8_pii
from strandline.llm.scratch import Scratch
from test_models import plain_base


def test_discovered_instances_extend_the_patterns(spark, docs):
    free = ("today", "tomorrow", "soon", "later", "again")
    rows = [(i, f"call me at user{i}@mail.example {w}") for i, w in enumerate(free * 4)]
    rows += [(50 + i, f"call me at member77{i}x {w}") for i, w in enumerate(free[:3])]
    # The found ones in a context that has no seed, which finds a further one.
    rows += [(30 + i, f"reply goes via member77{i}x please") for i in range(3)] + [(40, "reply goes via member995x please"), (41, "order number ab12345 shipped")]
    got = {r.doc_id: r for r in pii.find_pii(docs(rows, "")).collect()}
    for d, t in rows:
        ids = [w for w in t.split() if "member" in w]
        if ids:
            at = t.index(ids[0])
            assert got[d].spans == f"email:{at}:{at + len(ids[0])}" and got[d].base == ""
    assert got[41].spans == ""


def test_identifiers_in_groups(spark, docs):
    for number in ("555 123 4567", "0171 23 45 67", "(555) 123-4567", "1234 5678 9012 3456", "0171.23.45", "12 (34) 56"):
        text = f"ring me under {number}, please"
        at = text.index(number)
        assert (at, at + len(number)) in pii.candidates(text, [])
    assert pii.candidates("1" * 200_000 + " x", []) == [(0, 200_000)] and pii.candidates("at 5 6 or 7", []) == []
    rows = [(i, f"ring me under +1 555 010 99{i}0 please") for i in range(6)] + [(9, "ring me under (555) 123-4567 please")]
    got = {r.doc_id: r.spans for r in pii.find_pii(docs(rows)).collect()}
    assert got[9] == "phone:14:28"


def plain_discover(edges, rounds, min_seeds, min_score):
    """The pattern scores by loops over (pattern, instance, own kind, n)."""
    kinds = {(p, own) for p, _, own, _ in edges if own}
    reached = {}
    for i in range(rounds):
        induced = {(p, k) for p, x, own, _ in edges if not own for (y, k), v in reached.items() if x == y and v >= min_score}
        worth = {}
        for p, k in kinds | induced:
            mine = [(x, own, n) for q, x, own, n in edges if q == p]
            score = [1.0 if own == k else 0.0 if own else reached.get((x, k), 0.0) for x, own, _ in mine]
            seeds = sum(s == 1 if own else s >= min_score for s, (_, own, _) in zip(score, mine))
            worth[p, k] = (sum(s * n for s, (_, _, n) in zip(score, mine)) / sum(n for *_, n in mine), seeds)
        if i + 1 < rounds:
            reached = {}
            for p, x, own, _ in edges:
                for (q, k), (w, seeds) in worth.items():
                    if not own and q == p and seeds >= min_seeds:
                        reached[x, k] = max(reached.get((x, k), 0.0), w)
    best = {}
    for (p, k), (w, seeds) in worth.items():
        if seeds >= min_seeds and w >= min_score:
            best[p] = max(best.get(p, (0, 0, "")), (w, seeds, k))
    return best


def test_pattern_scores_against_loops(spark):
    rng = random.Random(4)
    mentions = []
    for _ in range(900):
        x = rng.randrange(60)
        seed = ("email", "card", "secret")[x % 3] if x < 30 else None
        mentions.append((seed, f"i{x}", f"p{(x % 7) if rng.random() < 0.8 else rng.randrange(12)}"))
    counts = Counter((p, x, k) for k, x, p in mentions)
    table = spark.createDataFrame(mentions, "seed string, instance string, pattern string")
    for rounds, min_seeds, min_score in ((1, 2, 0.3), (3, 2, 0.3), (3, 3, 0.5), (4, 1, 0.2)):
        got = pii.discover(table, Scratch(spark, "pii"), rounds=rounds, min_seeds=min_seeds, min_score=min_score).collect()
        want = plain_discover([(p, x, k, n) for (p, x, k), n in counts.items()], rounds, min_seeds, min_score)
        assert {r.pattern: (r.seeds, r.kind) for r in got} == {p: (s, k) for p, (_, s, k) in want.items()}
        assert all(abs(r.worth - want[r.pattern][0]) < 1e-9 for r in got)


def test_secrets_need_a_pattern(spark, docs):
    rng = random.Random(8)
    key = lambda: "".join(rng.choices("0123456789abcdef", k=38)) + "a1"
    rows = [(i, f'{rng.choice("abc")}x token = "{key()}" yes') for i in range(9)]
    rows += [(20 + i, f"{'abcd'[i]}word {key()} {'wxyz'[i]}word") for i in range(4)] + [(30, 'so token = "ab12cd34" yes')]
    got = {r.doc_id: r for r in pii.find_pii(docs(rows)).collect()}
    for d, t in rows:
        at = t.find('"') + 1
        assert got[d].spans == (f"secret:{at}:{t.rindex(chr(34))}" if at else "") and got[d].n_found == (at > 0) and got[d].base == ""


def test_spans_within_others_go(spark, docs):
    rows = [(i, f"ring me under +1 555 010 99{i}0 please") for i in range(6)] + [(9, "ring me under 0171-23 45 67890 please"), (10, "ring me under " * 400)]
    got = {r.doc_id: r.spans for r in pii.find_pii(docs(rows)).collect()}
    assert got[9] == "phone:14:30" and got[10] == ""


def test_long_tokens_in_linear_time():
    for text in ("a" * 1_000_000, "ab." * 300_000, "1" * 1_000_000, "(1" * 400_000, "x" * 500_000 + "@" + "y" * 500_000, "1.2" * 300_000):
        began = time.time()
        pii.candidates(text, pii.base_spans(text))
        assert time.time() - began < 2.5


def test_base_sha256(spark, tmp_path):
    rows = [(1, "a@b.cd 1.2.3.4 x"), (2, None), (3, "+1 (555) 555-0100, 4111 1111 1111 1111")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op8_pii(spark, str(tmp_path)).collect()}
    for d, text in rows:
        base = ",".join(f"{k}:{a}:{b}" for a, b, k in plain_base(text or ""))
        assert got[d].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in pii.KINDS] == [sum(s[2] == k for s in plain_base(text or "")) for k in pii.KINDS]
