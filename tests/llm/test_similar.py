"""Near copies by shingle similarity against a plain version that compares all pairs."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import similar
from strandline.llm.simhash import keep_one


def plain_set(text, k=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_roots(texts, t=0.8):
    sets, root = [plain_set(x) for x in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        union = len(sets[i] | sets[j])
        if not union or len(sets[i] & sets[j]) >= t * union - 1e-9:
            root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words) + 1)
        words[at : at + rng.choice([0, 1, 1, 2])] = [f"e{rng.randrange(10**6)}"] * rng.choice([0, 1, 1, 2])
    return words


def corpus(rng):
    texts = ["", None, " \n", "one", "One", "one two three four five", "a b c d e f g h"]
    passage = [f"p{rng.randrange(10**6)}" for _ in range(60)]
    for _ in range(60):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([6, 9, 12, 20, 40, 80, 150, 400]))]
        if rng.random() < 0.3:
            base += passage
        texts.append(" ".join(base))
        for _ in range(rng.randrange(5)):
            texts.append((" " if rng.random() < 0.5 else "\n").join(edited(rng, base, rng.choice([0, 1, 1, 2, 3, len(base) // 45 + 1]))))
    base = [f"h{rng.randrange(10**6)}" for _ in range(120)]
    texts += [" ".join(edited(rng, base, 1)) for _ in range(60)]
    return texts


def same_classes(a, b):
    assert len(set(a)) == len(set(b)) == len(set(zip(a, b)))


def test_against_all_pairs(spark, docs):
    for seed in (1, 2):
        texts = corpus(random.Random(seed))
        table = docs(list(enumerate(texts))).withColumn("node", F.lit(1)).withColumn("root", F.lit("x"))
        got = {r.doc_id: r.root for r in similar.similar_nodes(table).collect()}
        want = plain_roots(texts)
        same_classes([got[i] for i in range(len(texts))], want)
        kept = sorted(r.doc_id for r in keep_one(table).collect())
        assert kept == sorted(set(want))


def test_every_pair_collides():
    """Pairs at the bound, of all small sizes and some larger: no key in common in fewer than 1 of 10 000."""
    rng, lost, tried = np.random.default_rng(5), 0, 0
    for n in [*range(4, 40), 60, 100, 101, 250]:
        for m in {n, int(n / 0.8 + 1e-9)}:
            common = -(-8 * (n + m) // 18)
            while common <= min(n, m) and not similar.similar_sets(np.arange(n), np.concatenate([np.arange(common), np.arange(m - common) + 9999]), 0.8):
                common += 1
            if common > min(n, m):
                continue
            for _ in range(120 if n < 40 else 15):
                h = rng.integers(0, 2**63, n + m).astype(np.uint64)
                a, b = np.sort(h[:n]), np.sort(np.concatenate([h[:common], h[n : n + m - common]]))
                tried += 1
                ka, kb = similar.covering_keys(a), similar.covering_keys(b)
                lost += not (np.array_equal(a, b) or len(np.intersect1d(ka, kb)))
                d = similar.distances(np.frombuffer(similar.sketch(a), "<u8"), np.frombuffer(similar.sketch(b), "<u8")[None, :])[0]
                lost += d > similar.SKETCH_RADIUS
    assert tried > 5000 and lost <= 1


def test_spanning_tree_keeps_clusters():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, (6, 4)).astype(np.uint64)
    sketches = np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 60, (12, 4)).astype(np.uint64)) for b in base])
    for radius in (6, 8, 76):
        for links in (similar.close_links(sketches, radius), [(i, j, 0) for i in range(72) for j in range(i) if similar.distances(sketches[i], sketches[j][None, :])[0] <= radius]):
            root = list(range(72))
            for i, j, _ in links:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
            if links and len(links) < 72:
                tree = root
        same_classes(tree, root)


def test_links_that_trees_go_round(spark, docs):
    """Two of each group are at 0.803, all others below 0.8, and their sketches are no nearer."""
    rng = random.Random(4)
    texts = []
    for _ in range(6):
        base = [f"c{rng.randrange(10**9)}" for _ in range(404)]
        for tail in [49, 49] + [53] * 30:
            texts.append(" ".join(base + [f"t{rng.randrange(10**9)}" for _ in range(tail)]))
    got = {r.doc_id: r.root for r in similar.similar_nodes(docs(list(enumerate(texts)))).collect()}
    want = plain_roots(texts)
    assert len(set(want)) == 6 * 31
    same_classes([got[i] for i in range(len(texts))], want)


def test_keys_of_every_pair():
    """Pairs at the bound have a key in common whatever is frequent, and are never ruled out by profiles."""
    rng = np.random.default_rng(3)
    for n in [*range(4, 60), 300, 2000]:
        for m in {n, n + 1, int(n / 0.8 + 1e-9)}:
            common = next((c for c in range(min(n, m) + 1) if similar.similar_sets(np.arange(n), np.concatenate([np.arange(c), np.arange(m - c) + 9999]), 0.8)), None)
            if common is None:
                continue
            for _ in range(20):
                h = np.unique(rng.integers(0, 2**63, n + m).astype(np.uint64))
                a, b = np.sort(h[:n]), np.sort(np.concatenate([h[:common], h[n : n + m - common]]))
                frequent = np.sort(rng.choice(h, rng.integers(0, len(h)), replace=False))
                assert len(np.intersect1d(similar.covering_keys(a, 0.8, frequent), similar.covering_keys(b, 0.8, frequent)))
                counts = np.frombuffer(similar.profile(a) + similar.profile(b), "u1").reshape(2, -1)
                assert len(list(similar.crossing_pairs(np.array([1, 2]), np.array([len(a), len(b)]), counts, 0.8))) == 1


def test_first_common_key_of_every_pair():
    """At the first key that a pair at the bound has in common, the smaller set's key leads and places rule nothing out."""
    rng = np.random.default_rng(8)
    for n in [*range(4, 60), 300, 2000]:
        for m in {n, n + 1, int(n / 0.8 + 1e-9)}:
            common = next((c for c in range(min(n, m) + 1) if similar.similar_sets(np.arange(n), np.concatenate([np.arange(c), np.arange(m - c) + 9999]), 0.8)), None)
            if common is None:
                continue
            for _ in range(20):
                h = np.unique(rng.integers(0, 2**63, n + m).astype(np.uint64))
                sets = [np.sort(h[:n]), np.sort(np.concatenate([h[:common], h[n : n + m - common]]))]
                sizes = np.array([len(s) for s in sets])
                frequent = np.sort(rng.choice(h, rng.integers(0, len(h)), replace=False))
                a, b = (similar.covering_keys(s, 0.8, frequent) for s in sets)
                first = next(k for k in a if k in b)
                pos = np.array([int(np.flatnonzero(k == first)[0]) for k in (a, b)])
                lesser = int(sizes.argmin())
                assert sizes[lesser] - pos[lesser] >= similar.least_common(2 * sizes[lesser], 0.8)
                counts = np.frombuffer(b"".join(similar.profile(s) for s in sets), "u1").reshape(2, -1)
                assert len(list(similar.crossing_pairs(np.array([1, 2]), sizes, counts, 0.8, pos))) == 1


def test_pairs_of_a_template(spark, docs, monkeypatch):
    """Texts of a passage of 300 words and 42 of their own are just under 0.8: pairs that are verified grow no faster than the texts."""
    sent, save = {}, similar.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        if name in ("links", "apart"):
            sent[name] = out.count()
        return out

    monkeypatch.setattr(similar.Scratch, "save", counted)
    for n in (50, 200):
        rng = random.Random(6)
        passage = [f"p{rng.randrange(10**9)}" for _ in range(300)]
        texts = [" ".join([f"o{rng.randrange(10**9)}" for _ in range(42)] + passage) for _ in range(n)]
        got = [r.root for r in similar.similar_nodes(docs(list(enumerate(texts)))).collect()]
        assert len(set(got)) == n
        assert sent["links"] + sent["apart"] <= 2 * n


def test_empty_table_and_ids(spark, docs):
    assert keep_one(docs([])).count() == 0
    rows = [(None, "a b c"), (None, "A b  c"), (3, "a b c"), (4, None), (5, ""), (5, "")]
    assert sorted((r.doc_id or 0) for r in keep_one(docs(rows)).collect()) == [3, 4]
