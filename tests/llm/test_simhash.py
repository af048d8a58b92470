import random

import numpy as np
import xxhash

from strandline.llm import simhash
from strandline.llm.scratch import Scratch
from strandline.llm.simhash import covering_masks, fingerprint, hamming_links, keep_one, simhash_groups
from strandline.llm.graph import components
from strandline.llm.words import word_runs


def plain_fingerprint(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r " else c for c in text).split(" ") if w]
    words = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in words]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def least_reachable(fps, ids, radius=3):
    comp = list(range(len(fps)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                comp[max(a, b)] = min(a, b)
    best = {}
    for i in range(len(fps)):
        r = find(i)
        if ids[i] is not None:
            best[r] = min(best.get(r, ids[i]), ids[i])
    return [best.get(find(i)) for i in range(len(fps))]


def test_word_runs_overlap():
    text = b" ".join(b"w%d" % i for i in range(50))
    for size in (1, 5, 17, 1000):
        runs = list(word_runs(text, 2, size))
        grams = [tuple(r[i : i + 3]) for r in runs for i in range(len(r) - 2)]
        words = text.split()
        assert grams == [tuple(words[i : i + 3]) for i in range(48)]
    assert list(word_runs(b"a b" + b" " * 40, 2, 4)) == [[b"a", b"b"]]
    assert list(word_runs(b" " * 40, 2, 4)) == []


def test_fingerprint_matches_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50, 400):
        text = "".join(rng.choice(["Ab", "cé", "Äx", "zz9"]) + rng.choice([" ", "\n", "\t ", " "]) for _ in range(n))
        assert fingerprint(text.encode()) == plain_fingerprint(text)
    assert fingerprint(None) == 0


def test_covering_guarantee():
    for level in (1, 2, 3):
        masks = np.array(covering_masks(level), np.int64).view(np.uint64)
        rng = random.Random(level)
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), 3))
            assert (masks & np.uint64(diff) == 0).any()
    assert max(64 - bin(m & (2**64 - 1)).count("1") for m in covering_masks(3)) <= 9


def test_links_with_split_buckets(spark):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(60)}
    base = rng.getrandbits(64)
    fps |= {base ^ sum(1 << b for b in rng.sample(range(20), rng.randint(0, 4))) for _ in range(150)}
    fps = sorted(fps)
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    want = least_reachable(fps, signed)
    for bucket_rows in (2048, 3):
        scratch = Scratch(spark, "t")
        got = {r.u: r.v for r in components(hamming_links(nodes, scratch, bucket_rows=bucket_rows), scratch).collect()}
        assert [got.get(s, s) for s in signed] == want


def test_groups_against_all_pairs(spark, docs):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(8)]
    rows = [(i, b) for i, b in enumerate(base)]
    for i in range(30):
        t = rng.choice(base).split()
        t[rng.randrange(len(t))] = "x"
        rows.append((100 + i, " ".join(t)))
    rows += [(7, base[3]), (90, None), (91, ""), (92, " \n"), (None, base[0]), (95, "one"), (95, "one"), (96, "One"), (97, "a b " * 30000)]
    got = simhash_groups(docs(rows).withColumn("fp", F_lit()).withColumn("u", F_lit())).collect()
    fps = [plain_fingerprint(t or "") for _, t in rows]
    want = least_reachable(fps, [i for i, _ in rows])
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.fp & (2**64 - 1), r.component_id) for r in got) == sorted(((i is None, i or 0), f, c) for (i, _), f, c in zip(rows, fps, want))
    kept = keep_one(docs(rows), similarity=None, shingle=3)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def F_lit():
    from pyspark.sql import functions as F

    return F.lit(1)


def test_empty(spark, docs):
    assert simhash_groups(docs([])).count() == 0
    assert simhash.keep_one(docs([])).count() == 0
