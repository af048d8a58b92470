"""Near dedup by similarity: covering LSH of fingerprints links first, its links are true pairs, and only similar ones count."""

import random

import numpy as np

from strandline.llm import similar
from strandline.llm.scratch import Scratch
from test_similar import plain_roots, same_classes


def roots_of(pairs, names):
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for u, v in pairs:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return [find(n) for n in names]


def test_pairs_by_fingerprints(spark):
    """Nodes in chains of fingerprints at 3 bits or fewer, equal ones too: each pair is near, and together they link what all near pairs do."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(3)]
    fps = [rng.getrandbits(64) for _ in range(40)] + [b ^ sum(1 << i for i in rng.sample(range(24), rng.randint(0, 4))) for b in base for _ in range(60)]
    fps += rng.choices(fps[40:], k=20)
    nodes = {1000 + i: int(np.uint64(f).astype(np.int64)) for i, f in enumerate(fps)}
    table = spark.createDataFrame(list(nodes.items()), "node long, fp long").repartition(4)
    got = [(r.u, r.v) for r in similar.covering_pairs(table, Scratch(spark, "t")).collect()]
    bits = lambda u, v: bin((nodes[u] ^ nodes[v]) & (2**64 - 1)).count("1")
    near = [(u, v) for u in nodes for v in nodes if u < v and bits(u, v) <= 3]
    assert set(got) <= set(near)
    assert len(got) == len(set(got)) and len(got) < len(near)
    assert roots_of(got, nodes) == roots_of(near, nodes)


def test_step_links_first(spark, docs, monkeypatch):
    """Of long texts with one word changed covering LSH finds pairs, which are verified first; of a template's, just under 0.8, its pairs link nothing."""
    rng, tables, save = random.Random(8), {}, Scratch.save

    def kept(self, df, name):
        out = save(self, df, name)
        if name in ("covering", "first", "verified-first"):
            tables[name] = {(r.u, r.v) for r in out.select("u", "v").collect()}
        return out

    monkeypatch.setattr(Scratch, "save", kept)
    texts = []
    for _ in range(20):
        words = [f"w{rng.randrange(10**9)}" for _ in range(400)]
        texts += [" ".join(words), " ".join(words[:200] + ["new"] + words[201:]), " ".join(words[:-60])]
    passage = [f"p{rng.randrange(10**9)}" for _ in range(300)]
    texts += [" ".join([f"o{rng.randrange(10**9)}" for _ in range(42)] + passage) for _ in range(150)]
    rows = similar.similar_nodes(docs(list(enumerate(texts)))).collect()
    got, node = {r.doc_id: r.root for r in rows}, {r.doc_id: r.node for r in rows}
    same_classes([got[i] for i in range(len(texts))], plain_roots(texts))
    assert tables["covering"] <= tables["first"] >= tables["verified-first"]
    changed = {tuple(sorted((node[i], node[i + 1]))) for i in range(0, 60, 3)}
    assert len(changed & tables["covering"] & tables["verified-first"]) >= 10
    of_template = {node[i] for i in range(60, len(texts))}
    assert any(u in of_template for u, v in tables["covering"]) and not any(u in of_template for u, v in tables["verified-first"])
