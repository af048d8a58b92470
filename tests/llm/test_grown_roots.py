"""Near dedup: components that later links join are found on their roots alone, not from all links again."""

import random

from strandline.llm import similar
from strandline.llm.scratch import Scratch
from test_covering_step import roots_of
from test_similar import corpus, plain_roots, same_classes


def test_grown_equals_all_links(spark):
    rng = random.Random(5)
    first = [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    later = [(rng.randrange(80), rng.randrange(80)) for _ in range(20)]
    for more in (later, []):
        before = dict(zip(range(80), roots_of(first, range(80))))
        roots = spark.createDataFrame([(n, r) for n, r in before.items() if n != r], "node long, root long")
        got = similar.grown(roots, spark.createDataFrame(more, "u long, v long"), Scratch(spark, "t")).collect()
        assert len(got) == len({r.node for r in got})
        assert {n: n for n in range(80)} | {r.node: r.root for r in got} == dict(zip(range(80), roots_of(first + more, range(80))))


def test_links_are_gone_through_once(spark, docs, monkeypatch):
    """Of the links by nearest sketches, none comes a second time; the classes stay those of all pairs."""
    sizes, whole = [], similar.components
    monkeypatch.setattr(similar, "components", lambda edges, scratch: sizes.append(edges.filter("u <> v").count()) or whole(edges, scratch))
    texts = corpus(random.Random(11))
    got = similar.similar_nodes(docs(list(enumerate(texts)))).select("doc_id", "root").collect()
    same_classes([r.root for r in sorted(got)], plain_roots(texts))
    assert sizes[0] > 2 * sum(sizes[1:])
