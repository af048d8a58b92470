"""The pipeline, stage by stage, against plain versions on a small corpus with every awkward row."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_line_dedup import brute_force
from test_quality_plain import plain_quality
from test_similar import plain_roots

WORDS = [a + b for a in ("ri", "sto", "wa", "fie", "qui", "mo", "le", "ha", "bu", "ne") for b in ("ver", "ne", "ll", "ld", "et", "re", "af", "nd", "sh", "st")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    said = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = []
    for i in range(160):
        lines = [said(rng.randrange(6, 20)) for _ in range(rng.randrange(1, 6))]
        rows.append((i, "\n".join(lines), ("en", "de")[i % 2], ("a", "b", None)[i % 3]))
    shared = rows[0][1].split("\n")[0]
    rows += [(200, shared + "\n" + said(30), "en", "a"), (201, rows[3][1], "en", "b"), (202, rows[4][1] + " end", "en", "a")]
    rows += [(300 + i, "".join(chr(rng.randrange(200, 900)) for _ in range(400)), "en", "a") for i in range(4)]
    rows += [(None, said(40), "en", "a"), (None, said(40), "en", "b"), (7, said(25), "en", "a"), (7, said(25), "de", "b"), (8, rows[8][1], "en", "c")]
    rows += [(400, None, "en", "a"), (401, "", None, None), (402, " \n ", "de", "b"), (403, said(3000), "en", "b")]
    at = tmp_path_factory.mktemp("pipeline")
    full = [(*r, len(r[1] or ""), 1, 2) for r in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, own_key int, row int").write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, 0) for i in range(160)] + [(300, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def order(rows):
    return sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.text is None))


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows, columns = order(docs.collect()), docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "mixing", "packing"]

    kept = stages["quality"](spark, docs, folder)
    verdicts = plain_quality([(r.doc_id, r.text, r.lang) for r in rows], set(range(160)))
    want = [r for r, v in zip(rows, verdicts) if v[3]]
    assert kept.columns == columns and order(kept.collect()) == want and len(want) < len(rows)

    # Lines: each text of an id is a document; brute_force numbers them in the operator's order.
    numbered = {(r.doc_id, r.text): None for r in want}
    keys = {r.text: r.k for r in kept.select("text", F.xxhash64("text").alias("k")).collect()}
    ranked = sorted(numbered, key=lambda d: (d[0] is None, d[0] or 0, keys[d[1]]))
    out = brute_force([(n, t) for n, (_, t) in enumerate(ranked)])
    place = {d: n for n, d in enumerate(ranked)}
    lined = stages["line_dedup"](spark, kept, folder)
    wanted = []
    for r in want:
        lines = (r.text or "").split("\n")
        left = [x for i, x in enumerate(lines) if (False, place[r.doc_id, r.text], i) not in out]
        if len(left) == len(lines):
            wanted.append(r.asDict())
        elif "".join(left).strip():
            wanted.append(r.asDict() | {"text": "\n".join(left), "n_chars": len("\n".join(left))})
    got = order(lined.collect())
    assert lined.columns == columns and sorted([r.asDict() for r in got], key=str) == sorted(wanted, key=str) and len(wanted) < len(want)

    near = stages["near_dedup"](spark, lined, folder)
    roots = plain_roots([r.text for r in got])
    first = {}
    for i, root in enumerate(roots):
        first.setdefault(root, set()).add((got[i].doc_id is None, got[i].doc_id or 0))
    left = order(near.collect())
    assert near.columns == columns and len(left) == len(first) < len(got)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left) == sorted(min(x) for x in first.values())
    assert all(r in got for r in left)

    mixed = stages["mixing"](spark, near, folder)
    times = {}
    for r in mixed.collect():
        times[r] = times.get(r, 0) + 1
    assert mixed.columns == columns and set(times) <= set(left) and max(times.values()) <= 3
    assert all(times[r] == 1 for r in left if not (r.text or "").split())

    pieces = stages["packing"](spark, mixed, folder)
    of = {}
    for p in pieces.collect():
        of.setdefault(p.doc_id, []).append(p)
        assert p.length & (p.length - 1) == 0 and p.length <= 2048 and p.offset == 0 and len(p.ids) == 4 * p.length
    for d, parts in of.items():
        copies = sum(n for r, n in times.items() if r.doc_id == d)
        assert sum(p.start == 0 for p in parts) == copies
    assert set(of) == {r.doc_id for r in times}


def test_run_and_its_scratch(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    again = corpus_pipeline.run(spark, folder)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(str, rows.select(columns).collect())) == sorted(map(str, again.select(columns).collect()))
    assert rows.columns == [*columns, "sequence_id", "offset"]
