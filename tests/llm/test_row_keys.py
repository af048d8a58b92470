import random

from strandline.llm.kneser_ney import keep_quality
from strandline.llm.line_dedup import drop_duplicate_lines, line_report
from strandline.llm.simhash import keep_one


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_near_copies_by_row(spark, docs):
    a, b, c, d = (prose(i) for i in range(4))
    kept = keep_one(docs([(None, a), (None, b), (7, c), (7, d), (9, c)])).collect()
    assert sorted(r.text for r in kept) == sorted([a, b, c, d])
    assert len(keep_one(docs([(None, a), (None, a), (3, a), (3, a)])).collect()) == 1


def test_lines_by_row(spark, docs):
    first = "one two three four five six"
    rows = [(1, first), (None, first + "\n" + prose(1, 9)), (None, prose(2, 9) + "\n" + prose(3, 9)), (7, prose(4, 9) + "\n" + first), (7, prose(5, 9) + "\n" + prose(6, 9))]
    got = {r.text for r in drop_duplicate_lines(docs(rows)).collect()}
    assert got == {first, prose(1, 9), rows[2][1], prose(4, 9), rows[4][1]}
    assert sorted((r.doc_id or 0, r.exact) for r in line_report(docs(rows)).collect()) == [(0, 0), (0, 1), (1, 0), (7, 0), (7, 1)]


def test_quality_by_row(spark, docs):
    good = [(i, "the quiet river runs along the old stone wall and the green field " * 3) for i in range(60)]
    junk = "zq#xj%vk@@qz!!jx$$kq^^zv&&xq**jz " * 12
    rows = good + [(None, junk), (None, good[0][1]), (500, junk), (500, good[0][1])]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    kept = [(r.doc_id, r.text) for r in keep_quality(docs(rows), labels).collect()]
    assert sorted(kept, key=str) == sorted(good + [(None, good[0][1]), (500, good[0][1])], key=str)
