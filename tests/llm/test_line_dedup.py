import random
from collections import defaultdict

from pyspark.sql import functions as F

from strandline.llm.line_dedup import drop_duplicate_lines, duplicate_lines, line_report


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(rows):
    """(doc, line) -> (near, earliest possible witnesses)."""
    units = []
    for doc, text in rows:
        for i, raw in enumerate((text or "").split("\n")):
            if w := raw.lower().split():
                units.append(((doc is None, doc or 0, i), w))
    units.sort(key=lambda u: u[0])
    units = [u for n, u in enumerate(units) if u not in units[:n]]
    out = {}
    for at, w in units:
        firsts = min(a for a, v in units if v == w)
        near = [a for a, v in units if a < firsts and v != w and one_edit(w, v)] if len(w) >= 5 else []
        if near or firsts < at:
            out[at] = (bool(near), near or [firsts])
    return out


def test_against_all_pairs(spark, docs):
    rng = random.Random(4)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.choice([4, 5, 6, 9, 12, 30]))] for _ in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(5)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i, kind = rng.randrange(len(w)), rng.randrange(3)
                w[i : i + (kind != 0)] = [] if kind == 2 else [f"x{rng.randrange(4)}"]
            lines.append(" ".join(w).upper() if rng.random() < 0.2 else "  ".join(w))
        rows.append((d * 7 % 60, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "\n \n"), (None, " ".join(base[0]) + "\nq w e r t y"), (103, "q w e r t y"), (104, "q w e r t y\n\nq w e r t"), (105, " ".join(f"n{i}" for i in range(900))), (106, " ".join(f"n{i}" if i != 40 else "?" for i in range(900))), (5, rows[[d for d, _ in rows].index(5)][1])]
    rows += [(300, "All rights\n\nall  RIGHTS\nx"), (301, "x\ny"), (302, " ".join(f"k{i}" for i in range(300))), (303, " ".join(f"k{i}" for i in range(300) if i != 5))]
    rows += [(200 + i, f"page {i} of the whole book here") for i in range(40)]
    table = docs(rows)
    for name in ("line", "words", "h1", "_out", "_id", "row", "their_id", "own_id", "new", "which", "keep_doc"):
        table = table.withColumn(name, F.lit(1))
    want = brute_force(rows)
    got = {(r.doc_id is None, r.doc_id or 0, r.line): r for r in duplicate_lines(table).collect()}
    assert set(got) == set(want)
    for at, r in got.items():
        near, witnesses = want[at]
        assert r.near == near
        assert (r.keep_doc is None, r.keep_doc or 0, r.keep_line) in witnesses
    report = {r.doc_id: r for r in line_report(table).collect()}
    assert report[100].lines == 0 and report[104].dropped == "0,2" and report[106].near == 1 and report[106].exact == 0
    assert report[300].dropped == "2" and report[301].dropped == "0" and report[303].near == 1 and report[102].lines == 0
    cleaned = drop_duplicate_lines(table)
    assert cleaned.columns == table.columns
    left = defaultdict(list)
    for r in cleaned.collect():
        left[r.doc_id].append(r.text)
    assert left[100] == [None] and left[101] == [""] and 104 not in left and 106 not in left
    for d, t in rows:
        if all(a[1] != d for a in want) and d is not None:
            assert left[d] and set(left[d]) == {t}
    assert left[200] == [rows[-40][1]] and 201 not in left


def test_empty(spark, docs):
    assert duplicate_lines(docs([])).count() == 0
    assert drop_duplicate_lines(docs([])).count() == 0
    assert line_report(docs([(1, None)])).collect()[0].lines == 0


def test_blank_lines_and_long_texts(spark, docs):
    rows = [(1, "\r\n\t\n a"), (2, "\n".join(f"line {i} of these" if i % 3 else "again and again it comes" for i in range(60_000)))]
    report = {r.doc_id: r for r in line_report(docs(rows)).collect()}
    assert report[1].lines == 1 and report[2].lines == 60_000 and report[2].exact == 19_999
    kept = {r.doc_id: r.text for r in drop_duplicate_lines(docs(rows)).collect()}
    lines = rows[1][1].split("\n")
    assert kept[2] == "\n".join(x for i, x in enumerate(lines) if i % 3 or not i) and kept[1] == rows[0][1]


def test_hot_keys(spark, docs):
    """More rows of a line, of a half and of one variant than a key may have, against the plain version."""
    rows = [(i, "the one line that all of them have\nsome words before this number " + f"n{i}") for i in range(700)]
    rows += [(1000 + i, f"x{i} and then the same end of it") for i in range(300)]
    want = brute_force(rows)
    got = {(False, r.doc_id, r.line): r.near for r in duplicate_lines(docs(rows)).collect()}
    assert got == {at: near for at, (near, _) in want.items()} and len(got) == 699 * 2 + 299
