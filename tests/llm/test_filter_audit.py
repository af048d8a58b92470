"""The filter audit against applying every order of the filters, one after the other."""

from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from strandline.llm.filter_audit import audit, audit_documents, measure

LABELS = "doc_id long, quality int, toxic int"


def fails(rows):
    """The five conditions, plainly."""
    smallest = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = [x for x in "".join(c if c not in " \t\n\x0b\x0c\r" else " " for c in t).split(" ") if x]
        found = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)}
        found |= {"D": any(c in "#$%&*|" for c in t), "E": i is not None and smallest.get(t, i) < i}
        out.append({k for k, v in found.items() if v})
    return out


def plain(rows, labels):
    bad = fails(rows)
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    out, shapley = {}, Counter()
    for part in {r[2] or "" for r in rows}:
        ids = [k for k, r in enumerate(rows) if (r[2] or "") == part]
        for order in permutations("ABCDE"):
            alive = list(ids)
            for step, f in enumerate(order, 1):
                gone = [k for k in alive if f in bad[k]]
                alive = [k for k in alive if f not in bad[k]]
                out[part, "".join(order), step] = [len(alive), len(gone), sum(f in bad[k] for k in ids) - len(gone), sum(bad[k] == {f} for k in ids), sum(rows[k][0] in good for k in gone), sum(rows[k][0] in toxic for k in gone)]
                shapley[part, f] += len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def made_up():
    words = " ".join(f"word{i}" for i in range(120))
    texts = [words, words + " #", "word " * 150, words.upper(), "SHORT $", None, "", "x", words, words, "ÉÉ A\x1fB \x0bC", "a " * 200 + "#", "é" * 50 + " ABCDE"]
    rows = [(i, t, ("en", "de", None, "")[i % 4]) for i, t in enumerate(texts * 2)]
    rows += [(None, words, "en"), (None, None, None), (3, "SHORT $", "fr"), (3, "SHORT $", "fr")]
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(20)] + [(3, 0, 1), (None, 1, 1), (5, None, None)]
    return rows, labels


def test_all_orders_against_the_plain_version(spark):
    rows, labels = made_up()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").select("*", F.lit(1).alias("part"), F.lit(2).alias("digest"), F.lit(True).alias("good_lost"))
    marks = spark.createDataFrame(labels, LABELS).withColumn("lang", F.lit("x"))
    found = audit_documents(docs, marks)
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in found.collect()}
    assert got == plain(rows, labels)
    assert dict(found.dtypes)["step"] == "int" and dict(found.dtypes)["shapley"] == "bigint"


def test_parts_without_survivors_have_zeros(spark):
    docs = spark.createDataFrame([(1, "", "en"), (2, "", "en")], "doc_id long, text string, lang string")
    rows = audit_documents(docs, spark.createDataFrame([], LABELS)).collect()
    assert len(rows) == 600 and all(r.kept == 0 for r in rows if r.filter_order[0] == "A")
    assert {r.removed for r in rows if r.filter_order.startswith("AE") and r.step > 1} == {0}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert audit_documents(docs, spark.createDataFrame([], LABELS)).collect() == []


def test_other_filters_and_null_conditions(spark):
    rows = spark.createDataFrame([("p", 1), ("p", 5), ("p", None), ("q", 9)], "part string, x int")
    found = audit(rows, {"small": F.col("x") < 4, "odd": F.col("x") % 2 == 1}, {}).collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found}
    assert got == {
        ("p", "smallodd", 1): (2, 1, 0, 0, 1), ("p", "smallodd", 2): (1, 1, 1, 1, 3), ("p", "oddsmall", 1): (1, 2, 0, 1, 3), ("p", "oddsmall", 2): (1, 0, 1, 0, 1),
        ("q", "smallodd", 1): (1, 0, 0, 0, 0), ("q", "smallodd", 2): (0, 1, 0, 1, 2), ("q", "oddsmall", 1): (0, 1, 0, 1, 2), ("q", "oddsmall", 2): (0, 0, 0, 0, 0),
    }


def test_words_of_long_texts_are_counted_in_passes():
    text = b"".join(b"w%d \x0bx " % (i % 3000) for i in range(20_000))
    assert measure(text, 1000) == measure(text) and measure(text)[:2] == (40_000, 3001)
