"""Near dedup shuffles whole texts once at its end, and keeps no table that nothing reads any more."""

import os
import random
import time
from glob import glob

import pytest

from strandline.llm import similar
from strandline.llm.scratch import CLEANUP, Scratch, made_within, shared_dir
from strandline.llm.simhash import one_of_each


def threes():
    """Thirty texts, each with two near copies after it."""
    rng, texts = random.Random(5), []
    for _ in range(30):
        base = [f"d{rng.randrange(10**6)}" for _ in range(100)]
        texts += [" ".join(base), " ".join(base[:-1]), " ".join(base[1:])]
    return texts


@pytest.mark.parametrize("kind, nullable", [("long", True), ("long", False), ("string", True)])
def test_one_shuffle_of_texts(spark, kind, nullable):
    ids = [1, 1, 2, 3, 3] + [None, None, None] * nullable
    texts = ["a", "a", "a", None, "b", "c", "c", None][: len(ids)]
    rows = [(i if i is None or kind == "long" else str(i), t) for i, t in zip(ids, texts)]
    schema = spark.createDataFrame([], f"doc_id {kind} {'' if nullable else 'NOT NULL'}, text string").schema
    table = spark.createDataFrame(rows, schema)
    groups = table.selectExpr("doc_id", "xxhash64(text) text_key", "xxhash64(text) root")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = one_of_each(table, groups)
        plan = kept._jdf.queryExecution().executedPlan().toString()
        # The groups by root, their first rows by id and text, and the rows themselves.
        assert plan.count("Exchange hashpartitioning") == 3
        got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    one, three = rows[0][0], rows[3][0]
    assert got == sorted([(one, "a"), (three, None), (three, "b")] + [(None, "c")] * nullable, key=str)


def test_tables_left(spark, docs):
    texts = threes()
    with made_within():
        before = set(glob(f"{shared_dir(spark).removeprefix('file:')}/similar-*"))
        groups = similar.similar_nodes(docs(list(enumerate(texts))))
        (own,) = set(glob(f"{shared_dir(spark).removeprefix('file:')}/similar-*")) - before
        left = sorted(name.split("-", 1)[1] for name in os.listdir(own) if not name.startswith("."))
        assert left.count("members") == 1 and set(left) <= {"members", "edges", "small"} and len(left) <= 3
        got = {r.doc_id: r.root for r in groups.collect()}
    assert len(set(got.values())) == 30 and all(got[i] == got[i // 3 * 3] for i in range(90))


def test_shuffles_go_once_saved(spark, docs):
    """Shuffle files of a saved table's plan go at once where that is asked for, and the session's setting stays."""
    folders = [str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    shuffles = lambda: {os.path.basename(f).split("_")[1] for folder in folders for f in glob(f"{folder}/*/shuffle_*.data")}
    with made_within():
        for clean, left in ((False, 6), (True, 0)):
            before, scratch = shuffles(), Scratch(spark, "cleaned", clean=clean)
            tables = [scratch.save(spark.range(100).repartition(2, "id"), f"t{i}") for i in range(6)]
            for _ in range(50):
                if len(shuffles() - before) <= left:
                    break
                time.sleep(0.1)
            assert len(shuffles() - before) <= left and all(t.count() == 100 for t in tables)
            assert spark.conf.get(CLEANUP) == "false"
        made, save = [], Scratch.save
        Scratch.save = lambda self, df, name: (made.append(self.clean), save(self, df, name))[1]
        try:
            similar.similar_nodes(docs(list(enumerate(threes()))))
        finally:
            Scratch.save = save
        assert len(made) > 8 and all(made)
