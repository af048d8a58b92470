"""The trie of conversations against one that holds all of them."""

import random
from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from strandline.llm import prefix_trie as module
from strandline.llm.prefix_trie import ordered_turns, prefix_trie, spliced_trie

TURNS = "conv_id long, turn long, role string, text string"


def words(text):
    return len("".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).replace(" ", "\0").replace("\0\0", "\0").strip("\0").split("\0")) if text.strip(" \t\n\x0b\x0c\r") else 0


def in_order(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", sha256((text or "").encode()).digest(), text or ""))
    return {c: [(r, t) for _, _, r, _, t in sorted(v)] for c, v in convs.items()}


def spliced(convs, group=20, shared=4):
    out = {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % shared
        base = c - (c % group if c >= 0 else -(-c % group))
        out[c] = convs.get(base, [])[:h] + own[h:]
    return out


def plain(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * words(node[-1][1]) if node else 0)
    digest = lambda node: sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
    return sorted((min(m), len(x), min(members[x[:-1]]) if x else None, len(m), len(children[x]), leaves[x], saved[x], digest(x)) for x, m in members.items())


def rows_of(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.collect()))


def test_spliced_with_nulls_ties_and_clashing_columns(spark):
    rng = random.Random(2)
    texts = ["a b", "a  b\n", "", None, "x" * 50, "é ü", "\x0b q\x1f w"]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in [*range(-45, 90), 10**12] for t in range(rng.randint(1, 6))]
    rows += [(7, None, "user", "no turn"), (7, None, "user", "no turn"), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 1, None, "tie"), (None, 0, "user", "nobody's")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, TURNS).select("*", F.lit(1).alias("place"), F.lit("k").alias("key"), F.lit(2).alias("n"), F.lit(3).alias("depth"))
    assert rows_of(spliced_trie(df).drop("key", "parent")) == plain(spliced(in_order(rows)))


@pytest.mark.parametrize("fan, table", [(2, 5), (64, 50_000)])
def test_merges_of_many_small_tables(spark, monkeypatch, fan, table):
    monkeypatch.setattr(module, "FAN", fan)
    monkeypatch.setattr(module, "TABLE_NODES", table)
    monkeypatch.setattr(module, "BLOCK_IDS", 16)
    rng = random.Random(4)
    rows = [(c, t, "user", f"w {rng.randint(0, 2)}") for c in range(-40, 120) for t in range(rng.randint(1, 7))]
    df = spark.createDataFrame(rows, TURNS).repartition(7)
    assert rows_of(spliced_trie(df).drop("key", "parent")) == plain(spliced(in_order(rows)))


def test_deep_shared_conversations(spark):
    path = [("user", f"turn {t}") for t in range(70)]
    convs = {1: path, 2: path, 3: path[:40] + [("user", "other")], 4: path[:13], 5: path[:40] + [("user", "other"), ("user", "more")]}
    rows = [(c, t, r, x) for c, p in convs.items() for t, (r, x) in enumerate(p)]
    assert rows_of(prefix_trie(ordered_turns(spark.createDataFrame(rows, TURNS))).drop("key", "parent")) == plain(convs)


def test_a_third_of_all_conversations_alike(spark):
    rows = [(c, t, "user", "the same words" if c % 3 == 0 else f"{c} {t}") for c in range(900) for t in range(4)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert rows_of(spliced_trie(spark.createDataFrame(rows, TURNS)).drop("key", "parent")) == plain(spliced(in_order(rows)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_conversations_without_turns_and_empty_tables(spark):
    none = spark.createDataFrame([], TURNS)
    assert spliced_trie(none).collect() == []
    alone = prefix_trie(ordered_turns(none), spark.createDataFrame([(5,), (3,)], "conv_id long"))
    assert rows_of(alone.drop("key", "parent")) == [(3, 0, None, 2, 0, 1, 0, sha256(b"3,5").hexdigest())]
    # Conversation 2 keeps none of its own turns and finds no first conversation.
    h = {c: crc32(str(c).encode()) % 4 for c in range(21, 40)}
    c = next(c for c in h if h[c] == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    assert rows_of(spliced_trie(spark.createDataFrame(rows, TURNS)).drop("key", "parent")) == plain({c: []})
