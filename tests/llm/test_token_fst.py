"""Token counts of the transducer against the library's own."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandline.llm import queries, token_fst
from strandline.llm.token_fst import START, Map, Transducer, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", "ing", "'", "'s", "'re", "'l", "'r", " ", "  ", "\n", "\t", " ", "　", "é", "ж", "字", "1", "23", "²", "!", "..", "<", "<|", "<|endoftext|>", "|>", "՘", "‍", "😀", "aaaaaaaa", "--------", "\x00", "\x85", "ﬃ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def transducer():
    return Transducer(PATH)


def want(library, texts):
    return [len(x.ids) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def got(transducer, texts):
    parts = [t.encode() for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    states, counts = transducer.whole(np.frombuffer(b"".join(parts), np.uint8), ends - [len(p) for p in parts], ends, [START] * len(parts))
    return [int(n) + transducer.ended(s) for n, s in zip(counts, states)]


def made_up(rng, n, parts=60):
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, parts))) for _ in range(n)]


@pytest.mark.parametrize("lane, few", [(7, 3), (64, 1000), (1 << 11, 1)])
def test_made_up_texts(transducer, library, monkeypatch, lane, few):
    monkeypatch.setattr(token_fst, "LANE_BYTES", lane)
    monkeypatch.setattr(token_fst, "FEW_LANES", few)
    texts = made_up(random.Random(lane), 600)
    assert got(transducer, texts) == want(library, texts)


def test_maps_compose_in_any_grouping(transducer, library):
    rng = random.Random(3)
    for text in made_up(rng, 150):
        data = text.encode()
        cuts = sorted(rng.randint(0, len(data)) for _ in range(5))
        maps = transducer.maps([data[i:j] for i, j in zip([0, *cuts], [*cuts, len(data)])])
        while len(maps) > 1:
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [transducer.compose(maps[i], maps[i + 1])]
        whole = transducer.compose(Map(b"", START, 0), maps[0])
        assert whole.count + transducer.ended(whole.state) == want(library, [text])[0]


def test_a_small_table_is_begun_anew(library):
    texts = made_up(random.Random(8), 300)
    small = Transducer(PATH, max_states=50)
    assert got(small, texts) == want(library, texts)
    assert len(small.states) < 5000


def test_states_are_the_same_in_any_worker(transducer):
    other = Transducer(PATH)
    for text in made_up(random.Random(9), 100):
        s = t = START
        for b in text.encode():
            s, t = transducer._step(s, b)[0], other._step(t, b)[0]
        assert s == t and other.ended(s) == transducer.ended(s)


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        Transducer(public_tokenizers.path("word_bpe_49k.json"))


def test_rows_nulls_and_clashing_columns(spark, docs, library):
    rows = [(1, "the cat's <|endoftext|> hat"), (2, None), (3, ""), (4, "x" * 5000), (1, "the cat's <|endoftext|> hat"), (None, " \n ")]
    df = docs(rows).select("*", F.lit(7).alias("n_tokens"), F.lit("y").alias("_bytes"), F.lit("z").alias("digest"))
    found = token_counts(df, PATH)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens"]
    key = lambda r: (r[0] is None, r)
    expect = [(i, len((t or "").encode()), n) for (i, t), n in zip(rows, want(library, [t for _, t in rows]))]
    assert sorted(map(tuple, found.collect()), key=key) == sorted(expect, key=key)
    assert token_counts(docs([]), PATH).collect() == []


def test_long_texts_are_dealt_by_chunks(spark, docs, library):
    rng = random.Random(1)
    texts = made_up(rng, 6, 400) + ["a" * 3000, "字" * 500 + ".", "ab " * 900]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0], None, "short"])]
    found = token_counts(docs(rows), PATH, long_bytes=200, chunk_bytes=17)
    assert {r.doc_id: r.n_tokens for r in found.collect()} == dict(zip(range(len(rows)), want(library, [t for _, t in rows])))


def test_a_text_of_megabytes(spark, docs, library):
    text = "Words, and 17 numbers; it's\n" * 120_000
    (row,) = token_counts(docs([(1, text)]), PATH, long_bytes=1 << 20).collect()
    assert row.n_tokens == want(library, [text])[0]


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in queries.op13_token_counts(spark, sf).collect()}
    texts = {r.doc_id: r.text for r in queries.documents(spark, sf).collect()}
    assert {i: r.n_tokens for i, r in rows.items()} == dict(zip(texts, want(library, texts.values())))
    assert all(r.over_limit == (r.n_tokens > 512) and r.n_bytes == len((texts[i] or "").encode()) for i, r in rows.items())
