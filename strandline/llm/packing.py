"""Packing by power-of-two decomposition.

A document of n tokens becomes n // max_tokens full pieces and one piece for
each binary digit of the rest, longest first. Each piece is a sequence by
itself, so that no sequence crosses documents and none needs padding; sequences
of one length share a bucket, from which batches of equal shape are drawn
(dataset decomposition, Pouransari et al. 2024).

Only narrow work: every task packs the documents that it reads, and numbers its
sequences within (length, task). No shuffle, and lost tasks are simply redone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

MAX_TOKENS = 2048
END_ID = 1
#: The split pattern of byte-level BPE vocabularies of this family; a fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK_CHARS = 1 << 16
BATCH_PIECES = 4096


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level BPE writes each byte as a printable character; this undoes it."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Token ids of a byte-level BPE file of the ``tokenizers`` library.

    Where the file's merges are in the order of their ids, which is what
    ranked BPE assumes, the quicker encoder does the work; the library's own
    does it otherwise, or if the quick one gives up on a text.
    """

    def __init__(self, path: str) -> None:
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte_of = spec["model"]["vocab"], _byte_of_symbol()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        order = [vocab[a + b] for a, b in pairs]
        kind = spec["pre_tokenizer"] or {}
        added = {t["content"] for t in spec["added_tokens"]}
        self.quick = None
        if order == sorted(set(order)) and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and spec["normalizer"] is None:
            ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added}
            self.quick = tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        parts = [self._part(p) for p in safe_parts(text)]
        return np.concatenate(parts) if parts else np.empty(0, "<u4")

    def _part(self, text: str) -> np.ndarray:
        if self.quick is not None:
            try:
                return np.array(self.quick.encode_ordinary(text), "<u4")
            except BaseException as e:  # the encoder's own panics derive from BaseException
                if isinstance(e, KeyboardInterrupt | SystemExit | MemoryError):
                    raise
        return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")


def safe_parts(text: str, size: int = CHUNK_CHARS) -> Iterator[str]:
    """Parts whose ids, put together, are those of the whole text.

    A space after a character that is no white space always begins a new word
    of the split pattern, so a cut in front of it changes nothing.
    """
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and text[cut - 1].isspace():
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


@cache
def _encoder(path: str) -> ByteBpe:
    return ByteBpe(path)


def piece_lengths(n: int, max_tokens: int = MAX_TOKENS) -> list[int]:
    full, rest = divmod(n, max_tokens)
    return [max_tokens] * full + [1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1]


def _pack(batches: Iterator[pa.RecordBatch], path: str, end_id: int, max_tokens: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    encoder, task = _encoder(path), TaskContext.get().partitionId()
    seen = [0] * 64
    rows: list[tuple] = []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(encoder.encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4", copy=False)
            start = 0
            for length in piece_lengths(len(ids), max_tokens):
                bucket = length.bit_length() - 1
                rows.append((doc, start, length, ids[start : start + length].tobytes(), len(ids), (bucket << 58) + (task << 34) + seen[bucket], 0, bucket))
                seen[bucket] += 1
                start += length
            if len(rows) >= BATCH_PIECES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


PIECE = [("start", "long"), ("length", "long"), ("ids", "binary"), ("doc_tokens", "long"), ("sequence_id", "long"), ("offset", "long"), ("bucket", "integer")]


def pack_power_of_two(docs: DataFrame, tokenizer: str, *, end_id: int = END_ID, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per piece.

    doc_id, start (ids of the document before the piece), length, ids (binary,
    little-endian unsigned 32-bit), doc_tokens (with the end id), sequence_id,
    offset (always 0), bucket (log2 of the length). A null text counts as
    empty and gives the end id alone; repeated rows are packed each by itself;
    an empty table gives no rows. ``max_tokens`` must be a power of two.
    ``tokenizer`` is the path of the file on every node.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    key = docs.schema["doc_id"].dataType
    out = T.StructType().add("doc_id", key)
    for name, kind in PIECE:
        out = out.add(name, kind)
    arrow = to_arrow_schema(out)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(lambda it: _pack(it, tokenizer, end_id, max_tokens, arrow), out)
