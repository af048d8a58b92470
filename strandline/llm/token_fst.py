"""Token counts by a byte-level BPE vocabulary compiled to a finite-state transducer.

The transducer reads UTF-8 bytes; each transition is annotated with the tokens
that it adds to (or, where a byte lets tokens merge, takes from) the count. Its
states hold what later bytes can still change: the class of the open word, and for every
suffix of it that begins some token, the last token in front of that suffix. That
is enough, since a sequence of tokens is the encoding of its bytes exactly if each
pair of neighbours is the encoding of its own bytes (Berglund and van der Merwe 2023). States and
transitions are made when a text first needs them and kept in one table.

A chunk of a text that begins in an unknown state is a map of states. Behind the
first change of class in it (a letter and a space, a digit and a dot) the state is the same
whatever came before, so the map is short: the bytes up to there, its head, then one
state and one count. Maps compose by running the head of the second from the state in
which the first ends, which is associative, so counts of a text are a prefix scan over the
maps of its chunks.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from tokenizers import Tokenizer

from strandline.llm.packing import _byte_of_symbol

#: Words by what they begin with: nothing yet, letters, digits, other characters, white space whose last
#: character may go to the next word, an apostrophe, an apostrophe and a letter that may end a contraction.
NONE, LETTERS, DIGITS, OTHERS, SPACES, APOSTROPHE, SHORTENED = range(7)
#: The contractions that the split pattern of this family of vocabularies makes words; fixed values.
SHORT, LONG = frozenset(b"stmd"), frozenset({b"re", b"ve", b"ll"})
#: States kept in a worker's table, about a kilobyte each; beyond, the table is begun anew.
MAX_STATES = 200_000
LANE_BYTES, BLOCK_BYTES = 1 << 11, 1 << 22
#: Rows beyond them, as states are made between two looks at their number.
SPARE = 1 << 16
#: Fewer lanes than these run one after the other.
FEW_LANES = 12
#: Texts of more bytes are dealt over tasks by chunks.
LONG_BYTES, CHUNK_BYTES = 1 << 23, 1 << 20
#: Maps composed by one task of a level, and levels: their product holds the chunks of the longest text, which has 2**31 bytes.
FAN, LEVELS = 64, 2


class Pairs:
    """Which tokens of a vocabulary can be neighbours."""

    def __init__(self, spec: dict) -> None:
        vocab, byte_of = spec["model"]["vocab"], _byte_of_symbol()
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(merges)}
        made = {vocab[a + b]: (vocab[a], vocab[b], i) for i, (a, b) in reversed(list(enumerate(merges)))}
        if any(made[c][2] >= i for c, (a, b, i) in made.items() for c in (a, b) if c in made):
            raise ValueError("a merge comes before the ones that make its parts")
        #: The tokens at a token's right (left) edge while it is being merged, each with the rank of the merge that ends it.
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        #: Both parts of a merged token and the rank of its merge; -1 for bytes.
        self.parts = [(-1, -1, len(merges))] * (max(vocab.values()) + 1)
        for t, found in made.items():
            self.parts[t] = found
        unmade = set()
        for t, (a, b, i) in sorted(made.items(), key=lambda x: x[1][2]):
            if a in unmade or b in unmade or not self._apart(a, b, i):
                unmade.add(t)
        #: Tokens that encode their own bytes; no other is ever emitted.
        self.tokens = {bytes(byte_of[c] for c in s): t for s, t in vocab.items() if t not in unmade and all(c in byte_of for c in s)}

    def _edge(self, t: int, side: int) -> list[tuple[int, int]]:
        """The tokens at a token's left (0) or right (1) edge while it is being merged, each with the rank of the merge that ends it."""
        out, end = [], len(self.rank)
        while t >= 0:
            out.append((t, end))
            *parts, rank = self.parts[t]
            t, end = parts[side], min(rank, end)
        return out

    def _apart(self, a: int, b: int, before: int) -> bool:
        """No merge of a rank under ``before`` joins an edge of a with an edge of b while both stand."""
        starts = self._edge(b, 0)
        for x, end_x in self._edge(a, 1):
            for y, end_y in starts:
                # of equal merges the left one goes first: it ends x before, y after the crossing one
                if (m := self.rank.get((x, y))) is not None and m < before and m < end_x and m <= end_y:
                    return False
        return True

    def fit(self, a: int, b: int) -> bool:
        """The encoding of a's bytes and b's bytes together is a, b."""
        return self._apart(a, b, len(self.rank))


class State(NamedTuple):
    kind: int
    #: For the open word: of each suffix that begins a token, its node, the token before it, tokens less than all.
    word: tuple[int, ...]
    #: What is read but not yet dealt to a word: the last white space, or the letter after an apostrophe.
    tail: bytes
    #: Bytes of a character that is not complete.
    part: bytes
    #: What is read of a special token.
    special: bytes


#: No byte of a word is read.
EMPTY = (0, -1, 0)
START = State(NONE, EMPTY, b"", b"", b"")


class Transducer:
    """Counts tokens of byte-level BPE files of the ``tokenizers`` library as that library does by default."""

    def __init__(self, path: str, max_states: int = MAX_STATES) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind, model = spec["pre_tokenizer"] or {}, spec["model"]
        plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space")
        if not plain or spec["normalizer"] is not None or model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("a plain byte-level BPE file is asked for")
        self.library = Tokenizer.from_file(path)
        added = spec["added_tokens"]
        self.specials = {t["content"].encode() for t in added}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added) or any(s.find(o[:1], 1) >= 0 for s in self.specials for o in self.specials):
            raise ValueError("special tokens that overlap or take white space are not supported")
        self.prefixes = {s[:n] for s in self.specials for n in range(1, len(s) + 1)}
        self.pairs = Pairs(spec)
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for text, token in self.pairs.tokens.items():
            at = 0
            for b in text:
                if b not in self.trie[at]:
                    self.trie[at][b] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                at = self.trie[at][b]
            self.token_at[at] = token
        self.classes: dict[bytes, int] = {}
        self.max_states = max_states
        self.column, self.byte_of, self.seen = np.full(256, -1, np.int16), np.zeros(256, np.uint8), 0
        self._begin(128)

    def _begin(self, columns: int) -> None:
        self.states, self.ids = [START], {START: 0}
        #: Next state and count of tokens by state and column; 0: not made yet. A column is a byte that texts hold.
        #: Rows take memory once they are written.
        self.table = np.zeros((self.max_states + SPARE, columns), np.int32)

    # -- one word

    def _grow(self, word: tuple[int, ...], byte: int) -> tuple[tuple[int, ...], int]:
        kept, found, more = [], -1, 0
        for node, before, less in zip(word[::3], word[1::3], word[2::3]):
            node = self.trie[node].get(byte)
            if node is None:
                continue
            token = self.token_at[node]
            if token >= 0 and found < 0 and (before < 0 or self.pairs.fit(before, token)):
                found, more = token, less + 1
            if self.trie[node]:
                kept += node, before, less
        if more:
            kept[2::3] = [less - more for less in kept[2::3]]
        return (*kept, 0, found, 0), more

    def _spell(self, text: bytes, word: tuple[int, ...] = EMPTY) -> tuple[tuple[int, ...], int]:
        total = 0
        for b in text:
            word, more = self._grow(word, b)
            total += more
        return word, total

    # -- characters

    def _class(self, char: bytes) -> int:
        """As the library splits it; bytes that are no character count as other characters."""
        if (out := self.classes.get(char)) is None:
            try:
                c = char.decode()
                begins = {at for _, (at, _) in self.library.pre_tokenizer.pre_tokenize_str(f"a{c}1{c}!{c}")}
                out = LETTERS if 1 not in begins else DIGITS if 3 not in begins else OTHERS if 5 not in begins else SPACES
            except UnicodeDecodeError:
                out = OTHERS
            self.classes[char] = out
        return out

    def _fresh(self, char: bytes, kind: int) -> tuple[State, int]:
        """The character begins a word."""
        if kind == SPACES:
            return START._replace(kind=SPACES, tail=char), 0
        if char == b"'":
            return START._replace(kind=APOSTROPHE), 0
        word, more = self._spell(char)
        return State(kind, word, b"", b"", b""), more

    def _char(self, s: State, char: bytes) -> tuple[State, int]:
        kind = self._class(char)
        if s.kind == kind and kind != SPACES:
            word, more = self._spell(char, s.word)
            return s._replace(word=word), more
        if s.kind == SPACES:
            if kind == SPACES:
                word, more = self._spell(s.tail, s.word)
                return s._replace(word=word, tail=char), more
            if s.tail == b" ":
                word, more = self._spell(b" " + char)
                return State(kind, word, b"", b"", b""), more
            _, more = self._spell(s.tail)
            out, rest = self._fresh(char, kind)
            return out, more + rest
        if s.kind == APOSTROPHE:
            if len(char) == 1 and char[0] in SHORT:
                return START, self._spell(b"'" + char)[1]
            if any(x[:1] == char for x in LONG):
                return s._replace(kind=SHORTENED, tail=char), 0
            word, more = self._spell(b"'")
            out, rest = self._char(State(OTHERS, word, b"", b"", b""), char)
            return out, more + rest
        if s.kind == SHORTENED:
            if s.tail + char in LONG:
                return START, self._spell(b"'" + s.tail + char)[1]
            word, more = self._spell(s.tail)
            out, rest = self._char(State(LETTERS, word, b"", b"", b""), char)
            return out, self._spell(b"'")[1] + more + rest
        return self._fresh(char, kind)

    def _byte(self, s: State, byte: int) -> tuple[State, int]:
        """A byte that is in no special token."""
        total, b = 0, bytes([byte])
        if s.part:
            lead = s.part[0]
            if 0x80 <= byte < 0xC0:
                part = s.part + b
                if len(part) < (2 if lead < 0xE0 else 3 if lead < 0xF0 else 4):
                    return s._replace(part=part), 0
                return self._char(s._replace(part=b""), part)
            s, total = self._char(s._replace(part=b""), s.part)
        if 0xC2 <= byte < 0xF5:
            return s._replace(part=b), total
        out, more = self._char(s, b)
        return out, total + more

    def _step(self, s: State, byte: int) -> tuple[State, int]:
        b, total = bytes([byte]), 0
        if s.special or (b in self.prefixes and not s.part):
            held = s.special + b
            if held in self.specials:
                return START, self.ended(s._replace(special=b"")) + 1
            if held in self.prefixes:
                return s._replace(special=held), 0
            held, s = s.special, s._replace(special=b"")
            for x in held:
                s, more = self._byte(s, x)
                total += more
            if b in self.prefixes and not s.part:
                return s._replace(special=b), total
        out, more = self._byte(s, byte)
        return out, total + more

    def ended(self, s: State) -> int:
        """Tokens that the end of a text adds in this state."""
        total, held, part = 0, s.special, s.part
        s = s._replace(special=b"", part=b"")
        for x in held:
            s, more = self._byte(s, x)
            total += more
        if part:
            s, more = self._char(s, part)
            total += more
        if s.kind == SPACES:
            total += self._spell(s.tail, s.word)[1]
        elif s.kind in (APOSTROPHE, SHORTENED):
            total += self._spell(b"'")[1] + self._spell(s.tail)[1]
        return total

    # -- tables

    def number(self, s: State) -> int:
        at = self.ids.setdefault(s, len(self.states))
        if at == len(self.states):
            self.states.append(s)
            if at == len(self.table):
                self.table = np.pad(self.table, [(0, SPARE), (0, 0)])
        return at

    def columns(self, data: np.ndarray) -> np.ndarray:
        """The bytes as columns of the table, which has one for each byte ever seen."""
        for b in np.flatnonzero((np.bincount(data, minlength=256) > 0) & (self.column < 0)).tolist():
            if self.seen == self.table.shape[1]:
                self.table = np.pad(self.table, [(0, 0), (0, self.seen)])
            self.column[b], self.byte_of[self.seen] = self.seen, b
            self.seen += 1
        return self.column[data]

    def _make(self, state: int, column: int) -> int:
        out, more = self._step(self.states[state], int(self.byte_of[column]))
        to = self.number(out)
        self.table[state, column] = step = to << 12 | more + (1 << 11)
        return step

    def _renew(self, now: np.ndarray) -> np.ndarray:
        """An empty table, if the old one is full, and these states' numbers in it."""
        if len(self.states) <= self.max_states:
            return now
        kept = [self.states[i] for i in now.tolist()]
        self._begin(self.table.shape[1])
        return np.array([self.number(s) for s in kept], np.int64)

    def run(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, states: list[State]) -> tuple[list[State], np.ndarray]:
        """Run lanes of ``columns`` side by side, a byte of each at once: the states that they end in, and their counts."""
        order = np.argsort(begins - ends, kind="stable")
        at, long = begins[order], (ends - begins)[order]
        now = np.array([self.number(states[i]) for i in order], np.int64)
        counts = np.zeros(len(order), np.int64)
        running = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), side="left")
        for k, n in enumerate(running.tolist()):
            if n < FEW_LANES:
                break
            if (k & 63) == 0:
                now = self._renew(now)
            width, read = self.table.shape[1], data[at[:n] + k]
            step = self.table.ravel()[now[:n] * width + read]
            if (lost := np.flatnonzero(step == 0)).size:
                for x, c in {*zip(now[lost].tolist(), read[lost].tolist())}:
                    self._make(x, c)
                step = self.table.ravel()[now[:n] * width + read]
            now[:n] = step >> 12
            counts[:n] += (step & 0xFFF) - (1 << 11)
        else:
            k = len(running)
        for i in range(int((long > k).sum())):
            now[i], counts[i] = self._run_one(data[at[i] + k : at[i] + long[i]], now, i, int(counts[i]))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return [self.states[i] for i in now[back].tolist()], counts[back]

    def _run_one(self, data: np.ndarray, lanes: np.ndarray, i: int, count: int) -> tuple[int, int]:
        now = int(lanes[i])
        for lo in range(0, len(data), 4096):
            lanes[i] = now
            lanes[:] = self._renew(lanes)
            now = int(lanes[i])
            for c in data[lo : lo + 4096].tolist():
                step = self.table.item(now, c)
                if step == 0:
                    step = self._make(now, c)
                now, count = step >> 12, count + (step & 0xFFF) - (1 << 11)
        return now, count

    # -- maps of chunks

    def settled(self, chunk: bytes) -> tuple[int, State] | None:
        """Where the state is the same whatever came before the chunk, and that state.

        It is behind a character of another class than the one before it, unless those are an
        apostrophe and a letter, and unless a special token may be open.
        """
        state, last, was, at = START, b"", -1, 0
        while at < len(chunk):
            n = 1 if chunk[at] < 0xC2 else 2 if chunk[at] < 0xE0 else 3 if chunk[at] < 0xF0 else 4
            for b in chunk[at : at + n]:
                state = self._step(state, b)[0]
            char = chunk[at : at + n]
            at += n
            if state.part or (at <= 3 and 0x80 <= char[0] < 0xC0):  # not a whole character, or the end of one that began before
                was = -1
                continue
            kind = self._class(char)
            if was >= 0 and kind != was and not state.special and not (last == b"'" and kind == LETTERS) and not any(chunk[:at] in s for s in self.specials):
                return at, state
            last, was = char, kind
        return None

    def maps(self, chunks: list[bytes]) -> list[Map]:
        """The map of each chunk; chunks run side by side, and each in lanes that are cut where states are settled."""
        heads, texts = [], []
        for c in chunks:
            found = self.settled(c)
            heads.append((c, None) if found is None else (c[: found[0]], found[1]))
            texts.append(b"" if found is None else c[found[0] :])
        ends = np.cumsum([len(t) for t in texts])
        states, counts = self.whole(np.frombuffer(b"".join(texts), np.uint8), ends - [len(t) for t in texts], ends, [s or START for _, s in heads])
        return [Map(h, None if s is None else end, 0 if s is None else n) for (h, s), end, n in zip(heads, states, counts.tolist())]

    def whole(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, states: list[State]) -> tuple[list[State], np.ndarray]:
        """Run texts from given states: each is cut in lanes that begin where the state is settled."""
        lanes, firsts, of = [], [], []
        for i, (begin, end) in enumerate(zip(begins.tolist(), ends.tolist())):
            at, state = begin, states[i]
            cut = at + LANE_BYTES
            while cut < end:
                found = self.settled(data[cut : min(end, cut + LANE_BYTES)].tobytes())
                if found is not None:
                    lanes.append((at, cut + found[0]))
                    firsts.append(state)
                    of.append(i)
                    at, state = cut + found[0], found[1]
                cut = (cut if found is None else at) + LANE_BYTES
            lanes.append((at, end))
            firsts.append(state)
            of.append(i)
        spans = np.array(lanes, np.int64).reshape(-1, 2)
        out, counts = self.run(self.columns(data), spans[:, 0], spans[:, 1], firsts)
        last = {i: s for i, s in zip(of, out)}
        return [last[i] for i in range(len(begins))], np.bincount(np.array(of, np.int64), counts, len(begins)).astype(np.int64)

    def compose(self, a: Map, b: Map) -> Map:
        """First a, then b."""
        if a.state is None:
            return Map(a.head + b.head, b.state, b.count)
        head = np.frombuffer(b.head, np.uint8)
        (state,), (count,) = self.run(self.columns(head), np.zeros(1, np.int64), np.array([len(head)]), [a.state])
        return Map(a.head, state if b.state is None else b.state, a.count + int(count) + b.count)


class Map(NamedTuple):
    """A chunk as a map of states: the head runs from the state before; then, unless None, ``state`` and ``count`` hold."""

    head: bytes
    state: State | None
    count: int


@cache
def _transducer(path: str) -> Transducer:
    return Transducer(path)


def _counts(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Last column: the text; out: the other columns and the count."""
    transducer = _transducer(path)
    for batch in batches:
        text = batch.column(batch.num_columns - 1)
        kind = np.int64 if pa.types.is_large_binary(text.type) else np.int32
        offsets = np.frombuffer(text.buffers()[1], kind)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        counts = np.empty(len(text), np.int64)
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BLOCK_BYTES, side="right")) - 1)
            begin, end = int(offsets[lo]), int(offsets[hi])
            states, found = transducer.whole(data[begin:end], offsets[lo:hi] - begin, offsets[lo + 1 : hi + 1] - begin, [START] * (hi - lo))
            counts[lo:hi] = found + [transducer.ended(s) for s in states]
            lo = hi
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], schema=schema)


MAPPED = "digest string, at int, head binary, state binary, count long"


def _chunk_maps(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    transducer = _transducer(path)
    for batch in batches:
        for i in range(batch.num_rows):  # one chunk at once: each is a mebibyte, and has many lanes
            (m,) = transducer.maps([batch.column(2)[i].as_py()])
            row = [batch.column(0)[i], batch.column(1)[i], m.head, m.state and pickle.dumps(tuple(m.state)), m.count]
            yield pa.RecordBatch.from_arrays([pa.array([x if isinstance(x, bytes | int | None) else x.as_py()], f.type) for x, f in zip(row, schema)], schema=schema)


def _composed(group: pa.Table, path: str) -> pa.Table:
    """Maps of one text that follow each other, as one."""
    transducer = _transducer(path)
    rows = group.sort_by("at")
    out = None
    for head, state, count in zip(rows["head"], rows["state"], rows["count"]):
        m = Map(head.as_py(), State(*pickle.loads(state.as_py())) if state.is_valid else None, count.as_py())
        out = m if out is None else transducer.compose(out, m)
    at = rows["at"][0].as_py() // FAN
    return pa.table([[rows["digest"][0].as_py()], [at], [out.head], [out.state and pickle.dumps(tuple(out.state))], [out.count]], schema=group.schema)


def _ended(batches: Iterator[pa.RecordBatch], path: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    transducer = _transducer(path)
    for batch in batches:
        counts = []
        for head, state, count in zip(*(batch.column(c).to_pylist() for c in ("head", "state", "count"))):
            whole = transducer.compose(Map(b"", START, 0), Map(head, state and State(*pickle.loads(state)), count))
            counts.append(whole.count + transducer.ended(whole.state))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], schema=schema)


def _dealt_counts(long: DataFrame, tokenizer: str, chunk_bytes: int) -> DataFrame:
    """``long(_digest, _bytes)`` -> (_digest, n_tokens), each text's chunks dealt over tasks, equal texts once."""
    chunks = long.select(F.col("_digest").alias("digest"), F.expr(f"transform(sequence(0, (octet_length(_bytes) - 1) div {chunk_bytes}), i -> substring(_bytes, i * {chunk_bytes} + 1, {chunk_bytes}))").alias("chunks"))
    rows = chunks.select("digest", F.posexplode("chunks").alias("at", "chunk")).groupBy("digest", "at").agg(F.first("chunk").alias("chunk"))
    schema = to_arrow_schema(T._parse_datatype_string(MAPPED))
    maps = rows.mapInArrow(lambda it: _chunk_maps(it, tokenizer, schema), MAPPED)
    for _ in range(LEVELS):
        maps = maps.groupBy("digest", F.floor(F.col("at") / FAN).alias("_block")).applyInArrow(lambda t: _composed(t, tokenizer), MAPPED)
    out = T._parse_datatype_string("_digest string, n_tokens long")
    return maps.mapInArrow(lambda it: _ended(it, tokenizer, to_arrow_schema(out)), out)


def token_counts(docs: DataFrame, tokenizer: str, *, long_bytes: int = LONG_BYTES, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, n_bytes (of UTF-8), n_tokens, one row per row of ``docs``.

    As the library counts by default, without begin or end tokens: a special token's string within a
    text is that token. Null texts count as empty and have no tokens, repeated rows give a row each, an
    empty table gives none, other columns are not read. Texts of up to ``long_bytes`` are counted where they are
    read, without a shuffle. Longer ones are cut in chunks of ``chunk_bytes``, dealt over tasks; a
    text that has a single class of characters throughout (no space, no dot) has maps that are all head,
    and is composed in one task. ``tokenizer`` is the file's path on every node.
    """
    slim = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("_bytes"))
    size = F.octet_length("_bytes").cast("long")
    out = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("n_bytes", "long").add("n_tokens", "long")
    arrow = to_arrow_schema(out)
    short = slim.filter(size <= long_bytes).select("doc_id", size.alias("n_bytes"), "_bytes").mapInArrow(lambda it: _counts(it, tokenizer, arrow), out)
    long = slim.filter(size > long_bytes).withColumn("_digest", F.sha2("_bytes", 256))
    counted = _dealt_counts(long, tokenizer, chunk_bytes)
    return short.unionByName(long.select("doc_id", size.alias("n_bytes"), "_digest").join(counted, "_digest").drop("_digest"))
