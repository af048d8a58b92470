"""The trie of conversations by their turns: which beginnings are shared, and what sharing them saves.

A node is a sequence of turns, and its key a chained SHA-256 of them, so equal beginnings
have equal keys wherever they are met. Each task reads its conversations in order and keeps
a partial trie: a table of nodes with members summed, and lists of the conversations that
end there. Partial tries merge by key in a tree: one level joins the tables of ``FAN``
tasks, so a beginning that all conversations share sends a few rows a level. Lists of ends
are kept in blocks of ids, so that none is longer than a block is wide.

Sums over subtrees go bottom-up in strides of 1, 2, 4, ... levels: a node's sum over its
next 2**k levels is passed to its ancestor 2**k levels above, so a trie of d levels takes
log2(d) rounds. Nodes of a single conversation are chains, whose sums are known; only
shared nodes take part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandline.llm.scratch import Scratch
from strandline.llm.spread import join_spread
from strandline.llm.words import WORD

#: The root's key; all others are hashes of 32 bytes.
ROOT = b""
#: Tables of so many tasks are merged by one level of the tree of merges.
FAN = 64
#: A task hands its partial trie on when it has so many nodes.
TABLE_NODES = 50_000
#: Ids are listed in blocks of so many numbers.
BLOCK_IDS = 1 << 16
PARTIAL = "key binary, parent binary, depth long, words long, n long, first long, block long, ends array<long>, task int"


def ordered_turns(turns: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text, ...)`` -> conv_id, place (from 1), step (a turn's identity), words.

    Conversations are ordered by turn, null first; ties go by role, then by the SHA-256 of the text. Null
    roles and texts count as empty; repeated rows are turns, each; rows without a conv_id
    take no part; other columns are not read. Texts are hashed where they are read, so none is shuffled.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest"))
    return rows.select("conv_id", place.cast("long").alias("place"), F.concat("digest", F.col("role").cast("binary")).alias("step"), "words")


def spliced(turns: DataFrame, scratch: Scratch, group: int, shared: int) -> tuple[DataFrame, DataFrame]:
    """``ordered_turns`` with the first h of each conversation c replaced by those of c - c % group, and all conversations.

    h is crc32(c in decimal) % shared. The first has fewer turns or none where that conversation
    has; its places stay in order, with gaps.
    """
    rows = scratch.save(turns, "turns")
    own = F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared
    convs = scratch.save(rows.groupBy("conv_id").agg(F.count("*").alias("_turns")).select("conv_id", own.alias("_own"), (F.col("conv_id") - F.col("conv_id") % group).alias("_base")), "conversations")
    heads = rows.filter((F.col("place") < shared) & (F.col("conv_id") % group == 0)).withColumnRenamed("conv_id", "_base")
    begins = convs.join(heads, "_base").filter("place <= _own").select("conv_id", "place", "step", "words")
    return begins.unionByName(rows.filter(F.col("place") > own)), convs.select("conv_id")


class _Partial:
    """Nodes and ends of the conversations that a task has read."""

    def __init__(self) -> None:
        self.nodes: dict[bytes, list] = {}
        self.ends: dict[tuple[bytes, int], list[int]] = {}

    def add(self, key: bytes, parent: bytes | None, depth: int, words: int, conv: int) -> None:
        if (node := self.nodes.get(key)) is None:
            self.nodes[key] = [parent, depth, words, 1, conv]
        else:
            node[3] += 1
            node[4] = min(node[4], conv)

    def end(self, key: bytes, conv: int) -> None:
        self.ends.setdefault((key, conv // BLOCK_IDS), []).append(conv)

    def rows(self, task: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        nodes = [(k, *v, None, None, task) for k, v in self.nodes.items()]
        ends = [(k, None, None, None, None, None, b, v, task) for (k, b), v in self.ends.items()]
        for part in (nodes, ends):
            for lo in range(0, len(part), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part[lo : lo + 10_000]), schema)], schema=schema)


def _partials(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, place, step, words) in order; place 0 is the conversation itself."""
    task, table, conv, key, depth = TaskContext.get().partitionId(), _Partial(), None, ROOT, 0
    for batch in batches:
        for c, place, step, words in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if place == 0:
                if conv is not None:
                    table.end(key, conv)
                if len(table.nodes) + len(table.ends) >= TABLE_NODES:
                    yield from table.rows(task, schema)
                    table = _Partial()
                conv, key, depth, parent = c, ROOT, 0, None
            else:
                parent, key, depth = key, sha256(key + step).digest(), depth + 1
            table.add(key, parent, depth, words, c)
            if len(table.nodes) >= 2 * TABLE_NODES:  # a very long conversation
                yield from table.rows(task, schema)
                table = _Partial()
    if conv is not None:
        table.end(key, conv)
    yield from table.rows(task, schema)


def _merged(rows: DataFrame, tasks: int, keys: list[str], *sums) -> DataFrame:
    """Tables of ``tasks`` tasks as one, by levels of ``FAN``."""
    while True:
        tasks = -(-tasks // FAN)
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy(*keys, "task").agg(*sums)
        if tasks <= 1:
            return rows.drop("task")


def _ends_hash(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Blocks (key, block, sorted ids) in order -> each key's hash; one block is in memory at once."""
    key = digest = None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for i in range(batch.num_rows):
            now, ids = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
            if now != key or digest is None:
                if digest is not None:
                    done.append((key, digest.hexdigest()))
                key, digest, comma = now, sha256(), ""
            digest.update((comma + ",".join(map(str, ids))).encode())
            comma = ","
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((key, digest.hexdigest()), schema)], schema=schema)


def rolled_up(nodes: DataFrame, scratch: Scratch, values: list[str]) -> DataFrame:
    """``nodes(key, parent, depth, *values)``, every node's ancestors among them -> key and the values summed over its subtree."""
    rows = scratch.save(nodes.select("key", "depth", F.col("parent").alias("up"), *values), "stride0")
    deepest, stride = rows.agg(F.max("depth")).first()[0] or 0, 1
    while stride <= deepest:
        below = scratch.save(rows.filter("up IS NOT NULL").groupBy("up").agg(*[F.sum(v).alias(f"_{v}") for v in values], F.count_if(F.col("depth") >= 2 * stride).alias("_n")), "below")
        sums = rows.join(below.drop("_n").withColumnRenamed("up", "key"), "key", "left")
        sums = sums.select("key", "depth", "up", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values])
        # The ancestor twice as far above is the ancestor's ancestor.
        far = sums.filter(F.col("depth") >= 2 * stride)
        above = rows.select(F.col("key").alias("up"), F.col("up").alias("_up")).join(below.filter("_n > 0").select("up", "_n"), "up")
        far = join_spread(far, above, ["up"], "_n", rows.count()).drop("up").withColumnRenamed("_up", "up")
        near = sums.filter(F.col("depth") < 2 * stride).withColumn("up", F.lit(None).cast("binary"))
        after = scratch.save(near.unionByName(far), "stride")
        scratch.drop(rows, below)
        rows, stride = after, 2 * stride
    return rows.select("key", *values)


def prefix_trie(turns: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """``turns(conv_id, place, step, words)``, as ``ordered_turns`` gives them, to the trie's nodes.

    Returns, for each node: key and parent (binary; the root's key is empty, its parent null), conv_id
    (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless
    nodes in its subtree, itself included), saved_tokens (over its subtree, each node's members but one, times the
    words of its last turn), ends_sha256 (of the decimal conv_ids that end there, ascending, joined by
    commas). ``conversations(conv_id)`` are all there are, also those without turns; by default those of ``turns``. No
    conversations give no rows. Places must be distinct within a conversation, which is
    read in order by one task, never held whole.
    """
    scratch = Scratch(turns.sparkSession, "prefix-trie")
    conversations = turns.select("conv_id").distinct() if conversations is None else conversations
    rows = turns.select("conv_id", "place", "step", "words").unionByName(conversations.select("conv_id", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("step"), F.lit(0).cast("long").alias("words")))
    schema = to_arrow_schema(T._parse_datatype_string(PARTIAL))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    partial = scratch.save(rows.mapInArrow(lambda it: _partials(it, schema), PARTIAL), "partial")
    tasks = (partial.agg(F.max("task")).first()[0] or 0) + 1
    nodes = scratch.save(_merged(partial.filter("n IS NOT NULL"), tasks, ["key", "parent", "depth", "words"], F.sum("n").alias("n"), F.min("first").alias("first")), "nodes")
    ends = _merged(partial.filter("ends IS NOT NULL"), tasks, ["key", "block"], F.flatten(F.collect_list("ends")).alias("ends"))

    out = "key binary, ends_sha256 string"
    out_schema = to_arrow_schema(T._parse_datatype_string(out))
    ends = ends.select("key", "block", F.array_sort("ends").alias("ends")).repartition("key").sortWithinPartitions("key", "block")
    hashes = ends.mapInArrow(lambda it: _ends_hash(it, out_schema), out)

    children = scratch.save(nodes.filter("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("_single")), "children")
    shared = nodes.filter("n > 1").join(children, "key", "left")
    shared = shared.withColumn("leaves", F.coalesce("_single", F.lit(0)) + F.col("n_children").isNull().cast("long")).withColumn("saved", (F.col("n") - 1) * F.col("words"))
    sums = rolled_up(shared, scratch, ["leaves", "saved"])

    # The parent's smallest member; a parent with very many children is dealt.
    parents = nodes.select("key", F.col("first").alias("parent_conv_id")).join(children.select("key", "n_children"), "key").withColumnRenamed("key", "parent")
    named = join_spread(nodes.filter("depth > 0"), parents, ["parent"], "n_children", nodes.count())
    named = named.unionByName(nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")))
    whole = named.join(children.drop("_single"), "key", "left").join(sums, "key", "left").join(hashes, "key", "left")
    zero = F.lit(0).cast("long")
    return whole.select(
        "key", "parent", F.col("first").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"),
        F.coalesce("leaves", F.lit(1).cast("long")).alias("n_leaves"), F.coalesce("saved", zero).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(sha256().hexdigest())).alias("ends_sha256"),
    )


def spliced_trie(turns: DataFrame, *, group: int = 20, shared: int = 4) -> DataFrame:
    """``prefix_trie`` of raw ``turns(conv_id, turn, role, text, ...)`` after ``spliced``."""
    scratch = Scratch(turns.sparkSession, "spliced")
    return prefix_trie(*spliced(ordered_turns(turns), scratch, group, shared))
