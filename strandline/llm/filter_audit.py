"""How the filters of a corpus interact: what each removes in every order of all of them.

The orders of k filters form a trie of permutations. What survives a prefix does
not depend on its order, so the trie has 2**k different states. They are walked depth
first; a state's survivors are a persisted DataFrame, made from its parent's by one
filter, and a state that was met before in another order is not walked again. At every state
one aggregation counts what each filter that is left removes from the survivors. Redundant and
unique failures and Shapley sums come from these counts alone.

At most k states are persisted at once, and they go as the walk leaves them. Their
lineage ends in a table of the shared folder, so a lost executor costs a few narrow steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import permutations

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandline.llm.scratch import Scratch
from strandline.llm.spread import join_spread

#: More filters have too many orders for a table of them.
MOST_FILTERS = 7
UPPER, SYMBOLS, CONTINUED = bytes(range(65, 91)), b"#$%&*|", bytes(range(0x80, 0xC0))
#: Different words of a longer text are counted in so many passes that each sees about this many bytes of them.
PASS_BYTES = 1 << 24
RUN_BYTES = 1 << 22
MEASURES = [("n_words", "long"), ("n_distinct", "long"), ("n_upper", "long"), ("n_points", "long"), ("has_symbol", "boolean"), ("digest", "binary")]


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words in lists; ``bytes.split`` parts at the six bytes 0x20 and 0x09-0x0D."""
    at = 0
    while at < len(text):
        end = at + RUN_BYTES
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].split()
        at = end


def measure(text: bytes, pass_bytes: int = PASS_BYTES) -> tuple[int, int, int, int, bool, bytes]:
    """Words, different words, A-Z, code points, whether a symbol occurs, SHA-256."""
    words = distinct = 0
    passes = 1 + len(text) // pass_bytes
    for i in range(passes):
        seen: set[bytes] = set()
        for run in _words(text):
            words += len(run) if i == 0 else 0
            seen.update(run if passes == 1 else (w for w in run if hash(w) % passes == i))
        distinct += len(seen)
    size = len(text)
    return words, distinct, size - len(text.translate(None, UPPER)), len(text.translate(None, CONTINUED)), len(text.translate(None, SYMBOLS)) < size, sha256(text).digest()


def _measured(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [measure(t.as_py()) for t in batch.column(batch.num_columns - 1)]
        columns = [pa.array(c, f.type) for c, f in zip(zip(*found), list(schema)[batch.num_columns - 1 :])] if found else [pa.array([], f.type) for f in list(schema)[batch.num_columns - 1 :]]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], schema=schema)


def document_measures(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs(doc_id, lang, text, ...)`` -> doc_id, part, the columns of ``MEASURES`` and ``is_copy``, one row for each row.

    A null text or lang counts as empty. A copy is a text identical to that of any smaller
    doc_id; a null doc_id is not compared, so it is neither smaller nor a copy.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    slim = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    out = T.StructType(slim.schema.fields[:2])
    for name, kind in MEASURES:
        out = out.add(name, kind)
    arrow = to_arrow_schema(out)
    rows = scratch.save(slim.mapInArrow(lambda it: _measured(it, arrow), out), "measures")
    firsts = scratch.save(rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies")), "texts")
    told = join_spread(rows, firsts, ["digest"], "copies", rows.count())
    return told.withColumn("is_copy", F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))).drop("first_id")


def audit(rows: DataFrame, filters: dict[str, Column], losses: dict[str, Column]) -> DataFrame:
    """Counts of what ``filters`` remove from ``rows(part, ...)``, for each part, order of the filters and step.

    ``filters``: a name and a condition that a row fails by; null conditions do not fail.
    ``losses``: a name and a condition; rows that meet it are counted apart where they are removed.
    Returns part, filter_order (the names, put together), step (from 1), and longs: kept (after the
    step), removed, redundant (failing the step's filter, but removed before), unique_fails (failing no other),
    a column for each loss, shapley (the filter's removed, summed over all orders). All parts have all rows,
    zeros included; repeated rows count each; no rows give no rows.
    """
    names = list(filters)
    if not 1 <= len(names) <= MOST_FILTERS:
        raise ValueError(f"1 to {MOST_FILTERS} filters")
    spark, bit, full = rows.sparkSession, {n: 1 << i for i, n in enumerate(names)}, (1 << len(names)) - 1
    scratch = Scratch(spark, "filter-audit")
    flag = lambda c: F.coalesce(c.cast("boolean"), F.lit(False))
    start = scratch.save(rows.select("part", *[flag(c).alias(f"fails_{n}") for n, c in filters.items()], *[flag(c).alias(f"is_{n}") for n, c in losses.items()]), "rows")
    at, walked = scratch.place("edges"), set()

    def count(survivors: DataFrame, state: int) -> None:
        left = [n for n in names if not state & bit[n]]
        sums = [F.count_if(f"fails_{n}").alias(f"removed_{n}") for n in left]
        sums += [F.count_if(F.col(f"fails_{n}") & F.col(f"is_{x}")).alias(f"{x}_{n}") for n in left for x in losses]
        found = survivors.groupBy("part").agg(F.count("*").alias("rows"), *sums)
        edges = [F.struct(F.lit(n).alias("filter"), (F.col("rows") - F.col(f"removed_{n}")).alias("kept"), F.col(f"removed_{n}").alias("removed"), *[F.col(f"{x}_{n}").alias(x) for x in losses]) for n in left]
        found.select("part", F.lit(state).alias("state"), F.inline(F.array(*edges))).write.parquet(f"{at}/{state}")

    def walk(survivors: DataFrame, state: int) -> None:
        walked.add(state)
        count(survivors, state)
        for n in names:
            after = state | bit[n]
            if after not in walked and after != full:
                kept = survivors.filter(~F.col(f"fails_{n}")).persist(StorageLevel.MEMORY_AND_DISK)
                walk(kept, after)
                kept.unpersist()

    walk(start, 0)
    schema = f"part string, state int, filter string, kept long, removed long, {', '.join(f'{x} long' for x in losses)}".rstrip(", ")
    edges = spark.read.schema(schema).parquet(*[f"{at}/{s}" for s in sorted(walked)])
    return _by_order(edges, names, bit, list(losses))


def _by_order(edges: DataFrame, names: list[str], bit: dict[str, int], losses: list[str]) -> DataFrame:
    """Edges of the states -> the steps of all orders. The small tables have a row for each edge or step of the trie."""
    spark, full = edges.sparkSession, sum(bit.values())
    steps = [("".join(order), i + 1, sum(bit[n] for n in order[:i]), n) for order in permutations(names) for i, n in enumerate(order)]
    orders = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, state int, filter string"))
    states = F.broadcast(spark.createDataFrame([(s, n) for s in range(full) for n in names if not s & bit[n]], "state int, filter string"))
    # The first state has all parts.
    every = edges.filter("state = 0").select("part", "filter", F.col("removed").alias("_fails")).join(states, "filter")
    counts = ["kept", "removed", *losses]
    found = every.join(edges, ["part", "filter", "state"], "left").select("part", "filter", "state", "_fails", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
    rows = found.join(orders, ["state", "filter"])
    last = F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, full - bit[n])]), F.col("filter"))
    sums = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"), F.max(F.when(F.col("state") == last, F.col("removed"))).alias("unique_fails"))
    rows = rows.join(sums, ["part", "filter"])
    return rows.select("part", "filter_order", "step", "kept", "removed", (F.col("_fails") - F.col("removed")).alias("redundant"), "unique_fails", *losses, "shapley")


#: The corpus filters, by the condition that a document fails them for.
FILTERS = {"A": "n_words < 100", "B": "100 * n_distinct < 80 * n_words", "C": "100 * n_upper > 10 * n_points", "D": "has_symbol", "E": "is_copy"}


def audit_documents(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """``audit`` of ``docs(doc_id, lang, text, ...)`` by conditions over ``document_measures``, a part for each lang.

    ``labels(doc_id, quality, toxic, ...)``: a document is good (toxic) if any of its rows there says 1;
    documents without labels are neither.
    """
    rows = document_measures(docs, Scratch(docs.sparkSession, "filter-measures"))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good_lost"), F.bool_or(F.col("toxic") == 1).alias("toxic_lost"))
    rows = rows.join(marks, "doc_id", "left")
    return audit(rows, {n: F.expr(c) for n, c in filters.items()}, {"good_lost": F.col("good_lost"), "toxic_lost": F.col("toxic_lost")})
