"""Quality by an interpolated modified Kneser-Ney model of characters.

Four-gram counts of trusted text are aggregated and discounted in Spark, in
tables sharded by n-gram; each order's discounted share and each context's
back-off weight come from count joins on the sharded keys (Chen & Goodman,
1998). A document's perplexity is that of its characters; it is rejected above
a quantile that its own language's trusted text sets. Half of the trusted texts,
by a hash of their ids, train the model; the other half, which it has not seen,
set the quantiles.

Scoring counts the grams of each document and joins the counts with the shards,
order by order; a document's bits are summed where its grams are made, before
anything is shuffled. All trusted texts are read whole. A table of the model with
up to ``BROADCAST_GRAMS`` rows goes to every task, a larger one is joined by a
shuffle.

Every character of the trusted texts counts by itself, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.scratch import Scratch
from strandline.llm.spread import join_spread

#: Symbols have seven bits, or 15 where the trusted texts have more characters: 0 stands before a text, 1 for characters that they have not.
BITS, WIDE, ORDER = 7, 15, 4
SYMBOLS = 1 << BITS
#: The last symbols of 15 bits, in pairs, are the rarest characters where there are more of them than symbols; the pairs are enough for Unicode.
PARTS = 1056
#: Rows of two numbers each: at most 64 MB.
BROADCAST_GRAMS = 2_000_000
#: The quantile of trusted text, the factor on it, and the texts that it takes at least.
QUANTILE, FACTOR, LEAST_TEXTS = 0.99, 1.1, 50
#: Short texts vary more: a text counts as if it went on for so many characters at its language's median.
PRIOR_CHARS = 200
#: Languages with texts of their own, up to this number, are broadcast (two numbers each); more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
CHUNK = 1 << 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def symbol_bits(chars: list[int]) -> int:
    return BITS if len(chars) <= SYMBOLS - 2 else WIDE


def symbol_table(chars: list[int]) -> np.ndarray:
    """Symbol of each code point, of 7 bits in a byte or of 15; pairs are numbered from 2**15 on. Characters not among ``chars`` are 1."""
    if symbol_bits(chars) == BITS:
        table, single = np.ones(0x110000, np.uint8), len(chars)
    elif len(chars) <= (1 << WIDE) - 2:
        table, single = np.ones(0x110000, np.uint16), len(chars)
    else:
        table, single = np.ones(0x110000, np.uint32), (1 << WIDE) - 2 - PARTS
    table[chars[:single]] = np.arange(2, 2 + single)
    table[chars[single:]] = (1 << WIDE) + np.arange(len(chars) - single)
    return table


def symbols(text: str, table: np.ndarray) -> np.ndarray:
    s = table[code_points(text)].astype(np.int32 if table.itemsize == 1 else np.int64)
    if table.itemsize < 4:
        return s
    two = s >= 1 << WIDE
    rest, at = s[two] - (1 << WIDE), np.flatnonzero(two)
    at = at + np.arange(len(at))
    s = np.repeat(s, 1 + two)
    s[at], s[at + 1] = (1 << WIDE) - PARTS + rest // PARTS, (1 << WIDE) - PARTS + rest % PARTS
    return s


def gram_keys(text: str, table: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the four-grams that end at each symbol; very long texts are gone through in chunks."""
    bits = BITS if table.itemsize == 1 else WIDE
    before = np.zeros(ORDER - 1, np.int32)
    for at in range(0, len(text), CHUNK):
        s = np.concatenate([before, symbols(text[at : at + CHUNK], table)])
        before = s[-(ORDER - 1) :]
        yield (s[:-3] << 3 * bits) | (s[1:-2] << 2 * bits) | (s[2:-1] << bits) | s[3:]


def _chunk_counts(parts: Iterator[np.ndarray], name: str) -> Iterator[pa.RecordBatch]:
    """How often each value occurs, counted over parts of some ``CHUNK`` values together."""
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        k, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32 if k.itemsize == 4 else np.int64)), pa.array(n)], [name, "n"])

    for part in parts:
        held.append(part)
        size += len(part)
        if size >= CHUNK:
            yield counted()
            held, size = [], 0
    if held:
        yield counted()


def _char_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts = (t.as_py() or "" for batch in batches for t in batch.column(0))
    return _chunk_counts((code_points(t[at : at + CHUNK]) for t in texts for at in range(0, len(t), CHUNK)), "c")


def _gram_counts(batches: Iterator[pa.RecordBatch], chars: list[int]) -> Iterator[pa.RecordBatch]:
    table = symbol_table(chars)
    return _chunk_counts((keys for batch in batches for t in batch.column(0) for keys in gram_keys(t.as_py() or "", table)), "gram")


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2 and D3+ of one order, from its counts of counts."""
    r = counts.agg(*[F.count(F.when(F.col("n") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (r[f"n{i}"] for i in (1, 2, 3, 4))
    if not (n1 and n2 and n3):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    return [min(max(i - (i + 1) * y * b / a, 0.05), i - 0.05) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


def gram_type(bits: int) -> str:
    return "int" if bits == BITS else "long"


def train(texts: DataFrame, scratch: Scratch) -> tuple[list[int], list[DataFrame]]:
    """``texts(text)`` -> (all characters, the most frequent first, tables of the orders 1 to 4).

    Each table has gram, share (discounted probability without back-off),
    context, and gamma, the context's weight of the next shorter order.
    """
    by = texts.select("text").mapInArrow(_char_counts, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    # No more than Unicode has.
    chars = [r["c"] for r in by.orderBy(F.desc("n"), "c").collect()]
    bits = symbol_bits(chars)
    counts = texts.select("text").mapInArrow(lambda it: _gram_counts(it, chars), f"gram {gram_type(bits)}, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts, orders = scratch.save(counts, "counts4"), []
    for order in range(ORDER, 0, -1):
        d1, d2, d3 = _discounts(counts)
        taken = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        rows = counts.withColumn("context", F.shiftright("gram", bits)).withColumn("taken", taken)
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("taken").alias("held"))
        rows = rows.join(totals, "context").select("gram", "context", ((F.col("n") - F.col("taken")) / F.col("total")).alias("share"), (F.col("held") / F.col("total")).alias("gamma"))
        orders.append(scratch.save(rows, f"order{order}"))
        # The next shorter order counts in how many different contexts a gram goes on.
        shorter = F.col("gram").bitwiseAND(F.lit((1 << bits * (order - 1)) - 1))
        counts = counts.groupBy(shorter.alias("gram")).agg(F.count("*").alias("n"))
    return chars, orders[::-1]


def counted_grams(text: str, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of a text and how often each is met; those of a very long one once for each chunk."""
    found = [np.unique(keys, return_counts=True) for keys in gram_keys(text, table)]
    if not found:
        return np.zeros(1, np.int32), np.zeros(1, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def _gram_rows(batches: Iterator[pa.RecordBatch], chars: list[int]) -> Iterator[pa.RecordBatch]:
    """(text_key, text) -> text_key, gram, n and, in one row of each different text of a few, copies: how many there are of it."""
    table = symbol_table(chars)
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            keys, first, copies = np.unique(part.column(0).to_numpy(), return_index=True, return_counts=True)
            grams_, counts = zip(*[counted_grams(part.column(1)[int(i)].as_py() or "", table) for i in first])
            lengths = [len(g) for g in grams_]
            marks = np.zeros(sum(lengths), np.int32)
            marks[np.cumsum([0, *lengths[:-1]])] = copies
            n = np.concatenate(counts) * np.repeat(copies, lengths)
            new = [np.repeat(keys, lengths), np.concatenate(grams_).astype(np.int32 if table.itemsize == 1 else np.int64), n.astype(np.int64), marks]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in new], ["text_key", "gram", "n", "copies"])


def joined_bits(docs: DataFrame, chars: list[int], orders: list[DataFrame], broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """``docs(text_key, text)`` -> text_key, copies, bits of one copy: two count joins per order with the model's shards."""
    width = symbol_bits(chars)
    rows = docs.select("text_key", "text").mapInArrow(lambda it: _gram_rows(it, chars), f"text_key long, gram {gram_type(width)}, n long, copies int")
    p = F.lit(1 / min(max(SYMBOLS, len(chars) + 2), 1 << WIDE))

    def shards(table: DataFrame) -> DataFrame:
        return F.broadcast(table) if table.count() <= broadcast_grams else table

    for order, table in enumerate(orders, 1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << width * order) - 1))
        rows = rows.withColumn("tail", tail).withColumn("head", F.shiftright("tail", width))
        shares = shards(table.select(F.col("gram").alias("tail"), F.col("share").alias(f"s{order}")))
        gammas = shards(table.groupBy(F.col("context").alias("head")).agg(F.first("gamma").alias(f"g{order}")))
        rows = rows.join(shares, "tail", "left").join(gammas, "head", "left").drop("tail", "head")
        p = F.coalesce(F.col(f"s{order}"), F.lit(0.0)) + F.coalesce(F.col(f"g{order}"), F.lit(1.0)) * p
    bits = F.sum(F.when(F.col("n") > 0, -F.log2(p) * F.col("n")).otherwise(0.0))
    sums = rows.groupBy("text_key").agg(F.sum("copies").alias("copies"), bits.alias("bits"))
    return sums.select("text_key", "copies", (F.col("bits") / F.col("copies")).alias("bits"))


def fits(doc_id: str = "doc_id") -> Column:
    """Whether a trusted text trains the model, rather than setting the quantiles."""
    return F.crc32(F.concat(F.col(doc_id).cast("string"), F.lit("/quality"))) % 2 == 0


def score_quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``docs(doc_id, text, lang, ...)`` -> doc_id, lang, chars, bits, perplexity, threshold, kept.

    perplexity is 2 to the mean bits per character, drawn towards the median of
    the language's trusted texts as if ``PRIOR_CHARS`` characters more had been
    read; that keeps short texts, which prove nothing, near the middle. The
    threshold is ``factor`` times the ``quantile`` of the trusted texts of the
    language, or of all languages where it has fewer than ``LEAST_TEXTS``.
    Trusted texts are the labelled ones. All that ``fits`` picks train the model,
    whole and whatever their number; all others set the quantiles, or all trusted
    ones where there are no others.

    Null and empty texts have no bits and are kept. Without trusted text
    everything is kept. A null language is one of those without texts of their
    own. Repeated rows are scored each by itself.
    """
    return _scores(docs, labels, **how).drop("text_key")


def _scores(docs: DataFrame, labels: DataFrame, *, label: str = "quality", quantile: float = QUANTILE, factor: float = FACTOR, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """As ``score_quality``, with ``text_key``, a hash of the text."""
    scratch = Scratch(docs.sparkSession, "quality")
    trusted = labels.filter((F.col(label) == 1) & F.col("doc_id").isNotNull())
    text = F.col("text").cast("string")
    # Ids that cannot fit are left out on both sides, so that half of the texts are not shuffled. The ids grow with the data: no broadcast.
    texts = docs.filter(fits()).select("doc_id", text.alias("text")).join(trusted.filter(fits()).hint("merge"), "doc_id", "left_semi")
    chars, orders = train(scratch.save(texts, "trusted-texts"), scratch)
    sums = scratch.save(joined_bits(docs.select(F.xxhash64(text).alias("text_key"), text.alias("text")), chars, orders, broadcast_grams), "bits")
    slim = docs.select("doc_id", "lang", F.xxhash64(text).alias("text_key"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"))
    total = sums.agg(F.sum("copies")).first()[0] or 0
    scored = scratch.save(join_spread(slim, sums, ["text_key"], "copies", total), "scored")
    return with_thresholds(scored, labels, label, quantile, factor, scratch)


def with_thresholds(scored: DataFrame, labels: DataFrame, label: str, quantile: float, factor: float, scratch: Scratch) -> DataFrame:
    trusted = labels.filter((F.col(label) == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    others = trusted.filter(~fits())
    trusted = trusted if others.isEmpty() else others
    # Means are rounded, so that the percentiles keep a bounded number of different values.
    own = scored.filter("chars > 0").join(trusted, "doc_id", "left_semi").select("lang", "chars", "bits", F.round(F.col("bits") / F.col("chars"), 3).alias("mean"))
    own = scratch.save(own, "trusted")

    def per_language(rows: DataFrame, name: str) -> DataFrame:
        saved = scratch.save(rows, name)
        return F.broadcast(saved) if saved.count() <= BROADCAST_LANGUAGES else saved

    prior = own.groupBy("lang").agg(F.percentile("mean", 0.5).alias("middle"), F.count("*").alias("texts")).filter(F.col("texts") >= LEAST_TEXTS)
    prior = per_language(prior.select(F.col("lang").alias("_lang"), "middle"), "middles")
    overall = own.agg(F.percentile("mean", 0.5).alias("middle_all"))

    def drawn(rows: DataFrame) -> DataFrame:
        at = rows.join(prior, F.col("lang") == F.col("_lang"), "left").drop("_lang").join(F.broadcast(overall))
        middle = F.coalesce("middle", "middle_all")
        mean = (F.col("bits") + PRIOR_CHARS * middle) / (F.col("chars") + PRIOR_CHARS)
        return at.withColumn("mean", F.when(middle.isNotNull(), mean).otherwise(F.lit(0.0))).drop("middle", "middle_all")

    level = drawn(own.drop("mean")).withColumn("mean", F.round("mean", 3))
    by = level.groupBy("lang").agg(F.percentile("mean", quantile).alias("edge"), F.count("*").alias("texts")).filter(F.col("texts") >= LEAST_TEXTS)
    edges = per_language(by.select(F.col("lang").alias("_lang"), "edge"), "edges")
    edge_all = level.agg(F.percentile("mean", quantile).alias("edge_all"))
    at = drawn(scored).join(edges, F.col("lang") == F.col("_lang"), "left").drop("_lang").join(F.broadcast(edge_all))
    threshold = F.coalesce(F.lit(float(factor)) * F.pow(F.lit(2.0), F.coalesce("edge", "edge_all")), F.lit(float("inf")))
    at = at.withColumn("perplexity", F.pow(F.lit(2.0), "mean")).withColumn("threshold", threshold)
    return at.select("doc_id", "lang", "text_key", "chars", "bits", "perplexity", "threshold", ((F.col("chars") == 0) | (F.col("perplexity") <= F.col("threshold"))).alias("kept"))


def keep_quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns.

    Rows are told apart by doc_id, language and text, on which the verdict
    depends; null or reused ids take no other text with them.
    """
    rejected = _scores(docs, labels, **how).filter(~F.col("kept")).select("doc_id", F.col("lang").alias("their_lang"), "text_key").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.col("lang").alias("own_lang"), F.xxhash64(F.col("text").cast("string")).alias("own_key"))
    same = rows["own_id"].eqNullSafe(rejected["doc_id"]) & rows["own_lang"].eqNullSafe(rejected["their_lang"]) & (rows["own_key"] == rejected["text_key"])
    return rows.join(rejected, same, "left_anti").select("row.*")
