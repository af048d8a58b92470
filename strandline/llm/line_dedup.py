"""Line deduplication by a deletion-neighbourhood join.

A line is dropped when an earlier line, by doc_id (then text) and line number,
has the same words or differs by at most one word put in, taken out or replaced.
Words are runs without white space, in lower case; one edit in five words or more
is a similarity of 0.8 or more, so only lines of ``MIN_WORDS`` words take part in
that. Exact repeats go whatever their length.

Two lines one edit apart have equal deletion variants: the same words around
the one left out (replaced), or one line's variant is the other line (put in).
Variants are emitted as hashes and grouped. All lines of a group are within one
edit of its earliest line, so a group sends its minimum and nothing is paired
within it; the minimum is aggregated map-side. The words of line and earliest
line are then compared.

Emitting variants for every line of a large corpus would multiply it. A pair
one edit apart also shares as many first or last words as half the shorter line
has. So lengths are put into classes, the first and the last words of a line, as
many as half the least length of its class, are hashed, and the hashes grouped;
the shortest lines of a class take part in the class below too. Variants are
emitted only for lines that share such a half with a line of the same length or
of one word more or less, and only for words outside that half.

DataFrame functions only. Texts are shuffled once, line by line. The rows
of lines, halves and variants that very many share are dealt over tasks (``spread``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.scratch import Scratch
from strandline.llm.spread import join_spread

MIN_WORDS = 5


def line_units(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, text_key, line, words, n)``: n words in lower case, with single spaces; blank lines have none.

    A line is one unit, however long it is.
    """
    odd = F.lit(False)
    for c in ("\t", "\r", "\x0b", "\f"):
        odd = odd | F.contains("text", F.lit(c))
    # Case and odd spaces are seen to in the whole text, which is one call and not one for every line.
    plain = F.lower(F.when(odd, F.translate("text", "\t\r\x0b\f", "    ")).otherwise(F.col("text")))
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split(plain, "\n")).alias("line", "raw"))
    single = F.trim(F.when(F.contains("raw", F.lit("  ")), F.regexp_replace("raw", " +", " ")).otherwise(F.col("raw")))
    # As rows of their own, the words are made once, not again for every filter and hash on them.
    lines = lines.select("doc_id", "text_key", "line", F.explode(F.array(single)).alias("words"))
    spaces = F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit("")))
    return lines.withColumn("n", F.when(F.col("words") == "", 0).otherwise(spaces + 1))


def _keys(words: Column | str) -> list[Column]:
    """Two hashes of different kind: together 96 bits."""
    return [F.xxhash64(words).alias("h1"), F.hash(words).alias("h2")]


#: Width of a class of lengths n; each class begins at a multiple of its width.
_WIDTH = "case when n < 16 then 2 when n < 32 then 4 when n < 64 then 8 when n < 128 then 16 else 32 end"
#: Least length of the class of n words, and of the class below if n is the least of its own.
_LOW, _BELOW = f"(n - n % ({_WIDTH}))", f"(n - 1 - (n - 1) % ({_WIDTH.replace('n <', 'n - 1 <')}))"


def _halves() -> Column:
    """[first, last half] in a line's own class, then in the class below or null."""

    def of(low: str) -> list[Column]:
        low, half = F.expr(low), F.expr(f"int({low} div 2)")
        ends = ((F.lit("first"), half), (F.lit("last"), -half))
        return [F.xxhash64(low, end, F.call_function("substring_index", "words", F.lit(" "), words)) for end, words in ends]

    below = F.expr(f"n >= {MIN_WORDS} and {_BELOW} < {_LOW}")
    return F.array(*of(_LOW), *[F.when(below, x) for x in of(_BELOW)])


def one_edit(a: str, b: str) -> Column:
    """Whether two word arrays are at most one edit apart."""
    differ = F.zip_with(a, b, lambda x, y: F.when(x.eqNullSafe(y), 0).otherwise(1))
    same = F.aggregate(differ, F.lit(0), lambda s, x: s + x) <= 1
    longer = F.when(F.size(a) > F.size(b), F.col(a)).otherwise(F.col(b))
    shorter = F.when(F.size(a) > F.size(b), F.col(b)).otherwise(F.col(a))
    # Where they part first, one word of the longer is out of place; null stands beyond the shorter.
    at = F.array_position(F.zip_with(longer, shorter, lambda x, y: x.eqNullSafe(y)), F.lit(False)).cast("int")
    one_out = F.concat(F.slice(longer, F.lit(1), at - 1), F.slice(longer, at + 1, F.size(longer))) == shorter
    return F.when(F.size(a) == F.size(b), same).when(F.abs(F.size(a) - F.size(b)) == 1, one_out).otherwise(False)


def _position() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "line")


def _near(docs: DataFrame, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct lines -> ``(h1, h2, witness)``: an earlier line at most one edit away."""
    halves = distinct.filter(F.col("n") >= MIN_WORDS - 1)
    halves = halves.select(F.col("first").alias("at"), "n", F.posexplode("halves").alias("which", "half")).filter("half is not null")
    # A place for each length of the class, and one for the next length.
    guest = F.col("which") >= 2
    low = F.when(guest, F.expr(_BELOW)).otherwise(F.expr(_LOW))
    halves = halves.select("at", "half", "which", "n", (F.col("n") - low).cast("int").alias("place"))
    mark = F.expr("shiftleft(1L, place)")
    plain = ~guest & (F.col("n") >= MIN_WORDS)
    counted = halves.groupBy("half").agg(
        F.count("*").alias("met"),
        F.count_if(plain).alias("plain"),
        F.bit_or(F.when(plain, mark).otherwise(0)).alias("lengths"),
        F.bit_or(mark).alias("marks"),
    )
    replaced = (F.col("plain") > F.bit_count("lengths")).alias("replaced")
    shared = counted.select("half", "met", replaced, "marks").filter("replaced or (marks & shiftright(marks, 1)) <> 0")
    shared = scratch.save(shared, "shared-halves")
    # Bits 0-1: replace a word after the first half, before the last; 2-3: leave one out; 4: this is the shorter line.
    bit = F.expr(
        f"(if(replaced and which < 2 and n >= {MIN_WORDS}, 1, 0) + if(place > 0 and n >= {MIN_WORDS} and (shiftright(marks, place - 1) & 1) = 1, 4, 0)) * if(which % 2 = 0, 1, 2)"
        " + if(which < 2 and (shiftright(marks, place + 1) & 1) = 1, 16, 0)"
    )
    wanted = join_spread(halves, shared, ["half"], "met", 4 * distinct.count())
    wanted = wanted.select("at", bit.alias("bit")).filter("bit > 0").groupBy("at").agg(F.bit_or("bit").alias("bits"))
    units = line_units(docs).filter(F.col("n") >= MIN_WORDS - 1).select(_position().alias("at"), "n", "words")
    lines = units.join(wanted, "at").select("at", "words", "n", *_keys("words"), "bits")
    lines = scratch.save(lines.distinct(), "lines-with-shared-halves")

    def left_out(bits_first: int, bits_last: int) -> Column:
        """Places of the last half, or of the first, or of both."""
        half = F.expr(f"int({_BELOW} div 2)")
        low = F.when(F.col("bits").bitwiseAND(bits_last) > 0, F.lit(1)).otherwise(half + 1)
        high = F.when(F.col("bits").bitwiseAND(bits_first) > 0, F.col("n")).otherwise(F.col("n") - half)
        return F.when(F.col("bits").bitwiseAND(bits_first + bits_last) > 0, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def rest(i: Column) -> Column:
        before = F.call_function("substring_index", "words", F.lit(" "), i - 1)
        after = F.call_function("substring_index", "words", F.lit(" "), i - F.col("n"))
        return F.trim(F.concat_ws(" ", before, after))

    def keyed(full: bool, *of) -> Column:
        return F.struct(F.xxhash64(*of).alias("key"), F.lit(full).alias("full"))

    replaced = F.transform(left_out(1, 2), lambda i: keyed(True, F.lit("replaced"), i, rest(i)))
    out = F.transform(left_out(4, 8), lambda i: keyed(True, F.lit("out"), rest(i)))
    itself = F.when(F.col("bits").bitwiseAND(16) > 0, F.array(keyed(False, F.lit("out"), F.col("words"))))
    none = F.array().cast("array<struct<key:bigint,full:boolean>>")
    variants = lines.select("at", "h1", "h2", F.explode(F.concat(replaced, out, F.coalesce(itself, none))).alias("v"))
    variants = scratch.save(variants.select("at", "h1", "h2", "v.key", "v.full"), "variants")
    place = F.struct("at", "h1", "h2")
    groups = variants.groupBy("key").agg(
        F.count("*").alias("met"),
        F.min(F.when(F.col("full"), place)).alias("full_first"),
        F.min(F.when(~F.col("full"), place)).alias("short_first"),
        F.min(place).alias("a"),
        F.max(place).alias("b"),
        F.max(F.col("full").cast("int")).alias("some_full"),
        F.min(F.col("full").cast("int")).alias("all_full"),
    )
    groups = groups.filter("a <> b and some_full = 1").select("key", "met", "full_first", "short_first", "all_full")
    groups = scratch.save(groups, "groups")
    # Among replaced lines the earliest; between put in and left out, the earliest of the other kind.
    witness = F.when(F.col("all_full") == 1, F.col("full_first"))
    witness = witness.when(F.col("full"), F.col("short_first")).otherwise(F.col("full_first"))
    pairs = join_spread(variants, groups, ["key"], "met", variants.count())
    pairs = pairs.select("at", "h1", "h2", witness.alias("witness")).filter("witness.at < at").distinct()
    pairs = pairs.withColumn("g1", F.col("witness.h1")).withColumn("g2", F.col("witness.h2"))
    pairs = scratch.save(pairs, "pairs")
    mine = lines.select("h1", "h2", F.split("words", " ").alias("own")).dropDuplicates(["h1", "h2"])
    theirs = mine.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("own").alias("other"))
    theirs = pairs.groupBy("g1", "g2").agg(F.count("*").alias("met")).join(theirs, ["g1", "g2"])
    checked = join_spread(pairs, theirs, ["g1", "g2"], "met", pairs.count()).join(mine, ["h1", "h2"]).filter(one_edit("own", "other"))
    return checked.groupBy("h1", "h2").agg(F.min("witness.at").alias("witness"))


def duplicate_lines(docs: DataFrame, *, min_words: int = MIN_WORDS, exact_words: int = 1) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> the dropped lines: doc_id, text_key, line, near, keep_doc, keep_line.

    line counts from 0. The keep columns name the earliest line with the same
    words, or, if near, the earliest that a shared variant led to, one edit away.
    It may itself be dropped for a still earlier one. Null and empty texts have
    no lines, null doc_ids come last, and rows that repeat a doc_id and text
    count as one document. Texts that share a doc_id are documents of their own,
    told apart by text_key, a hash of the text, and ordered by it. Near lines
    have ``min_words`` words or more, exact repeats ``exact_words``; a line of
    any length is one unit.
    """
    if min_words < MIN_WORDS or exact_words < 1:
        raise ValueError(f"min_words is {MIN_WORDS} at least, exact_words 1")
    scratch = Scratch(docs.sparkSession, "line-dedup")
    docs = docs.select("doc_id", "text")
    units = line_units(docs).filter(F.col("n") >= min(min_words - 1, exact_words))
    keyed = scratch.save(units.select(_position().alias("at"), "n", *_keys("words"), _halves().alias("halves")), "keyed-lines")
    distinct = keyed.groupBy("h1", "h2").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("lines"), F.any_value("n").alias("n"), F.any_value("halves").alias("halves")
    )
    distinct = scratch.save(distinct, "distinct-lines")
    near = _near(docs, distinct, scratch)
    least = min(min_words, exact_words)
    repeats = F.when(F.col("n") >= exact_words, F.col("lines")).otherwise(1)
    exact = distinct.filter(F.col("n") >= least).select("h1", "h2", "first", "n", "lines", repeats.alias("repeats"))
    # A line of one word less can show that a longer one is near, but is not near itself.
    witness = F.expr(f"if(n >= {min_words} and witness < first, witness, null)")
    decided = exact.join(near, ["h1", "h2"], "left").withColumn("witness", witness).filter("witness is not null or repeats > 1")
    decided = scratch.save(decided.select("h1", "h2", "lines", "first", "witness"), "decided")
    places = keyed.filter(F.col("n") >= least).select("at", "h1", "h2")
    dropped = join_spread(places, decided, ["h1", "h2"], "lines", keyed.count()).filter("witness is not null or at <> first")
    dropped = dropped.select("at", F.col("witness").isNotNull().alias("near"), F.coalesce("witness", "first").alias("keep")).distinct()
    at = ["at.doc_id", "at.text_key", "at.line"]
    return dropped.select(*at, "near", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.line").alias("keep_line"))


def _beside(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, and the verdicts on its doc_id and text, or nulls."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_key"))
    verdicts = verdicts.withColumnRenamed("doc_id", "their_id").withColumnRenamed("text_key", "their_key")
    same = rows["own_id"].eqNullSafe(verdicts["their_id"]) & (rows["own_key"] == verdicts["their_key"])
    return rows.join(verdicts, same, "left")


def line_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, lines (not blank), exact and near dropped ones, and the numbers of these, joined by commas."""
    dropped = duplicate_lines(docs, **how).groupBy("doc_id", "text_key").agg(
        F.count_if(~F.col("near")).alias("exact"), F.count_if("near").alias("near"), F.array_sort(F.collect_list("line")).alias("which")
    )
    lines = F.size(F.filter(F.split(F.coalesce("row.text", F.lit("")), "\n"), lambda x: x.rlike(r"\S")))
    which = F.coalesce(F.array_join(F.col("which").cast("array<string>"), ","), F.lit(""))
    exact, near = (F.coalesce(c, F.lit(0)).alias(c) for c in ("exact", "near"))
    return _beside(docs, dropped).select("row.doc_id", lines.alias("lines"), exact, near, which.alias("dropped"))


def without_lines(text: str, which: str) -> Column:
    """A text without the lines of these numbers, which are in order. Linear in the text and the numbers."""

    ends = F.concat(F.array(F.lit(-1)), F.col(which), F.array(F.size(F.split(text, "\n"))))

    def kept(x: Column) -> Column:
        lines, ends = x["lines"], x["ends"]
        runs = F.transform(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.slice(lines, ends[i - 1] + 2, ends[i] - ends[i - 1] - 1))
        return F.array_join(F.flatten(runs), "\n")

    # The outer transform names the lines and the ends of the runs between dropped ones, so that they are made once.
    return F.transform(F.array(F.struct(F.split(text, "\n").alias("lines"), ends.alias("ends"))), kept)[0]


def drop_duplicate_lines(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without its duplicate lines, same columns; documents left without a word are gone.

    Documents that lose nothing stay as they are, texts without words included.
    ``n_chars``, where there is one, counts the new text.
    """
    dropped = duplicate_lines(docs, **how).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("line")).alias("which"))
    joined = _beside(docs, dropped).withColumn("new", F.when(F.col("which").isNotNull(), without_lines("row.text", "which")))
    joined = joined.filter(F.col("which").isNull() | F.col("new").rlike(r"\S"))
    changed = F.col("row").withField("text", F.col("new"))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length("new").cast(docs.schema["n_chars"].dataType))
    return joined.select(F.when(F.col("which").isNull(), F.col("row")).otherwise(changed).alias("row")).select("row.*")
