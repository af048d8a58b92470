"""Personal data by bootstrapped contextual extraction.

Seeds are what strict patterns find (e-mail and IP addresses, card numbers with
a valid check digit, phone numbers), and tokens of the form of a key or password
that a machine made, as seeds of the kind ``secret``. The words around a mention,
on one side or both, are its lexical patterns. Spark scores the graph of patterns
and instances in rounds: a pattern is worth the mean score of the instances it
extracts, an instance the best of its patterns; seeds stay at 1. An instance that
reaches the score counts as a seed in the next round and gives its other patterns
its kind. Patterns of high confidence discover identifiers that the seeds' forms
do not cover.

A seed of the four strict kinds is personal data wherever it stands. One of the
kind ``secret`` is reported only where a pattern of high confidence surrounds it:
the form alone, which a checksum has too, proves nothing.

Texts are scanned once, in a narrow pass that keeps per document the base spans
and the identifier-shaped tokens with their contexts; all later rounds run on
those alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")
#: The kind that only the method finds, and the order of kinds at one place.
SECRET = "secret"
ORDER = (*KINDS, SECRET)
ROUNDS = 3
#: A pattern must have this many different seeds and this score to discover anything.
MIN_SEEDS = 3
MIN_SCORE = 0.8
CONTEXT_CHARS = 64
INSTANCE_CHARS = 64

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# With the look-behind a run of digits is tried once, from its start; later starts in it fail alike.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SHAPED = re.compile(r"[^\s,;()<>\"']+")
_DIGIT_OR_AT = re.compile(r"[0-9@]")
#: A key or password made by a machine: so many characters, of these, with letters and digits.
_SECRET = re.compile(r"[A-Za-z0-9_+/=-]{20,512}")
SECRET_DIGITS = SECRET_LETTERS = 4
# Groups of digits joined by single spaces, dots, hyphens or parentheses; possessive, so that runs are tried once.
_GROUPS = re.compile(r"(?<![0-9])\(?[0-9]++(?:(?:\)[ .-]?|[ .-]\(?|\()[0-9]++)+")
_TOKEN = re.compile(r"\w+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: time stays linear in any text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed; code points, end exclusive."""
    out = [(a, b, "email") for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def contexts(text: str, start: int, end: int) -> list[str]:
    """Patterns of a mention, in lower case, digits as 0: two words before and one after, one and one, two or one before, one after."""
    left = _TOKEN.findall(text[max(0, start - CONTEXT_CHARS) : start].lower())[-2:]
    right = _TOKEN.findall(text[end : end + CONTEXT_CHARS].lower())[:1]
    sides = [(left, right), (left[-1:], right), (left, []), (left[-1:], []), ([], right)]
    return list(dict.fromkeys(re.sub(r"\d+", "0", " ".join(x) + " _ " + " ".join(y)) for x, y in sides if x or y))


def instance(identifier: str) -> str:
    """The key of an identifier in the graph: itself in lower case, or its digest if it is long."""
    low = identifier.lower()
    return low if len(low) <= INSTANCE_CHARS else hashlib.sha256(low.encode("utf-8", "surrogatepass")).hexdigest()


def secret(token: str) -> bool:
    """Whether a token has the form of a machine-made key."""
    if not _SECRET.fullmatch(token):
        return False
    return sum(c.isdigit() for c in token) >= SECRET_DIGITS and sum(c.isalpha() for c in token) >= SECRET_LETTERS


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Identifier-shaped tokens and runs of digit groups outside the base spans: six or more characters, with three digits or an @."""
    out, i = [], 0
    shaped = {m.span() for m in _SHAPED.finditer(text) if m.end() - m.start() >= 6 and _DIGIT_OR_AT.search(m[0])}
    for a, b in sorted(shaped | {m.span() for m in _GROUPS.finditer(text)}):
        while a < b and text[b - 1] in ".:!?*#$%&|":
            b -= 1
        if b - a < 6 or ("@" not in text[a:b] and sum(c.isdigit() for c in text[a:b]) < 3):
            continue
        while i < len(base) and base[i][1] <= a:
            i += 1
        if all(s[1] <= a or s[0] >= b for s in base[i : i + 64]):
            out.append((a, b))
    return list(dict.fromkeys(out))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_MENTION = pa.struct([("kind", pa.string()), ("seed", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, doc, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            text = text.as_py() or ""
            base = base_spans(text)
            found = [(k, k, a, b) for a, b, k in base]
            found += [(None, SECRET if secret(text[a:b]) else None, a, b) for a, b in candidates(text, base)]
            mentions = [
                {"kind": k, "seed": seed, "start": a, "end": b, "instance": instance(text[a:b]), "patterns": contexts(text, a, b)}
                for k, seed, a, b in found
            ]
            rows.append((key, doc, written(base), [sum(s[2] == k for s in base) for k in KINDS], mentions))
        key, doc, base, n, mentions = zip(*rows) if rows else ((),) * 5
        doc = pa.array([d.as_py() for d in doc], batch.schema.field(1).type)
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), doc, pa.array(base, pa.string()), pa.array(n, pa.list_(pa.int64())), pa.array(mentions, pa.list_(_MENTION))], ["key", "doc_id", "base", "n", "mentions"])


def discover(mentions: DataFrame, scratch: Scratch, *, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """``mentions(seed kind or null, instance, pattern, ...)`` -> ``(pattern, kind, worth, seeds)`` of high confidence.

    Only counts per (pattern, instance) go through the rounds; a frequent
    pattern or instance is summed map-side and joined as one row.
    """
    edges = scratch.save(mentions.groupBy("pattern", "instance", F.col("seed").alias("own")).agg(F.count("*").alias("n")), "edges")
    free = edges.filter("own is null")
    kinds = edges.filter("own is not null").select("pattern", F.col("own").alias("kind")).distinct()
    instances = None
    for i in range(rounds):
        if instances is None:
            scored = edges.join(kinds, "pattern").withColumn("reached", F.lit(0.0))
        else:
            induced = free.join(instances.filter(F.col("reached") >= min_score), "instance").select("pattern", "kind")
            scored = edges.join(kinds.unionByName(induced).distinct(), "pattern").join(instances, ["instance", "kind"], "left")
        score = F.when(F.col("own") == F.col("kind"), 1.0).when(F.col("own").isNotNull(), 0.0).otherwise(F.coalesce("reached", F.lit(0.0)))
        scored = scored.withColumn("score", score).withColumn("seed", (F.col("own").isNotNull() & (F.col("score") == 1)) | (F.col("own").isNull() & (F.col("score") >= min_score)))
        patterns = scored.groupBy("pattern", "kind").agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("worth"), F.count_if("seed").alias("seeds"))
        patterns = scratch.save(patterns, f"patterns{i}")
        if i + 1 < rounds:
            able = patterns.filter(F.col("seeds") >= min_seeds)
            instances = scratch.save(free.join(able, "pattern").groupBy("instance", "kind").agg(F.max("worth").alias("reached")), f"instances{i}")
    good = patterns.filter((F.col("seeds") >= min_seeds) & (F.col("worth") >= min_score))
    best = F.max(F.struct("worth", "seeds", "kind")).alias("best")
    return good.groupBy("pattern").agg(best).select("pattern", "best.kind", "best.worth", "best.seeds")


def find_pii(docs: DataFrame, **how) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, n (counts of base spans, in the order of KINDS), n_found, base, spans.

    base and spans list kind:start:end by start, then kind; spans holds all base
    spans and the ``n_found`` discovered ones, less those within another. Null
    texts count as empty. Repeated rows give repeated results; an empty table
    gives none.
    """
    scratch = Scratch(docs.sparkSession, "pii")
    slim = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.col("text").cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    mention = "struct<kind: string, seed: string, start: bigint, end: bigint, instance: string, patterns: array<string>>"
    scanned = slim.mapInArrow(_scan, f"key long, doc_id {kind}, base string, n array<long>, mentions array<{mention}>")
    scanned = scratch.save(scanned, "scanned")
    mentions = scanned.select("key", F.explode("mentions").alias("m")).select("key", "m.*")
    mentions = mentions.withColumn("pattern", F.explode("patterns")).drop("patterns")
    patterns = discover(mentions, scratch, **how)
    new = mentions.filter("kind is null").drop("kind").join(patterns, "pattern")
    new = new.groupBy("key", "start", "end").agg(F.max_by("kind", F.struct("worth", "seeds", "kind")).alias("kind"))
    # A span is within another if one that begins no later, longest first, ends no earlier.
    before = Window.partitionBy("key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    new = new.withColumn("reach", F.max("end").over(before)).filter("reach is null or reach < end")
    new = new.groupBy("key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("new"))
    order = F.array(*[F.lit(k) for k in ORDER])

    def ranked(x: Column) -> Column:
        place = F.array_position(order, x["kind"]).alias("place")
        return F.struct(x["start"].alias("start"), place, x["end"].alias("end"), x["kind"].alias("kind"))

    base = F.transform(F.filter("mentions", lambda m: m["kind"].isNotNull()), ranked)
    found = F.transform(F.coalesce("new", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")), ranked)
    spans = F.array_sort(F.concat(base, found))
    text = F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = F.coalesce(F.array_size("new"), F.lit(0)).cast("long")
    return scanned.join(new, "key", "left").select("doc_id", "n", count.alias("n_found"), "base", text.alias("spans"))
