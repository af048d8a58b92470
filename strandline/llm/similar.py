"""Near copies by the similarity of word shingles: SimHash by covering LSH, prefix keys, and all pairs that these leave apart.

Texts with equal shingles are one node, with a 64-bit SimHash fingerprint. Covering
LSH (``covering``) finds all nodes whose fingerprints differ in 3 bits or fewer; a
tree of such pairs is verified by the exact similarity of the shingle sets. Pairs
at the bound of 0.8 mostly differ in more bits, so what follows finds the rest.

Two sets of shingles with a similarity (Jaccard) of t or more have t of the
larger one in common. Put the shingles of every text in one order: of a text of n
the first n - ceil(tn) + 1 are its keys, and such a pair has one of them in common
for certain (Chaudhuri et al., "A Primitive Operator for Similarity Joins", 2006).
Any order gives all pairs. This one puts those last that a sample of texts often
has, so that few texts meet by a common passage alone; the rest go by their hashes.

In a bucket, 256-bit SimHash sketches of the nodes, the fingerprint and three like
it, give a least spanning tree, so a bucket of k sends k - 1 links and not its
pairs. These links are verified too.

What all these links leave apart is then compared pair by pair: in each bucket, all
nodes of different components. Pairs that their sizes, or their numbers of
shingles in 256 bins, rule out for certain are left; the others are verified too.
So no link between components is lost, whatever the sketches say.

A key's place among its text's shingles rules out most pairs before that. At the
first key that two texts have in common, what they share lies behind it in both
(Xiao et al., "Efficient Similarity Joins for Near Duplicate Detection", 2008). So
the smaller of a similar pair has that key among its first n - ceil(2t/(1+t) n) + 1,
its leading ones; keys that lead nowhere make no bucket. Texts that share a long
passage and are less similar than t meet at the passage's shingles, which come
last, with too little behind them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.covering import hamming_links
from strandline.llm.graph import components
from strandline.llm.scratch import Scratch
from strandline.llm.spread import join_spread
from strandline.llm.words import word_runs

SHINGLE = 5
SIMILARITY = 0.8
#: Sketches differ in 39 of 256 bits on average at similarity 0.8, with a deviation of 6.
SKETCH_WORDS, SKETCH_RADIUS = 4, 76
#: Buckets up to this size give all their close pairs, larger ones a spanning tree.
ALL_PAIRS = 8
#: Bins of a profile, one byte each; unlike texts of up to some 5000 shingles are told apart.
BINS = 256
#: The order of the shingles, with no part in the result, comes from so many texts up to a length in bytes, and holds so many shingles.
ORDER_TEXTS, ORDER_BYTES, ORDER_LEAST, ORDER_SHINGLES = 20_000, 200_000, 8, 1 << 16


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """SplitMix64 of each hash plus a multiple of its increment."""
    z = h + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different XXH64 (seed 42) of the word shingles; a text with fewer words is one shingle, without words none."""
    digest, found = xxhash.xxh64_intdigest, []
    for run in word_runs(text or b"", shingle - 1):
        hashes = [digest(b" ".join(run[i : i + shingle]), 42) for i in range(max(1, len(run) - shingle + 1))]
        found.append(np.array(hashes, np.uint64))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint64)


def sketch(hashes: np.ndarray) -> bytes:
    """SimHash of 256 bits: a bit is set where it is in over half the hashes."""
    ones = np.zeros(64 * SKETCH_WORDS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)]
        words = np.stack([mixed(part, 100 + i) for i in range(SKETCH_WORDS)], axis=1).astype("<u8")
        ones += np.unpackbits(words.view("u1"), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes()


def profile(hashes: np.ndarray) -> bytes:
    """How many of the hashes are in each bin, 255 at most; profiles differ by no more than the sets do."""
    return np.minimum(np.bincount((hashes % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype("u1").tobytes()


def covering_keys(hashes: np.ndarray, similarity: float = SIMILARITY, frequent: np.ndarray | None = None) -> np.ndarray:
    """The first hashes of a sorted set, ``frequent`` (sorted) ones last: as many as any similar set must meet."""
    n = len(hashes)
    if n and frequent is not None and len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hashes = hashes[np.argsort(frequent[at] == hashes, kind="stable")]
    return hashes[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def least_common(sizes, similarity: float):
    """The least number of common elements of two similar sets whose sizes sum to ``sizes``."""
    return similarity / (1 + similarity) * sizes - 1e-6


def _shingle_counts(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(text_key, text) -> (hash, n), a repeated text of a few once."""
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            first = np.unique(part.column(0).to_numpy(), return_index=True)[1]
            found = np.concatenate([shingle_set(part.column(1)[int(i)].as_py(), shingle) for i in first])
            h, n = np.unique(found, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["hash", "n"])


def frequent_shingles(slim: DataFrame, shingle: int) -> np.ndarray:
    """Sorted hashes of shingles that many of a sample of ``slim(text_key, text)`` have."""
    every = max(1, slim.count() // ORDER_TEXTS)
    picked = slim.filter((F.pmod("text_key", F.lit(every)) == 0) & (F.length("text") <= ORDER_BYTES)).select("text_key", "text")
    counts = picked.mapInArrow(lambda it: _shingle_counts(it, shingle), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    most = counts.filter(F.col("n") >= ORDER_LEAST).orderBy(F.desc("n"), "hash").limit(ORDER_SHINGLES)
    return np.sort(np.array([r["hash"] for r in most.select("hash").collect()], np.int64).view(np.uint64))


def _nodes(batches: Iterator[pa.RecordBatch], shingle: int, similarity: float, frequent) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, text) -> doc_id, text_key, node (a hash of the shingle set), fp, size, sketch, profile, keys."""
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            sets = [shingle_set(t.as_py(), shingle) for t in part.column(2)]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64)
            keys = [covering_keys(s, similarity, frequent.value) for s in sets]
            offsets = np.cumsum([0, *[len(k) for k in keys]]).astype(np.int32)
            flat = pa.array(np.concatenate(keys).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(offsets), flat)
            sketches = [sketch(s) for s in sets]
            fps = pa.array(np.frombuffer(b"".join(sketches), "<i8")[::SKETCH_WORDS])
            of_set = [fps, pa.array([len(s) for s in sets], pa.int64()), pa.array(sketches, pa.binary()), pa.array([profile(s) for s in sets], pa.binary())]
            columns = [part.column(0), part.column(1), pa.array(nodes.view(np.int64)), *of_set, lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "node", "fp", "size", "sketch", "profile", "keys"])


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Rows in order of their first column -> the columns, never parted within a run of it."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        if held:
            columns = [np.concatenate(c) for c in zip(held, columns)]
        cut = int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield [c[:cut] for c in columns]
        held = [c[cut:] for c in columns]
    if held:
        yield held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, pos, leads) in order of keys -> (key, node, pos) of keys that several have and that lead in one of them."""
    for key, node, pos, leads in _whole_runs(batches):
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        rows = np.diff([*starts, len(key)])
        kept = np.repeat((rows > 1) & np.logical_or.reduceat(leads, starts), rows)
        if kept.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in (key, node, pos)], ["key", "node", "pos"])


def distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.bitwise_count(many ^ one).sum(axis=1, dtype=np.int64)


def close_links(sketches: np.ndarray, radius: int = SKETCH_RADIUS) -> list[tuple[int, int, int]]:
    """(i, j, distance) within ``radius``: all pairs of few sketches, of many a least spanning tree (Prim)."""
    n = len(sketches)
    if n <= ALL_PAIRS:
        rows = ((i, i + 1 + j, int(d)) for i in range(n - 1) for j, d in enumerate(distances(sketches[i], sketches[i + 1 :])))
        return [r for r in rows if r[2] <= radius]
    out, left = [], np.arange(1, n)
    best, parent = distances(sketches[0], sketches[left]), np.zeros(n - 1, np.int64)
    while len(left):
        at = int(best.argmin())
        node, d = int(left[at]), int(best[at])
        if d <= radius:
            out.append((int(parent[at]), node, d))
        keep = np.arange(len(left)) != at
        left, best, parent = left[keep], best[keep], parent[keep]
        new = distances(sketches[node], sketches[left])
        nearer = new < best
        best, parent = np.where(nearer, new, best), np.where(nearer, node, parent)
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, sketch) in order of keys -> (u, v, distance), u < v."""
    for key, node, sketches in _whole_runs(batches):
        words = np.frombuffer(b"".join(sketches), "<u8").reshape(len(key), SKETCH_WORDS)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        links: list[tuple[int, int, int]] = []
        for a, b in zip(cuts, cuts[1:]):
            links += [(int(node[a + i]), int(node[a + j]), d) for i, j, d in close_links(words[a:b])]
        if links:
            u, v, d = (np.array(x, np.int64) for x in zip(*links))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(d)], ["u", "v", "distance"])


def crossing_pairs(root: np.ndarray, size: np.ndarray, profiles: np.ndarray, similarity: float, pos: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(i, all j) of different roots, each pair once, but for those that are proved to be less similar.

    Sizes and profiles prove it, and so does ``pos``, the place of the bucket's
    key in each set: then the pair has an earlier key in common or is less similar.
    """
    order = np.argsort(size, kind="stable")
    root, size, profiles = root[order], size[order], profiles[order].astype(np.int16)
    behind = size if pos is None else size - pos[order]
    ends = np.searchsorted(size, size / similarity + 1e-6, side="right")
    for i in np.flatnonzero(behind >= least_common(2 * size, similarity)).tolist():
        others = slice(i + 1, int(ends[i]))
        common = np.minimum(behind[others], behind[i])
        near = i + 1 + np.flatnonzero((root[others] != root[i]) & (common >= least_common(size[others] + size[i], similarity)))
        if len(near):
            apart = np.abs(profiles[near] - profiles[i]).sum(axis=1, dtype=np.int64)
            near = near[apart <= (size[near] + size[i]) * (1 - similarity) / (1 + similarity) + 1e-6]
            if len(near):
                yield int(order[i]), order[near]


def _crossing(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows (key, node, pos, root, size, profile) in order of keys -> (u, v), u < v, of different roots that may be similar."""
    for key, node, pos, root, size, profiles in _whole_runs(batches):
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        mixed_roots = np.minimum.reduceat(root, cuts[:-1]) != np.maximum.reduceat(root, cuts[:-1])
        us, vs, held = [], [], 0
        for a, b in zip(cuts[:-1][mixed_roots], cuts[1:][mixed_roots]):
            counts = np.frombuffer(b"".join(profiles[a:b]), "u1").reshape(b - a, BINS)
            for i, near in crossing_pairs(root[a:b], size[a:b], counts, similarity, pos[a:b]):
                us.append(np.full(len(near), node[a + i]))
                vs.append(node[a:b][near])
                held += len(near)
                if held >= 1 << 16:
                    yield _pairs(us, vs)
                    us, vs, held = [], [], 0
        if us:
            yield _pairs(us, vs)


def _pairs(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
    """Both ends in order, each pair once."""
    ends = np.unique(np.sort(np.stack([np.concatenate(us), np.concatenate(vs)], axis=1), axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[:, 0])), pa.array(np.ascontiguousarray(ends[:, 1]))], ["u", "v"])


def similar_sets(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common + 1e-9 >= similarity * (len(a) + len(b) - common)


def _verified(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column(2), batch.column(3))
        keep = [similar_sets(np.frombuffer(a.as_py(), "<u8"), np.frombuffer(b.as_py(), "<u8"), similarity) for a, b in pairs]
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def _hash_sets(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """(text_key, node, text) -> (node, hashes), a repeated text of a batch once."""
    for batch in batches:
        first = np.unique(batch.column(0).to_numpy(), return_index=True)[1] if len(batch) else []
        for i in first:
            hashes = shingle_set(batch.column(2)[int(i)].as_py(), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(1).slice(int(i), 1), pa.array([hashes.tobytes()], pa.binary())], ["node", "hashes"])


def covering_pairs(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Distinct ``nodes(node, fp)`` -> ``(u, v)``, u < v: nodes of equal fingerprints or of two within the radius, linked like all such pairs."""
    own = Scratch(nodes.sparkSession, "covering", clean=True)
    prints = own.save(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("copies")), "prints")
    equal = join_spread(nodes.select("node", "fp"), prints, ["fp"], "copies", nodes.count()).select(F.col("first").alias("u"), F.col("node").alias("v"))
    links = hamming_links(prints.select("fp"), own, trees=True)
    for end in ("u", "v"):
        links = links.join(prints.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")), end)
    pairs = equal.unionByName(links.select(F.col("first_u").alias("u"), F.col("first_v").alias("v"))).filter("u <> v")
    pairs = scratch.save(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "covering")
    own.delete()
    return pairs


def grown(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``roots(node, root)`` after ``links(u, v)`` have joined components; nodes without a row are their own root.

    Only the roots at the ends of links are gone through, not the links within components.
    """
    for end in ("u", "v"):
        links = links.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    joined = components(links.select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v")), scratch)
    joined = joined.select(F.col("u").alias("root"), F.col("v").alias("new_root"))
    moved = roots.join(joined, "root", "left").select("node", F.coalesce("new_root", "root").alias("root"))
    return scratch.save(moved.unionByName(joined.select(F.col("root").alias("node"), F.col("new_root").alias("root"))), "roots")


def similar_nodes(docs: DataFrame, *, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, text_key, node, root)``, one row for each input row.

    ``root`` is equal for texts that are linked by a chain of pairs with a
    shingle similarity of at least ``similarity``. text_key is a hash of the
    text. Texts without words, null ones too, have equal (empty) sets. Repeated
    rows stay repeated; an empty table gives none.
    """
    scratch = Scratch(docs.sparkSession, "similar", clean=True)
    slim = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(slim, shingle))
    fields = f"doc_id {kind}, text_key long, node long, fp long, size long, sketch binary, profile binary, keys array<long>"
    rows = scratch.save(slim.mapInArrow(lambda it: _nodes(it, shingle, similarity, frequent), fields), "nodes")
    nodes = rows.select("node", "fp", "size", "sketch", "profile", "keys").dropDuplicates(["node"])
    nodes = scratch.save(nodes, "distinct")
    members = scratch.save(rows.select("doc_id", "text_key", "node"), "members")
    scratch.drop(rows)
    covering = covering_pairs(nodes, scratch)

    leads = F.col("size") - F.col("pos") >= least_common(2 * F.col("size"), similarity)
    keyed = nodes.select("node", "size", F.posexplode("keys").alias("pos", "key")).select("key", "node", "pos", leads.alias("leads"))
    keyed = keyed.repartition("key").sortWithinPartitions("key")
    shared = scratch.save(keyed.mapInArrow(_shared, "key long, node long, pos int"), "shared")
    sketched = shared.join(nodes.select("node", "sketch"), "node").select("key", "node", "sketch")
    links = sketched.repartition("key").sortWithinPartitions("key").mapInArrow(_bucket_links, "u long, v long, distance long")
    links = scratch.save(links.groupBy("u", "v").agg(F.min("distance").alias("distance")), "links")

    def sets_of(pairs: DataFrame, name: str) -> DataFrame:
        needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        # One row of each node, so copies of one text are not sent to one task.
        first = members.join(needed, "node", "left_semi").groupBy("node").agg(F.min(F.struct("text_key", "doc_id")).alias("row"))
        first = first.select("node", F.col("row.text_key").alias("_key"), F.col("row.doc_id").alias("_id"))
        texts = slim.join(first, (F.col("text_key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("text_key", "node", "text")
        return scratch.save(texts.mapInArrow(lambda it: _hash_sets(it, shingle), "node long, hashes binary").dropDuplicates(["node"]), name)

    def verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        left = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
        right = sets.select(F.col("node").alias("v"), F.col("hashes").alias("b"))
        both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
        return scratch.save(both.mapInArrow(lambda it: _verified(it, similarity), "u long, v long"), name)

    sets = sets_of(links.select("u", "v").unionByName(covering), "sets")
    # The links by fingerprints and the nearest one of each node first; of the others, those between what these leave apart.
    nearest = links.groupBy("v").agg(F.min_by("u", F.struct("distance", "u")).alias("u")).select("u", "v")
    first = scratch.save(covering.unionByName(nearest).distinct(), "first")
    good = verified(first, sets, "verified-first")
    first_roots = components(good, scratch)
    roots = first_roots.select(F.col("u").alias("node"), F.col("v").alias("root"))
    other = links.select("u", "v").join(first, ["u", "v"], "left_anti")
    for end in ("u", "v"):
        named = roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
        other = other.join(named, end, "left").withColumn(f"root_{end}", F.coalesce(f"root_{end}", end))
    more = verified(other.filter("root_u <> root_v").select("u", "v"), sets, "verified-others")
    roots = grown(roots, more, scratch)
    scratch.drop(covering, links, first, sets, good, first_roots, more)

    # Whatever shares a key and is not yet linked: all pairs that may be similar.
    named = nodes.select("node", "size", "profile").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    met = shared.join(named, "node").select("key", "node", "pos", "root", "size", "profile")
    apart = met.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _crossing(it, similarity), "u long, v long")
    apart = scratch.save(apart.distinct(), "apart")
    scratch.drop(nodes, shared)
    sets = sets_of(apart, "sets-apart")
    found = verified(apart, sets, "verified-apart")
    scratch.drop(apart, sets)
    last_roots = grown(roots, found, scratch)
    scratch.drop(found, roots)
    classes = members.groupBy("node").agg(F.count("*").alias("n")).join(last_roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return join_spread(members, classes, ["node"], "n", members.count()).select("doc_id", "text_key", "node", "root")
