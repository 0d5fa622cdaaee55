"""Near duplicates by b-bit MinHash.

1. Every text becomes the set of its distinct word shingles. Its minima under
   ``BANDS * ROWS`` (and a few more) hash functions give band keys; the low two
   bits of each minimum are packed into the signature.
2. Texts with the same set are one class, represented by its smallest id. Only
   representatives go on, so a group of copies of any size is one entry.
3. Representatives that share a band key meet in a bucket. Each is paired with
   the bucket's smallest id; pairs whose collision-corrected similarity, counted
   from the signatures' bits, is far below the threshold are left out. What
   hangs together by these pairs is a cluster.
4. Members of a bucket that lie in different clusters are compared by their
   signatures (large buckets in pairs of chunks, so many tasks share one).
5. Both kinds of pairs are confirmed on the full sets, and components are found.
6. In a cluster that holds several components, every member outside the largest
   one is compared with all other members on the full sets, in blocks. Members of
   one component need no comparison: the result would be the same.

So no link between components is lost, and a group of thousands of near copies
makes some pairs per member, not per pair.

A pair of similarity 0.8 shares no band with probability 3e-6 and is estimated
below the margin with probability below 1e-6.

Defined results: null and empty texts, and texts without words, have the empty
set and are linked with nothing; a text of fewer words than a shingle is one
shingle; rows with one id are one document; rows without an id are linked with
nothing (``component_id`` null, kept); extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from jobtrail.llm.components import components
from jobtrail.llm.shared import join_facts, join_places, places_of, releasing, written

BANDS, ROWS = 42, 6
MINIMA = 256
BITS = 2
SIGNATURE = MINIMA * BITS // 64
# Deviations of the estimate that the margin allows for.
DEVIATIONS = 5.0
CHUNK = 512
CACHED_WORDS, CACHED_LENGTH = 200_000, 64

_rng = np.random.default_rng(20_240_501)
_XOR = _rng.integers(0, 1 << 64, (MINIMA, 1), dtype=np.uint64)
_MULTIPLY = _rng.integers(0, 1 << 63, (MINIMA, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


_hashes = _WordHash()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``width`` words, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    span = min(width, len(hashes))
    n = len(hashes) - span + 1
    out = np.full(n, np.uint64(span))
    for i in range(span):
        out = _mixed(out * _STEP + hashes[i:i + n])
    return np.unique(out)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The smallest 32-bit value of the set under each hash function."""
    low = np.full(MINIMA, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        values = (shingles[None, at:at + 1024] ^ _XOR) * _MULTIPLY
        np.minimum(low, values.min(axis=1), out=low)
    return low >> np.uint64(32)


def band_keys(low: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low[:BANDS * ROWS].reshape(BANDS, ROWS).T:
        keys = _mixed(keys * _STEP + row)
    return keys.view(np.int64)


def signature(low: np.ndarray) -> np.ndarray:
    bits = (low & np.uint64((1 << BITS) - 1)).reshape(SIGNATURE, -1)
    shifts = np.arange(bits.shape[1], dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(bits << shifts, axis=1).view(np.int64)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two signatures: equal low bits, corrected for those equal by chance."""
    odd = F.lit(0x5555555555555555).cast("bigint")
    unequal = []
    for i in range(SIGNATURE):
        x = a[i].bitwiseXOR(b[i])
        unequal.append(F.bit_count(x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(odd)))
    chance = 1.0 / (1 << BITS)
    match = F.lit(1.0) - reduce(lambda x, y: x + y, unequal) / F.lit(float(MINIMA))
    return (match - F.lit(chance)) / F.lit(1.0 - chance)


def margin(threshold: float) -> float:
    """The smallest estimate that is still looked at."""
    chance = 1.0 / (1 << BITS)
    match = threshold + (1 - threshold) * chance
    return threshold - DEVIATIONS * (match * (1 - match) / MINIMA) ** 0.5 / (1 - chance)


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, n_shingles, set_key, bands, sig``; key, bands and signature are null for the empty set."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, bands, sigs = [], [], [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                shingles = shingle_set(text or b"", width)
                sizes.append(len(shingles))
                if len(shingles):
                    low = minima(shingles)
                    keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    bands.append(band_keys(low))
                    sigs.append(signature(low))
                else:
                    keys.append(None)
                    bands.append(None)
                    sigs.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set_key", "bands", "sig"])
        _hashes.clear()

    return docs.mapInArrow(releasing(make), "doc_id long, n_shingles long, set_key binary, bands array<long>, sig array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``doc_id, set`` of the documents in ``wanted``: the shingles' sorted hashes, 8 bytes each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(text or b"", width).tobytes() for text in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "set"])

    # The same plan at every size: the texts are shuffled once, the ids are not sent to all.
    chosen = docs.join(wanted.hint("shuffle_hash"), "doc_id", "left_semi")
    return chosen.select("doc_id", "text").mapInArrow(releasing(sets), "doc_id long, set binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs ``a, b`` whose full sets have ``100 * intersection >= percent * union``."""
    # The hot side last: its sets are copied inside the tasks that check, not shuffled with every pair.
    half = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), "b")
    places = pairs.groupBy("a").agg(places_of("b").alias("_places"))
    both = join_places(half, places.join(sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), "a"), "a", "b") \
        .select("a", "b", "set_a", "set_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                common = int(np.count_nonzero(merged[1:] == merged[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(releasing(check), "a long, b long")


def _star_pairs(buckets: DataFrame, signatures: DataFrame, least: float) -> DataFrame:
    pairs = buckets.where("member <> first").select(F.col("first").alias("a"), F.col("member").alias("b")).distinct()
    sides = [signatures.select(F.col("doc_id").alias(s), F.col("sig").alias(f"sig_{s}")) for s in ("a", "b")]
    return join_facts(pairs, sides[0], "a", "b").join(sides[1], "b") \
        .where(estimate(F.col("sig_a"), F.col("sig_b")) >= least).select("a", "b")


def _cross_pairs(buckets: DataFrame, signatures: DataFrame, clusters: DataFrame, least: float) -> DataFrame:
    """Promising pairs of different clusters that share a bucket."""
    placed = buckets.select("key", "member").join(clusters.select(F.col("node").alias("member"), "root"), "member", "left") \
        .select("key", "member", F.coalesce("root", "member").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"),
                                      F.count(F.lit(1)).alias("n"), places_of("member").alias("_places")).where("_low <> _high")
    chunks = mixed.select("key", "_places", F.ceil(F.col("n") / F.lit(CHUNK)).cast("int").alias("chunks"))
    members = join_places(placed, chunks, "key", "member") \
        .withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int")) \
        .join(signatures.select(F.col("doc_id").alias("member"), "sig"), "member")
    spread = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))) \
        .withColumn("lo", F.least("chunk", "other")).withColumn("hi", F.greatest("chunk", "other"))
    x, y = spread.alias("x"), spread.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    once = ((F.col("x.lo") == F.col("x.hi")) & (F.col("x.member") < F.col("y.member"))) | \
        ((F.col("x.chunk") == F.col("x.lo")) & (F.col("y.chunk") == F.col("y.hi")) & (F.col("x.lo") < F.col("x.hi")))
    near = estimate(F.col("x.sig"), F.col("y.sig")) >= least
    found = x.join(y, same & once & (F.col("x.root") != F.col("y.root")) & near)
    return found.select(F.least("x.member", "y.member").alias("a"), F.greatest("x.member", "y.member").alias("b")).distinct()


def _linked(x: np.ndarray, ends: np.ndarray, vocabulary: np.ndarray, places: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets laid end to end (``places`` in ``vocabulary``) are linked with the set ``x``."""
    at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
    mark = np.zeros(len(vocabulary), dtype=np.int64)
    mark[at[vocabulary[at] == x]] = 1
    starts = ends - np.diff(ends, prepend=0)
    common = np.add.reduceat(mark[places], starts)
    return 100 * common >= percent * (len(x) + (ends - starts) - common)


def _inside_clusters(clusters: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between the components of each cluster; one per member and other component."""
    placed = clusters.select("node", F.col("root").alias("cluster")).join(roots, "node", "left") \
        .select("node", "cluster", F.coalesce("root", "node").alias("root"))
    sizes = placed.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("n"))
    facts = sizes.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")) \
        .where("top.n < n").select("cluster", F.col("top.root").alias("main"),
                                   F.ceil(F.col("n") / F.lit(CHUNK)).cast("int").alias("parts"),
                                   F.ceil((F.col("n") - F.col("top.n")) / F.lit(CHUNK)).cast("int").alias("few"))
    members = join_facts(placed, facts, "cluster", "node").join(sets.withColumnRenamed("doc_id", "node"), "node")
    hashed = F.xxhash64("node")
    asked = members.where("root <> main").select(
        F.col("cluster").alias("x_cluster"), F.pmod(hashed, F.col("few")).cast("int").alias("x_i"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("x_j"),
        F.col("node").alias("x_node"), F.col("root").alias("x_root"), F.col("set").alias("x_set"))
    others = members.select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("few") - 1)).alias("i"),
        F.pmod(hashed, F.col("parts")).cast("int").alias("j"), "node", "root", "set")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = [], []
        if len(left) and len(right):
            found = [np.frombuffer(s, np.uint64) for s in right.column("set").to_pylist()]
            ends = np.cumsum([len(s) for s in found])
            vocabulary, places = np.unique(np.concatenate(found), return_inverse=True)
            nodes, roots = right.column("node").to_numpy(), right.column("root").to_numpy()
            for node, root, data in zip(*[left.column(c).to_pylist() for c in ("x_node", "x_root", "x_set")]):
                hits = np.flatnonzero(_linked(np.frombuffer(data, np.uint64), ends, vocabulary, places, percent) & (roots != root))
                for at in np.unique(roots[hits], return_index=True)[1]:
                    a.append(node)
                    b.append(int(nodes[hits[at]]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return asked.groupBy("x_cluster", "x_i", "x_j").cogroup(others.groupBy("cluster", "i", "j")) \
        .applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id, kept``."""
    narrow = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    least = margin(percent / 100)
    # Read by the classes, the buckets, every estimate and the result.
    made = written(fingerprints(narrow, width), "fingerprints")
    classes = made.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key") \
        .agg(F.min("doc_id").alias("doc_id"))
    chosen = made.join(classes, ["set_key", "doc_id"]).dropDuplicates(["set_key", "doc_id"])
    signatures = written(chosen.select("doc_id", "sig", "bands"), "signatures")
    entries = signatures.select(F.col("doc_id").alias("member"), F.explode("bands").alias("key"))
    shared = entries.groupBy("key").agg(F.min("member").alias("first"), F.max("member").alias("_last"),
                                         places_of("member").alias("_places")).where("first <> _last").drop("_last")
    buckets = written(join_places(entries, shared, "key", "member").select("key", "first", "member"), "buckets")
    stars = written(_star_pairs(buckets, signatures, least), "star-pairs")
    clusters = components(stars)
    pairs = written(stars.unionByName(_cross_pairs(buckets, signatures, clusters, least)), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = written(full_sets(narrow, wanted, width), "sets")
    links = written(confirm(pairs, sets, percent), "links")
    roots = components(links)
    more = _inside_clusters(clusters, roots, sets, percent)
    joined = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(more)
    roots = components(joined)
    class_roots = classes.select("set_key", F.col("doc_id").alias("node")).join(roots, "node", "left") \
        .select("set_key", F.coalesce("root", "node").alias("root"))
    return made.select("doc_id", "n_shingles", "set_key").join(class_roots, "set_key", "left") \
        .select("doc_id", "n_shingles",
                F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id")).alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
