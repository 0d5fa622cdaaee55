"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text's terms are its words, weighted by how often they occur. For each of
``samples`` hash seeds every term draws two gamma numbers and one uniform
number from hashes of term and seed alone; the term's weight is rounded down on
the grid these define, and the term with the smallest resulting value is the
sample, together with its rounded weight. Two texts draw the same sample with
probability equal to their generalised Jaccard similarity (sum of the smaller
weights over sum of the larger ones), so the share of equal samples estimates it.

Documents are ordered by id. Each is edited with the beginning of the next one,
which is found inside blocks of neighbouring ids; a block also gets the first
row of the next block, so no task sorts more than a block.

Defined results: null texts are empty; texts without words have the empty
fingerprint, which is alike to itself (1) and to no other (0); rows without an
id come first in the order of a hash of their text; repeated rows are
neighbours; a single row is its own next; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobtrail.llm.shared import GAPS, ascii_lower, text_of, written
from jobtrail.operators.scan import Scan, key_scan

SAMPLES = 32
BLOCK_BITS = 10
# Block heads that travel to every task; with more of them the rows are joined by shuffling.
SENT_HEADS = 500_000
NO_ID = 1 << 62
HALF = float(1 << 32)


def _long(value: int) -> Column:
    return F.lit(value).cast("bigint")


def _uniforms(hash_: Column) -> tuple[Column, Column]:
    """Two numbers in (0, 1) from the halves of a 64-bit hash."""
    low = hash_.bitwiseAND(_long(0xFFFFFFFF))
    return (low + F.lit(0.5)) / F.lit(HALF), (F.shiftrightunsigned(hash_, 32) + F.lit(0.5)) / F.lit(HALF)


def sample_of(term: Column, log_weight: Column, r: Column, log_c: Column, beta: Column) -> Column:
    """The term's value in the upper bits, a hash of term and rounded weight in the lower ones; null without a weight."""
    steps = F.floor(log_weight / r + beta)
    log_a = log_c - r * (steps.cast("double") - beta) - r
    # Values lie in (-128, 128); 2**23 steps per unit keep their order.
    upper = F.floor((log_a + F.lit(128.0)) * F.lit(float(1 << 23))).cast("bigint")
    mark = F.xxhash64(term, steps).bitwiseAND(_long(0xFFFFFFFF))
    return F.when(log_weight.isNotNull(), F.shiftleft(upper, 32).bitwiseOR(mark))


def ordered_blocks(docs: DataFrame, id_column: str, text_column: str) -> tuple[DataFrame, DataFrame]:
    """Rows in blocks of neighbouring ids with their place and the next text; and the blocks' successors."""
    text = text_of(text_column)
    # Rows without an id come first, spread by a hash of the text.
    key = F.coalesce(F.col(id_column).cast("bigint"), _long(-NO_ID) - F.shiftrightunsigned(F.xxhash64(text), 3))
    rows = docs.select(key.alias("key"), F.xxhash64(text).alias("tie"), text.alias("text")) \
        .withColumn("block", F.shiftright("key", BLOCK_BITS)).withColumn("halo", F.lit(0))
    heads = rows.groupBy("block").agg(F.min(F.struct("key", "tie")).alias("head"))
    last = heads.agg(F.max("block")).scalar()
    chained = key_scan(heads, "block", [Scan("before", "last", "block", before=True)])
    heads = written(chained.select(F.coalesce("before", last).alias("before"), "block", "head.key", "head.tie"), "heads")
    few = heads.count() <= SENT_HEADS
    heads_ = F.broadcast(heads) if few else heads
    halo = rows.select("key", "tie", "text").join(heads_.select("key", "tie", "before"), ["key", "tie"]) \
        .select("key", "tie", "text", F.col("before").alias("block"), F.lit(1).alias("halo"))
    order = Window.partitionBy("block").orderBy("halo", "key", "tie")
    placed = rows.unionByName(halo).select(
        "block", "key", "halo", "text", F.row_number().over(order).alias("place"),
        F.lead("text").over(order).alias("next_text"), F.lead("halo").over(order).alias("next_halo")).where("halo = 0")
    return placed, heads.select("before", F.col("block").alias("after"))


def weighted_terms(texts: DataFrame, row: list[str]) -> DataFrame:
    """Weights of each row's words in ``text`` (``a``) and its edited form (``b``) by the words' hashes; a row without words has null."""
    # Letters are lowered before the texts are put together, those of ``text`` once for both.
    lowered = texts.select(*row, ascii_lower(F.col("text")).alias("_text"), ascii_lower(F.col("head")).alias("_head"), "kept")
    both = lowered.select(*row, F.explode(F.array(
        F.struct(F.col("_text").alias("t"), F.lit(1).alias("a"), F.lit(0).alias("b")),
        F.struct(F.concat(F.substr("_text", F.lit(1), F.col("kept")), "_head").alias("t"),
                 F.lit(0).alias("a"), F.lit(1).alias("b")))).alias("s"))
    words = both.select(*row, "s.a", "s.b", F.explode(F.split("s.t", GAPS)).alias("word"))
    terms = words.select(*row, "a", "b", F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    return terms.groupBy(*row, "term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def draw_samples(terms: DataFrame, row: list[str], samples: int) -> DataFrame:
    """``samples`` of each row's two texts, null for a text without words."""
    # The logarithm of a weight once per term, not once per sample; that of no weight is null.
    logs = [F.when(F.col("term").isNotNull() & (F.col(c) > 0), F.log(F.col(c).cast("double"))).alias(c) for c in ("a", "b")]
    counted = terms.select(*row, "term", *logs)
    seeded = counted.withColumn("k", F.explode(F.array([F.lit(i) for i in range(samples)]))) \
        .withColumn("h1", F.xxhash64("term", "k")).withColumn("h2", F.xxhash64("h1", F.lit(1)))
    u1, u2 = _uniforms(F.col("h1"))
    u3, u4 = _uniforms(F.col("h2"))
    u5, _ = _uniforms(F.xxhash64("h2", F.lit(2)))
    drawn = seeded.select(*row, "term", "k", "a", "b", (-F.log(u1 * u2)).alias("r"),
                          F.log(-F.log(u3 * u4)).alias("log_c"), u5.alias("beta"))
    values = [sample_of(F.col("term"), F.col(c), F.col("r"), F.col("log_c"), F.col("beta")) for c in ("a", "b")]
    least = drawn.groupBy(*row, "k").agg(F.min(values[0]).alias("a"), F.min(values[1]).alias("b"))
    marks = least.select(*row, "k", *[F.col(c).bitwiseAND(_long(0xFFFFFFFF)).alias(c) for c in ("a", "b")])
    return marks.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct("k", "a", "b"))).alias("samples"))


def _written_marks(samples: Column, side: str) -> Column:
    """The marks in hexadecimal, empty for a text without words."""
    return F.concat_ws("", F.transform(samples, lambda s: F.when(s[side].isNotNull(), F.lpad(F.hex(s[side]), 8, "0"))))


def likeness(a: Column, b: Column, samples: int) -> Column:
    """Share of equal marks of two fingerprints in hexadecimal."""
    equal = F.aggregate(F.sequence(F.lit(0), F.lit(samples - 1)), F.lit(0), lambda n, k: n + F.when(
        F.substr(a, k * 8 + 1, F.lit(8)) == F.substr(b, k * 8 + 1, F.lit(8)), 1).otherwise(0))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(equal / F.lit(float(samples)))


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES, id_column: str = "doc_id",
                        text_column: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``. Edited: the last half of the code points replaced
    by as many from the beginning of the next text.
    """
    placed, after = ordered_blocks(docs, id_column, text_column)
    half = F.floor(F.length("text") / F.lit(2)).cast("int")
    texts = placed.withColumn("kept", F.length("text") - half).withColumn("head", F.substr("next_text", F.lit(1), half)) \
        .withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("kept")), "head"))
    row = ["block", "place"]
    drawn = draw_samples(weighted_terms(texts, row), row, samples)
    facts = texts.select(*row, F.when(F.col("key") > _long(-NO_ID), F.col("key")).alias("doc_id"),
                         F.length("text").cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                         (F.col("next_halo") == 1).alias("_ends"))
    marked = facts.join(drawn, row).select(
        *facts.columns, _written_marks(F.col("samples"), "a").alias("fingerprint"),
        _written_marks(F.col("samples"), "b").alias("edited_fingerprint"))
    # Read twice: as rows, and as the next of the row before.
    marked = written(marked, "fingerprints")
    ends = marked.where("_ends").join(after, F.col("block") == F.col("before")) \
        .select(*marked.columns, F.col("after").alias("_block"), F.lit(1).alias("_place"))
    inside = marked.where("NOT _ends").select(*marked.columns, F.col("block").alias("_block"),
                                              (F.col("place") + 1).alias("_place"))
    following = marked.select(F.col("block").alias("_block"), F.col("place").alias("_place"),
                              F.col("fingerprint").alias("_next"))
    return inside.unionByName(ends).join(following, ["_block", "_place"]).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next"), samples).alias("near_next"))
