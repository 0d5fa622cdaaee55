"""Mixing sources to target weights by Poisson replication.

A source's rate is how often its documents have to be repeated on average for
the source to hold its target share of the bytes. A document's number of copies
inverts the Poisson distribution with that mean at a number drawn from a hash
of the seed and the document id, so it does not depend on partitioning or on
retries. Copies are dealt to partitions by a hash and sorted by it: a global
shuffle.

Rates above ``PIECE`` are drawn as the sum of several smaller Poisson numbers.

Defined results: a null source is a source of its own; a null text has no bytes
but is replicated; null document ids draw by a hash of the text; rows with one
document id share their draw; a source of no bytes has rate 1 times
``epochs``; columns named like the added ones are replaced, others are kept; an
empty table gives no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, functions as F

from jobtrail.llm.shared import hex_unit, written
from jobtrail.functions.frames import SALTS, null_safe_join

PIECE = 8.0
# Up to this many sources their rates travel to every task; more are joined by shuffling.
SENT_SOURCES = 10_000
ADDED = ("mix_copy", "mix_order")


def power_weights(sizes: DataFrame, power: float) -> DataFrame:
    """Weights that grow as a power of the sources' bytes; below 1 small sources gain."""
    return sizes.withColumn("weight", F.pow(F.col("bytes").cast("double"), F.lit(power)))


def source_sizes(docs: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """Documents and UTF-8 bytes of each source, summed before the shuffle."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint")
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("bytes"))


def repetition_rates(sizes: DataFrame, epochs: float = 1.0) -> DataFrame:
    """Mean copies per document: target bytes over present bytes, from ``source, bytes, weight``."""
    whole = sizes.agg(F.sum("bytes").cast("double").alias("bytes"), F.sum("weight").alias("weight"))
    all_bytes, all_weight = (whole.select(c).scalar() for c in ("bytes", "weight"))
    rate = F.col("weight") / all_weight * all_bytes * F.lit(float(epochs)) / F.col("bytes").cast("double")
    return sizes.select("source", F.when(F.col("bytes") > 0, rate).otherwise(F.lit(float(epochs))).alias("rate"))


def with_distribution(rates: DataFrame) -> DataFrame:
    """Add the number of pieces and the cumulative Poisson probabilities of one piece."""
    pieces = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(PIECE))).cast("int")
    terms = F.ceil(F.col("_mean") + F.lit(12.0) * F.sqrt("_mean") + F.lit(30.0)).cast("int")
    first = F.exp(-F.col("_mean"))
    series = F.aggregate(
        F.sequence(F.lit(1), terms), F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("all")),
        lambda s, k: F.struct((s.p * F.col("_mean") / k).alias("p"), (s.sum + s.p * F.col("_mean") / k).alias("sum"),
                              F.concat(s.all, F.array(s.sum + s.p * F.col("_mean") / k)).alias("all")),
        lambda s: s.all)
    return rates.withColumn("_pieces", pieces).withColumn("_mean", F.col("rate") / F.col("_pieces")) \
        .withColumn("_cumulative", series).drop("_mean")


def _split_join(rows: DataFrame, rates: DataFrame, source: str, identity: Column, name: str) -> DataFrame:
    """Join the rates by shuffling; a source of many rows is split by the hash of their identities."""
    salt = next(n for n in (f"{name}s{i}" for i in itertools.count()) if n not in rows.columns)
    left = rows.withColumn(salt, F.pmod(F.xxhash64(identity), F.lit(SALTS)).cast("int"))
    right = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return null_safe_join(left, right, [source, salt]).drop(salt)


def _copies(rate: Column, identity: Column, seed: int) -> Column:
    def piece(sum_so_far: Column, k: Column) -> Column:
        draw = hex_unit(F.concat_ws("|", F.lit(str(seed)), identity, k.cast("string")))
        return sum_so_far + F.size(F.filter(rate["_cumulative"], lambda c: c <= draw))
    return F.aggregate(F.sequence(F.lit(1), rate["_pieces"]), F.lit(0), piece)


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, power: float = 0.5, epochs: float = 1.0,
                seed: int = 7, id_column: str = "doc_id", source_column: str = "source",
                text_column: str = "text") -> DataFrame:
    """Repeat documents so that sources reach their target shares; shuffle the copies.

    ``weights`` has ``source, weight``; a source without a weight is left out.
    Without it, weights are the ``power`` of the sources' bytes. ``epochs`` is
    the size of the output relative to the input. Adds ``mix_copy`` (from 0) and
    ``mix_order``, by which every partition is sorted.
    """
    sizes = source_sizes(docs, source_column, text_column)
    if weights is None:
        weighted = power_weights(sizes, power)
    else:
        weighted = null_safe_join(sizes, weights.select("source", F.col("weight").cast("double").alias("weight")),
                                  ["source"])
    # A row per source, needed to check its size and again for the join.
    rates = written(with_distribution(repetition_rates(weighted, epochs)), "rates")
    few = rates.count() <= SENT_SOURCES
    kept = docs.drop(*ADDED)
    # What is added meanwhile is one struct under a name that no column has.
    name = next(n for n in (f"_mix{i}" for i in itertools.count()) if n not in kept.columns)
    rates = rates.select(F.col("source").alias(source_column), F.struct("_pieces", "_cumulative").alias(name))
    identity = F.coalesce(F.col(id_column).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(text_column, F.lit("")))))
    if few:
        joined = null_safe_join(kept, F.broadcast(rates), [source_column])
    else:
        joined = _split_join(kept, rates, source_column, identity, name)
    drawn = joined.withColumn(name, _copies(F.col(name), identity, seed)).where(F.col(name) > 0)
    exploded = drawn.select(*kept.columns, F.explode(F.sequence(F.lit(0), F.col(name) - 1)).alias("mix_copy"))
    order = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), identity, F.col("mix_copy").cast("string")))
    placed = exploded.withColumn("mix_order", F.conv(F.substring(order, 1, 15), 16, 10).cast("bigint"))
    return placed.repartition("mix_order").sortWithinPartitions("mix_order")
