"""Exact order statistics by selection.

Rows are counted per key block, the counts are scanned to find the few blocks
holding the wanted ranks, and only the values of those blocks are counted and
ranked. No task sees a whole group.

Without groups the input is read twice and next to nothing is shuffled. With
groups the rows are first counted per distinct value, combined before the
shuffle, and both steps use these counts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobtrail.functions.expressions import order_key
from jobtrail.functions.frames import attach
from jobtrail.operators.scan import BLOCK, Scan, block_totals, solid_keys, with_key_blocks


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per distinct non-null value (``value``, ``n``) with its ordered key."""
    dtype = dict(df.dtypes)[value]
    counted = (df.where(F.col(value).isNotNull())
               .groupBy(*by, F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n")))
    return counted.withColumn("_key", order_key(F.col("value"), dtype))


def weighted_values(df: DataFrame, value: str) -> DataFrame:
    """The non-null values row by row in the shape of ``value_counts``."""
    dtype = dict(df.dtypes)[value]
    return df.where(F.col(value).isNotNull()).select(
        F.col(value).alias("value"), F.lit(1).cast("bigint").alias("n"), order_key(F.col(value), dtype).alias("_key"))


def values_at_ranks(counted: DataFrame, ranks: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Value and preceding row count at 0-based ranks of each group.

    ``counted`` comes from ``value_counts``, or without groups from
    ``weighted_values``. ``ranks`` maps a name to a BIGINT expression over the group size ``total``.
    The result has ``<name>`` and ``<name>_before`` per entry, plus ``total``.
    """
    blocked, widths = with_key_blocks(counted, "_key")
    keyed, keys = solid_keys(blocked, by)
    counts = [Scan("before", "sum", "n", before=True), Scan("total", "total", "n")]
    blocks = block_totals(keyed, keys, ["_key"], counts, widths).select(
        *keys, BLOCK, F.coalesce("_h_before", F.lit(0)).alias("_lo"),
        F.col("_v_before").alias("_size"), F.col("_h_total").alias("total"))
    wanted = F.lit(False)
    for rank in ranks.values():
        wanted = wanted | ((F.col("_lo") <= rank) & (rank < F.col("_lo") + F.col("_size")))
    hits = blocks.where(wanted).select(*keys, BLOCK, "_lo", "total")
    if by:
        rows = keyed.join(hits, [*keys, BLOCK])
    else:
        # At most one block per rank, so all hits fit in one constant and no row is shuffled for them.
        found = hits.agg(F.map_from_entries(F.collect_list(F.struct(BLOCK, F.struct("_lo", "total")))).alias("by_block"))
        hit = F.try_element_at(F.col("_hits.by_block"), F.col(BLOCK))
        rows = attach(keyed, found, "_hits").withColumn("_hit", hit).where(F.col("_hit").isNotNull()) \
            .groupBy("value", "_key", BLOCK, F.col("_hit._lo").alias("_lo"), F.col("_hit.total").alias("total")) \
            .agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy(*keys, BLOCK).orderBy("_key", "value").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_before", F.col("_lo") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    picked = [F.max("total").alias("total")]
    for name, rank in ranks.items():
        here = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("n"))
        picked += [F.max(F.when(here, F.col("value"))).alias(name),
                   F.max(F.when(here, F.col("_before"))).alias(f"{name}_before")]
    return rows.groupBy(*by).agg(*picked)


def quantiles(df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group."""
    ranks: dict[str, Column] = {}
    last = F.col("total") - F.lit(1)
    for name, p in probs.items():
        spot = F.lit(float(p)) * last
        ranks[f"_lo_{name}"] = F.floor(spot).cast("bigint")
        ranks[f"_hi_{name}"] = F.ceil(spot).cast("bigint")
    rows = value_counts(df, value, by) if by else weighted_values(df, value)
    picked = values_at_ranks(rows, ranks, by)
    out = []
    for name, p in probs.items():
        spot = F.lit(float(p)) * last
        low, high = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        between = low + (high - low) * (spot - F.floor(spot))
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    return picked.select(*by, *out)
