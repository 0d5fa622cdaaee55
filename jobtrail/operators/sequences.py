"""Sliding windows over the chronological job list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from jobtrail.operators.splits import job_ordinal

BLOCK_ROWS = 65_536


def _windows(jobs: DataFrame, features: Sequence[str], seq_len: int, keep: Sequence[str],
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each job the features of it and up to ``seq_len - 1`` jobs before, oldest first.

    Rows are dealt into blocks of fixed size by ordinal; the last rows of a
    block are repeated in the next one so that every window lies in one block.
    """
    if seq_len < 1:
        raise ValueError("seq_len must be positive.")
    block_rows = max(block_rows, seq_len)
    rows = job_ordinal(jobs, [*features, *keep])
    own = F.floor(F.col("ordinal") / F.lit(block_rows)).cast("bigint")
    spills = F.col("ordinal") % block_rows >= block_rows - (seq_len - 1)
    homes = F.when(spills, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.withColumn("_own", own).withColumn("_home", F.explode(homes))
    trailing = Window.partitionBy("_home").orderBy("ordinal").rowsBetween(-(seq_len - 1), 0)
    vector = F.array(*[F.col(f).cast("double") for f in features])
    return (dealt.withColumn("sequence", F.collect_list(vector).over(trailing))
            .where(F.col("_home") == F.col("_own")).drop("_home", "_own"))


def sequences_strict(jobs: DataFrame, features: Sequence[str], seq_len: int = 10,
                     keep: Sequence[str] = ()) -> DataFrame:
    """Complete windows only: ``n - seq_len + 1`` rows, each under its last job."""
    return _windows(jobs, features, seq_len, keep).where(F.size("sequence") == seq_len)


def sequences_padded(jobs: DataFrame, features: Sequence[str], seq_len: int = 10,
                     keep: Sequence[str] = ()) -> DataFrame:
    """One window per job; short ones repeat their first row on the left."""
    rows = _windows(jobs, features, seq_len, keep)
    missing = F.lit(seq_len) - F.size("sequence")
    padding = F.array_repeat(F.element_at("sequence", 1), missing)
    return rows.withColumn("sequence", F.concat(padding, F.col("sequence")))


def sequences_test(jobs: DataFrame, features: Sequence[str], seq_len: int = 10) -> DataFrame:
    """Windows that end in the test part; the first ones reach back into the train part."""
    return sequences_strict(jobs, features, seq_len, ["split"]).where(F.col("split") == "test")


def flatten(sequences: DataFrame, features: Sequence[str]) -> DataFrame:
    """Long form: one row per job, window position and step."""
    steps = sequences.select("job_id", F.posexplode("sequence").alias("pos", "step"))
    return steps.select("job_id", F.col("pos").cast("bigint").alias("pos"),
                        *[F.col("step")[i].alias(f) for i, f in enumerate(features)])
