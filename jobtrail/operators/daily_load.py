"""Cluster load brought up to date span by span (for example daily), without reading older spans.

After each span a carry table is kept: the load at the span's end and what the
jobs still running will give back, one row per instant they end. The next span's load needs
its own jobs and this table, whose size goes with the open jobs, not with the
history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtrail.operators.checkpoints import spread
from jobtrail.operators.load import STATE_SCANS, event_deltas, load_at_arrival
from jobtrail.operators.scan import key_scan

DELTAS = ("d_cpu", "d_gpu", "change_count")
CARRY = "t long, d_cpu long, d_gpu long, change_count long"
DAY_US = 86_400_000_000


def no_carry(spark: SparkSession) -> DataFrame:
    """The carry of an idle cluster."""
    return spark.createDataFrame([], CARRY)


def deal_spans(jobs: DataFrame, folder: str, step_us: int) -> DataFrame:
    """Write what the load needs of the jobs once, a folder per span of ``step_us``; a span found by ``start`` reads only its own.

    Jobs without an arrival are in no span. A span's rows lie in as many files as there are cores.
    """
    needed = [c for c in ("job_id", "arrival_us", "runtime_us", "gpu_demand", "num_cpu") if c in jobs.columns]
    start = (F.floor(F.col("arrival_us") / F.lit(step_us)) * F.lit(step_us)).cast("bigint")
    dealt = spread(jobs.select(*needed).where(F.col("arrival_us").isNotNull()), "job_id").withColumn("start", start)
    dealt.write.partitionBy("start").parquet(folder)
    return jobs.sparkSession.read.schema(dealt.schema).parquet(folder)


def _summed(deltas: DataFrame) -> DataFrame:
    return deltas.groupBy("t").agg(*[F.sum(c).alias(c) for c in DELTAS])


def span_changes(jobs: DataFrame, carry: DataFrame, start_us: int) -> DataFrame:
    """All changes from the span on: the carried load as one at its start, carried ends, and the span's own jobs."""
    opened = carry.withColumn("t", F.greatest("t", F.lit(start_us)))
    return _summed(event_deltas(jobs).unionByName(opened))


def span_state(jobs: DataFrame, carry: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """``t, load_cpu, load_gpu, active_jobs`` at each change within ``[start, end)``."""
    within = span_changes(jobs, carry, start_us).where(F.col("t") < end_us)
    return key_scan(within, "t", STATE_SCANS).select("t", "load_cpu", "load_gpu", "active_jobs")


def span_load(jobs: DataFrame, carry: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Load each job of the span meets at its arrival, as ``load.offered_load`` of the whole history gives it."""
    return load_at_arrival(jobs, span_state(jobs, carry, start_us, end_us))


def next_carry(jobs: DataFrame, carry: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """The load at ``end_us`` as one row just before it, and the ends that are still to come."""
    changes = span_changes(jobs, carry, start_us)
    held = changes.where(F.col("t") < end_us).agg(*[F.coalesce(F.sum(c), F.lit(0).cast("bigint")).alias(c) for c in DELTAS])
    return held.select(F.lit(end_us - 1).cast("bigint").alias("t"), *DELTAS) \
        .unionByName(changes.where(F.col("t") >= end_us).select("t", *DELTAS))


def append_span(jobs: DataFrame, folder: str, start_us: int, end_us: int, previous_us: int | None = None) -> DataFrame:
    """Write the load of the span's jobs and the new carry below ``folder``; returns the load as written.

    ``previous_us`` is the start of the span before, None for the first. Jobs
    must arrive within the span: one that is late would change loads already
    written, so it ends the call before anything is written. A span may be
    appended again; its files are replaced, the carry last.
    """
    spark = jobs.sparkSession
    outside = jobs.where(F.col("arrival_us").isNull() | (F.col("arrival_us") < start_us) | (F.col("arrival_us") >= end_us)).count()
    if outside:
        raise ValueError(f"{outside} jobs do not arrive within [{start_us}, {end_us}).")
    carry = no_carry(spark) if previous_us is None else spark.read.schema(CARRY).parquet(f"{folder}/carry/start={previous_us}")
    path = f"{folder}/load/start={start_us}"
    span_load(jobs, carry, start_us, end_us).write.mode("overwrite").parquet(path)
    next_carry(jobs, carry, start_us, end_us).write.mode("overwrite").parquet(f"{folder}/carry/start={start_us}")
    return spark.read.parquet(path)
