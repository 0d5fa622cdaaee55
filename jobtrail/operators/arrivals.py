"""Arrival series, day-by-hour grid and gaps between arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobtrail.functions.expressions import to_seconds
from jobtrail.functions.frames import attach, require_columns
from jobtrail.operators.scan import Scan, key_scan

HOUR_US = 3_600_000_000
# Grid cells made by one row.
RUN = 4_096


def _grid(ends: DataFrame, name: str) -> DataFrame:
    """Every integer from ``lo`` to ``hi`` of the one row of ``ends``, in runs that many tasks can share."""
    runs = ends.where(F.col("hi").isNotNull()).select(
        "lo", "hi", F.explode(F.expr(f"sequence(0L, (hi - lo) div {RUN})")).alias("_run"))
    start = F.col("lo") + F.col("_run") * F.lit(RUN)
    return runs.repartition("_run").select(
        "lo", F.explode(F.sequence(start, F.least(start + F.lit(RUN - 1), F.col("hi")))).alias(name))


def arrival_rate(jobs: DataFrame, width_us: int = HOUR_US) -> DataFrame:
    """Jobs per bin of time since the first arrival, empty bins included."""
    require_columns(jobs, ["arrival_us", "job_id"])
    first = jobs.agg(F.min("arrival_us").alias("t0"))
    bin_of = F.floor((F.col("arrival_us") - F.col("_row.t0")) / F.lit(width_us)).cast("bigint")
    counts = attach(jobs, first).groupBy(bin_of.alias("bin")).agg(F.count("job_id").alias("n"))
    grid = _grid(counts.agg(F.lit(0).cast("bigint").alias("lo"), F.max("bin").alias("hi")), "bin")
    filled = grid.join(counts, "bin", "left")
    return filled.select("bin", (F.col("bin") * F.lit(width_us) / F.lit(3.6e9)).alias("elapsed_hours"),
                         F.coalesce("n", F.lit(0)).alias("n"))


def calendar_rate(jobs: DataFrame) -> DataFrame:
    """Jobs per clock hour from the first to the last, empty hours included."""
    require_columns(jobs, ["arrival_us"])
    hour = F.floor(F.col("arrival_us") / F.lit(HOUR_US)).cast("bigint")
    counts = jobs.groupBy(hour.alias("hour_index")).agg(F.count(F.lit(1)).alias("n"))
    ends = counts.agg(F.min("hour_index").alias("lo"), F.max("hour_index").alias("hi"))
    return _grid(ends, "hour_index").join(counts, "hour_index", "left").select(
        (F.col("hour_index") * F.lit(HOUR_US)).alias("hour_us"),
        ((F.col("hour_index") - F.col("lo")) / F.lit(24.0)).alias("elapsed_days"),
        F.coalesce("n", F.lit(0)).alias("n"))


def arrival_heatmap(jobs: DataFrame, full: bool = True) -> DataFrame:
    """Jobs per weekday and hour; ``full`` keeps all 168 cells, else only the observed ones."""
    require_columns(jobs, ["day_of_week", "hour_of_day"])
    counts = jobs.groupBy(F.col("day_of_week").cast("int").alias("day_of_week"),
                          F.col("hour_of_day").cast("int").alias("hour_of_day")) \
        .agg(F.count(F.lit(1)).alias("n"))
    if not full:
        return counts
    grid = jobs.sparkSession.range(168).select(
        F.floor(F.col("id") / 24).cast("int").alias("day_of_week"),
        (F.col("id") % 24).cast("int").alias("hour_of_day"))
    return grid.join(counts, ["day_of_week", "hour_of_day"], "left").select(
        "day_of_week", "hour_of_day", F.coalesce("n", F.lit(0)).alias("n"))


def heatmap_matrix(jobs: DataFrame) -> DataFrame:
    """The observed cells as one row per weekday and one column per hour."""
    return (arrival_heatmap(jobs, full=False).groupBy("day_of_week")
            .pivot("hour_of_day", list(range(24))).agg(F.sum("n")).na.fill(0))


def inter_arrival(jobs: DataFrame) -> DataFrame:
    """Positive gaps between consecutive arrivals, one row per later arrival instant.

    Simultaneous arrivals have gap zero and are left out, so the gaps are those
    between distinct instants.
    """
    instants = jobs.select("arrival_us").distinct()
    scanned = key_scan(instants, "arrival_us", [Scan("_prev", "last", "arrival_us", before=True)])
    gaps = scanned.where(F.col("_prev").isNotNull())
    return gaps.select("arrival_us", to_seconds(F.col("arrival_us") - F.col("_prev")).alias("gap_sec"))
