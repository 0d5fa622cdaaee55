"""From a raw trace to the canonical job table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from jobtrail.functions.expressions import epoch_micros, numeric_epoch_micros, to_seconds
from jobtrail.functions.frames import attach, require_columns
from jobtrail.schema import JOB_COLUMNS, REQUIRED_RAW, WORK_COLUMNS


def valid_jobs(raw: DataFrame) -> DataFrame:
    """Jobs that ran and asked for a GPU; nulls fail both tests."""
    require_columns(raw, ["duration", "num_gpu"])
    return raw.where((F.col("duration") > 0) & (F.col("num_gpu") > 0))


def _submit_micros(raw: DataFrame, time_unit: str) -> Column:
    if isinstance(raw.schema["submit_time"].dataType, T.NumericType):
        return numeric_epoch_micros(F.col("submit_time"), time_unit)
    return epoch_micros(F.col("submit_time"))


def job_table(raw: DataFrame, time_unit: str = "s", gpu_mode: str = "truncate",
              extra: Sequence[str] = ()) -> DataFrame:
    """Clean a raw trace; ``gpu_demand`` is truncated to whole GPUs unless ``gpu_mode='exact'``.

    ``arrival_sec`` counts from the first valid job. ``arrival_us`` and
    ``runtime_us`` hold the same times as integers; ``extra`` names further
    input columns to keep.
    """
    require_columns(raw, REQUIRED_RAW)
    if gpu_mode not in ("truncate", "exact"):
        raise ValueError(f"Unknown gpu_mode: {gpu_mode!r}")
    jobs = valid_jobs(raw).withColumn("arrival_us", _submit_micros(raw, time_unit))
    first = jobs.agg(F.min("arrival_us").alias("t0"))
    gpu = F.col("num_gpu").cast("int") if gpu_mode == "truncate" else F.col("num_gpu").cast("double")
    table = (
        attach(jobs, first)
        .withColumn("arrival_time", F.timestamp_micros("arrival_us").cast("timestamp_ntz"))
        .withColumn("arrival_sec", to_seconds(F.col("arrival_us") - F.col("_row.t0")))
        .withColumn("job_runtime", F.col("duration").cast("double"))
        .withColumn("runtime_us", F.round(F.col("duration") * 1e6).cast("bigint"))
        .withColumn("gpu_demand", gpu)
    )
    keep = [c for c in JOB_COLUMNS if c in table.columns]
    return table.select(*keep, *WORK_COLUMNS, *[c for c in extra if c not in keep])


def add_temporal_features(jobs: DataFrame) -> DataFrame:
    """``hour_of_day`` (0-23) and ``day_of_week`` (Monday is 0)."""
    require_columns(jobs, ["arrival_time"])
    return (jobs.withColumn("hour_of_day", F.hour("arrival_time"))
                .withColumn("day_of_week", F.weekday("arrival_time")))


def fill_unknown(jobs: DataFrame, columns: Sequence[str] = ("user", "gpu_type")) -> DataFrame:
    """Null categories become ``unknown`` in those columns that exist."""
    present = {c: F.coalesce(F.col(c), F.lit("unknown")) for c in columns if c in jobs.columns}
    return jobs.withColumns(present) if present else jobs


def scaled_replay(jobs: DataFrame, load_factor: float = 0.4) -> DataFrame:
    """Compress arrivals: ``submit_time`` is the time since the first job times ``load_factor``."""
    first = jobs.agg(F.min("arrival_us").alias("t0"))
    return (attach(jobs, first)
            .withColumn("submit_time", to_seconds(F.col("arrival_us") - F.col("_row.t0")) * F.lit(load_factor))
            .drop("_row"))
