"""Cluster load over time: sweep over start and end events, and as-of lookups into it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from jobtrail.functions.frames import null_safe_join, require_columns
from jobtrail.operators.scan import Scan, key_scan
from jobtrail.schema import NodeClass

STATE_SCANS = [Scan("load_cpu", "sum", "d_cpu"), Scan("load_gpu", "sum", "d_gpu"),
               Scan("active_jobs", "sum", "change_count")]


def _cpu(jobs: DataFrame):
    return F.coalesce(F.col("num_cpu"), F.lit(0)).cast("bigint") if "num_cpu" in jobs.columns \
        else F.lit(0).cast("bigint")


def event_deltas(jobs: DataFrame) -> DataFrame:
    """Change of CPU, GPU and job count at each instant some job starts or ends.

    One pass over the jobs emits both events of each; simultaneous events are
    summed map-side first, so an instant shared by many jobs shuffles as one
    row per task.
    """
    require_columns(jobs, ["arrival_us", "runtime_us", "gpu_demand"])
    cpu, gpu = _cpu(jobs), F.coalesce(F.col("gpu_demand"), F.lit(0)).cast("bigint")
    one = F.lit(1).cast("bigint")
    start = F.struct(F.col("arrival_us").alias("t"), cpu.alias("d_cpu"), gpu.alias("d_gpu"),
                     one.alias("change_count"))
    end = F.struct((F.col("arrival_us") + F.col("runtime_us")).alias("t"), (-cpu).alias("d_cpu"),
                   (-gpu).alias("d_gpu"), (-one).alias("change_count"))
    events = jobs.select(F.inline(F.array(start, end)))
    return events.groupBy("t").agg(*[F.sum(c).alias(c) for c in ("d_cpu", "d_gpu", "change_count")])


def cluster_state(jobs: DataFrame) -> DataFrame:
    """Step function of the cluster: load from each change point on."""
    return key_scan(event_deltas(jobs), "t", STATE_SCANS).select("t", "load_cpu", "load_gpu", "active_jobs")


def offered_load(jobs: DataFrame) -> DataFrame:
    """Load each job meets at its arrival, without its own demand.

    Jobs run over ``[arrival, arrival + runtime)``: one that ends at the very
    instant is gone, others arriving at the same instant count. Each arrival is
    itself a change point, so the lookup is an equi-join on the instant, whose
    state side has one row per instant (a hot instant is split by adaptive
    skew handling, which needs nothing replicated but that row).
    """
    return load_at_arrival(jobs, cluster_state(jobs))


def load_at_arrival(jobs: DataFrame, state: DataFrame) -> DataFrame:
    """Look the load at each arrival up in a state with a row per instant, and take the job's own demand off."""
    state = state.withColumnRenamed("t", "_t")
    joined = jobs.join(state, F.col("arrival_us") == F.col("_t"), "left")
    none = F.lit(0).cast("bigint")
    return joined.select(
        *jobs.columns,
        F.coalesce(F.col("load_cpu") - _cpu(jobs), none).alias("cluster_load_cpu"),
        F.coalesce(F.col("load_gpu") - F.col("gpu_demand"), none).alias("cluster_load_gpu"),
        F.coalesce(F.col("active_jobs") - 1, none).alias("active_job_count"),
    )


def asof_backward(left: DataFrame, right: DataFrame, on: str, values: Sequence[str],
                  by: Sequence[str] = ()) -> DataFrame:
    """Latest right row at or before each left row's BIGINT instant ``on``.

    ``right`` has one row per (by, on). Both sides' instants are merged into one
    timeline whose gaps are filled by a last-value scan; left rows then find
    their instant by an equi-join.
    """
    seen = F.struct(*values)
    kind = right.select(seen.alias("s")).schema["s"].dataType
    points = right.select(*by, on, F.lit(0).alias("_asked"), seen.alias("_seen"))
    slots = left.select(*by, on).distinct().select(*by, on, F.lit(1).alias("_asked"), F.lit(None).cast(kind).alias("_seen"))
    # At one instant the point comes first, so an exact match counts.
    filled = key_scan(points.unionByName(slots), on, [Scan("_last", "last", "_seen")], by=by, order=["_asked"])
    found = filled.where(F.col("_asked") == 1).select(*by, on, *[F.col(f"_last.{v}").alias(v) for v in values])
    return null_safe_join(left, found, [*by, on], "left")


def utilization_timeline(jobs: DataFrame, cluster: Sequence[NodeClass]) -> DataFrame:
    """Share of the cluster's CPUs and GPUs asked for at each change point."""
    cpus = sum(c.nodes * c.cpu for c in cluster) or 1.0
    gpus = sum(c.nodes * c.gpu for c in cluster) or 1.0
    return cluster_state(jobs).select(
        "t", (F.col("load_cpu") / F.lit(float(cpus))).alias("cpu_util"),
        (F.col("load_gpu") / F.lit(float(gpus))).alias("gpu_util"), "active_jobs")
