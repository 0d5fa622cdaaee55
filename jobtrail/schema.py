"""Column names and types of traces, capacity classes and experiment records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Names in raw traces.
REQUIRED_RAW = ["job_id", "submit_time", "duration", "num_gpu", "user", "gpu_type"]
OPTIONAL_RAW = ["num_inst", "num_cpu"]

RAW_TRACE = T.StructType([
    T.StructField("job_id", T.LongType()),
    T.StructField("submit_time", T.LongType()),
    T.StructField("duration", T.DoubleType()),
    T.StructField("num_gpu", T.DoubleType()),
    T.StructField("num_cpu", T.IntegerType()),
    T.StructField("num_inst", T.IntegerType()),
    T.StructField("user", T.StringType()),
    T.StructField("gpu_type", T.StringType()),
])

# Canonical column order of the job table.
JOB_COLUMNS = ["job_id", "arrival_time", "arrival_sec", "job_runtime", "gpu_demand",
               "user", "gpu_type", "num_inst", "num_cpu"]

# Integer-microsecond working columns that keep every sum exact.
WORK_COLUMNS = ["arrival_us", "runtime_us"]

# Default model inputs.
NUMERIC_FEATURES = ["gpu_demand", "arrival_sec", "num_inst", "num_cpu", "hour_of_day", "day_of_week",
                    "cluster_load_cpu", "cluster_load_gpu", "active_job_count"]
CATEGORICAL_FEATURES = ["user", "gpu_type"]

TARGET = "job_runtime"

METRICS = T.StructType([T.StructField(name, T.DoubleType())
                        for name in ("mae", "rmse", "r2", "mape", "mdae", "train_time")])

EXPERIMENT = T.StructType([
    T.StructField("metrics", METRICS),
    T.StructField("best_params", T.MapType(T.StringType(), T.StringType())),
])


@dataclass(frozen=True)
class NodeClass:
    """``nodes`` identical machines with consecutive ids starting at ``first_id``."""

    first_id: int
    nodes: int
    cpu: float
    gpu: float
    mem: float = 0.0


def node_classes(shapes: list[tuple[int, float, float]]) -> list[NodeClass]:
    """Number the machines of ``(nodes, cpu, gpu)`` shapes one after the other."""
    out, first = [], 0
    for nodes, cpu, gpu in shapes:
        out.append(NodeClass(first, nodes, cpu, gpu))
        first += nodes
    return out


def heterogeneous_cluster(n_high: int = 25, n_mid: int = 100, n_cpu: int = 50) -> list[NodeClass]:
    """High-end (96 CPU, 8 GPU), mid-range (64, 2) and CPU-only (64, 0) nodes."""
    return node_classes([(n_high, 96.0, 8.0), (n_mid, 64.0, 2.0), (n_cpu, 64.0, 0.0)])
