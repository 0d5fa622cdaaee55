from jobtrail.sources.events import events_trace
from jobtrail.sources.experiments import read_experiment, read_experiments, write_experiments
from jobtrail.sources.traces import (
    TracePaths, load_baseline_estimate, load_main, load_processed, load_sample, raw_trace,
    read_job_table, write_job_table,
)

__all__ = [
    "TracePaths", "events_trace", "load_baseline_estimate", "load_main", "load_processed",
    "load_sample", "raw_trace", "read_experiment", "read_experiments", "read_job_table",
    "write_experiments", "write_job_table",
]
