"""From a raw trace to model-ready tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from jobtrail.operators.checkpoints import materialise, spread
from jobtrail.operators.features import FEATURE_MODES, assemble, feature_columns
from jobtrail.operators.load import offered_load
from jobtrail.operators.prep import add_temporal_features, fill_unknown, job_table
from jobtrail.operators.splits import chrono_split, hash_split
from jobtrail.schema import TARGET


@dataclass(frozen=True)
class FeatureSet:
    """Engineered table with its split, and the model inputs of one feature mode."""

    jobs: DataFrame
    assembled: DataFrame
    numeric: list[str]
    categorical: list[str]
    categories: int

    @property
    def train(self) -> DataFrame:
        return self.assembled.where(F.col("split") == "train")

    @property
    def test(self) -> DataFrame:
        return self.assembled.where(F.col("split") == "test")


def add_features(jobs: DataFrame) -> DataFrame:
    """Add time of day, filled categories and offered load to a job table."""
    return offered_load(fill_unknown(add_temporal_features(jobs)))


def engineered_jobs(raw: DataFrame, time_unit: str = "s", gpu_mode: str = "truncate",
                    extra: Sequence[str] = ()) -> DataFrame:
    """Job table of a raw trace with all features."""
    return add_features(job_table(raw, time_unit, gpu_mode, extra))


def prepare_features(raw: DataFrame | None = None, processed: DataFrame | None = None, time_unit: str = "s",
                     test_size: float = 0.2, feature_mode: str = "numeric_only", shuffle: bool = False,
                     seed: int = 42, extra: Sequence[str] = ()) -> FeatureSet:
    """Build or take an engineered table, split it and assemble the inputs of one mode.

    The split table is written out once: encoders and learners read it many times.
    """
    if feature_mode not in FEATURE_MODES:
        raise ValueError(f"Unknown feature_mode: {feature_mode!r}")
    if (raw is None) == (processed is None):
        raise ValueError("Give either a raw trace or a processed job table.")
    jobs = job_table(raw, time_unit, extra=extra) if processed is None else fill_unknown(processed)
    # Splitting the plain table finds the cut without computing the load first.
    split = hash_split(jobs, test_size, seed) if shuffle else chrono_split(jobs, test_size)
    kept = materialise(spread(add_features(split) if processed is None else split, "job_id"))
    numeric, categorical = feature_columns(kept)
    inputs, categories = assemble(kept.withColumn("label", F.col(TARGET)), kept.where(F.col("split") == "train"),
                                  numeric, categorical, feature_mode)
    if categories or feature_mode == "with_categorical_ordered":
        # Learners pass over the inputs many times; the encoding joins run once.
        inputs = materialise(spread(inputs, "job_id"))
    return FeatureSet(kept, inputs, numeric, categorical, categories)
