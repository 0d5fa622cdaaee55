"""Experiment records: one JSON document per experiment with metrics and parameters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from jobtrail.schema import EXPERIMENT
from jobtrail.sources.traces import _path_exists


def write_experiments(df: DataFrame, path: str) -> None:
    """Write rows of ``(experiment, metrics, best_params)``, one folder per experiment.

    Only the experiments present in ``df`` are replaced; others stay.
    """
    (df.select("experiment", "metrics", "best_params").write
       .mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy("experiment").json(path))


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """All experiments under ``path``: folders written here, or plain ``<name>.json`` files."""
    file = F.url_decode(F.col("_metadata.file_path"))
    names = {"experiment=*/*.json": F.regexp_extract(file, r"experiment=([^/]+)/", 1),
             "*.json": F.regexp_extract(file, r"([^/]+)\.json$", 1)}
    found = []
    for pattern, name in names.items():
        where = f"{path.rstrip('/')}/{pattern}"
        if _path_exists(spark, where):
            # Folders hold a record per line, any number of them; a plain file is one document.
            records = spark.read.schema(EXPERIMENT).option("multiLine", pattern == "*.json").json(where)
            found.append(records.select(name.alias("experiment"), "metrics", "best_params"))
    if not found:
        return spark.createDataFrame([], T.StructType([T.StructField("experiment", T.StringType()), *EXPERIMENT.fields]))
    return union_experiments(*found).orderBy("experiment")


def union_experiments(*records: DataFrame) -> DataFrame:
    """All records of several sets, by column name."""
    return reduce(lambda a, b: a.unionByName(b), records)


def read_experiment(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """One experiment, or None if it was never written."""
    found = read_experiments(spark, path).where(F.col("experiment") == name)
    return None if found.isEmpty() else found


def experiment_table(experiments: DataFrame) -> DataFrame:
    """Metrics of each experiment as columns."""
    return experiments.select("experiment", "metrics.*")


def comparison_table(experiments: DataFrame, labels: DataFrame) -> DataFrame:
    """Experiments under their ``track`` and ``model`` label, best MAE first within a track.

    ``labels`` has one row ``(experiment, track, model)`` per experiment to show;
    there is one row per trained model, so the table is small.
    """
    rows = experiment_table(experiments).join(labels, "experiment")
    within = Window.partitionBy("track").orderBy(F.col("mae").asc_nulls_last(), "model")
    return rows.select("track", "model", "mae", "rmse", "r2", F.row_number().over(within).alias("place")) \
        .orderBy("track", "place")


def champion_parameters(experiments: DataFrame) -> DataFrame:
    """Chosen parameters of each experiment as one JSON text."""
    return experiments.select("experiment", F.to_json("best_params").alias("params"))
