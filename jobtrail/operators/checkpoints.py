"""Cutting lineage in the reliable folder shared by the cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in ``spark.checkpoint.dir``; a local session may make its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    folder = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder shared by the cluster.")
        folder = tempfile.mkdtemp(prefix="checkpoint-")
    sc.setCheckpointDir(folder)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Deal rows by the hash of ``columns`` over as many parts as there are cores.

    Learners go through the same parts many times, and a small file is read, or a small shuffle
    merged, into fewer parts than there are cores.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, *columns)


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder once and continue from the written rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
