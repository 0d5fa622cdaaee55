"""A job trace seen in the ``events`` table: every event becomes one submitted job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobtrail.functions.expressions import epoch_micros

# Queues the users are spread over.
QUEUES = 50


def events_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw trace with ``submit_time`` in microseconds, plus queue and predicted runtime."""
    return trace_from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def trace_from_events(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    base = events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    duration_us = F.round(F.col("value") * 60000).cast("bigint") * 1000
    predicted_us = F.round(F.col("value") * 48000).cast("bigint") * 1000 + (F.col("k") - 50).cast("bigint") * 1000000
    return base.select(
        F.col("event_id").alias("job_id"),
        epoch_micros(F.col("ts")).alias("submit_time"),
        (duration_us / F.lit(1e6)).alias("duration"),
        (F.col("k") / F.lit(25.0)).alias("num_gpu"),
        (1 + F.col("k") % 16).cast("int").alias("num_cpu"),
        (1 + F.col("k") % 4).cast("int").alias("num_inst"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user"),
        F.col("event_type").alias("gpu_type"),
        (F.col("user_id") % QUEUES).alias("queue_id"),
        predicted_us.alias("pred_us"),
    )
